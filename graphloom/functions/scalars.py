"""Column functions: token lists, cleaning, dates, ids, weights and text templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_tokens(c: Column, sep: str = "/") -> Column:
    """Trimmed non-blank tokens of a delimited string."""
    return F.filter(F.transform(F.split(c, sep), lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")


def year_bucket(year: Column) -> Column:
    """Decade group of a year; 0 and null have none."""
    groups = F.when(year < 1990, "before_1990").when(year < 2000, "1990s").when(year < 2010, "2000s").when(year < 2020, "2010s").otherwise("2020s")
    return F.when(year.isNull() | (year == 0), F.lit(None).cast("string")).otherwise(groups)


def named_ids(c: Column) -> Column:
    """Array of (name, pid, ord) from 'name:id|name:id': the id follows the last colon, ord counts all items from 1."""
    items = F.transform(F.split(c, r"\|"), lambda x, i: F.struct(F.btrim(F.regexp_extract(x, r"(?s)^(.*):([^:]*)$", 1)).alias("name"), F.btrim(F.regexp_extract(x, r"(?s)^(.*):([^:]*)$", 2)).alias("pid"), (i + 1).alias("ord")))
    return F.filter(items, lambda x: x["pid"] != "")


def loose_id(item: Column) -> Column:
    """The part after the last colon, as profiling reads it."""
    return F.element_at(F.split(item, ":"), -1)


def digit_id(item: Column) -> Column:
    """The part after the first colon if it is all digits, else null."""
    rest = F.btrim(F.regexp_extract(item, r"^[^:]*:(.*)$", 1))
    return F.when(rest.rlike("^[0-9]+$"), rest)


def clean_slashes(c: Column, strip_end: bool) -> Column:
    """Trimmed; ' / ' and '/ ' become '/' if ' / ' occurs; optionally without slashes at the end."""
    t = F.trim(c)
    t = F.when(F.contains(t, F.lit(" / ")), F.replace(F.replace(t, F.lit(" / "), F.lit("/")), F.lit("/ "), F.lit("/"))).otherwise(t)
    return F.regexp_replace(t, "/+$", "") if strip_end else t


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def match_year(c: Column) -> Column:
    """The first four digits if they are a year of 1900..2100."""
    y = F.regexp_extract(c, r"(\d{4})", 1)
    y = F.when(y != "", y.cast("int"))
    return F.when(y.between(1900, 2100), y)


def match_date(c: Column) -> Column:
    """The first Y-M-D, else Y-M, else Y, as a padded Y-M-D string."""

    def got(pattern: str, parts: int) -> Column:
        bits = [F.regexp_extract(c, pattern, k) for k in range(1, parts + 1)]
        padded = [bits[0], *(F.lpad(b, 2, "0") for b in bits[1:]), *(F.lit("01") for _ in range(3 - parts))]
        return F.when(bits[0] != "", F.concat_ws("-", *padded))

    return F.coalesce(got(r"(\d{4})-(\d{1,2})-(\d{1,2})", 3), got(r"(\d{4})-(\d{1,2})", 2), got(r"(\d{4})", 1))


def to_date(c: Column) -> Column:
    """A date of the whole string in the form Y-M-D, Y-M or Y; else null."""
    return F.coalesce(*(F.when(c.rlike(p), F.try_to_date(F.concat(c, F.lit(more)), "yyyy-M-d")) for p, more in ((r"^\d{4}-\d{1,2}-\d{1,2}$", ""), (r"^\d{4}-\d{1,2}$", "-1"), (r"^\d{4}$", "-1-1"))))


def tidy_slashes(c: Column) -> Column:
    """Runs of slashes and of white space become one; none at the ends; null gives ''."""
    t = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), "/+", "/"), F.lit("/"))
    return F.btrim(F.regexp_replace(t, r"\s+", " "))


def with_scheme(url: Column) -> Column:
    """Trimmed, with http:// before it unless it has a scheme; null and blank give ''."""
    t = F.btrim(F.coalesce(url, F.lit("")), F.lit(" \t\r\n"))
    return F.when((t == "") | t.rlike("^https?://"), t).otherwise(F.concat(F.lit("http://"), t))


#: Fixed alphabet of short codes.
CODE_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def short_code(url: Column) -> Column:
    """Nine characters from the low 27 bits of the MD5: six bits masked by 0x3d, shifted by three each time."""
    bits = F.conv(F.substring(F.md5(url), 25, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFF))
    at = [F.shiftright(bits, 3 * i).bitwiseAND(F.lit(0x3D)).cast("int") + 1 for i in range(9)]
    return F.concat(*(F.substring(F.lit(CODE_ALPHABET), i, F.lit(1)) for i in at))


def large_cover(url: Column) -> Column:
    """The large form of a cover's address; addresses of the default cover give null."""
    big = F.replace(F.replace(url, F.lit("spst"), F.lit("lpst")), F.lit("mpic"), F.lit("lpic"))
    return F.when(~F.contains(url, F.lit("default")), big)


def path_id(href: Column) -> Column:
    """The last but one part of a path."""
    return F.try_element_at(F.split(href, "/"), F.lit(-2))


def clean_text(c: Column) -> Column:
    """Common entities unescaped, white space collapsed, blank as null."""
    t = c
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.nullif(F.btrim(F.regexp_replace(t, "[\\s ]+", " ")), F.lit(""))


def slug_of(url: Column) -> Column:
    """The user's slug of a profile address or a bare slug."""
    return F.when(~F.contains(url, F.lit("://")), F.btrim(url, F.lit("/ "))).otherwise(F.nullif(F.regexp_extract(url, "/people/([^/]+)/?", 1), F.lit("")))


def profile_url(slug: Column, host: str) -> Column:
    """The address of a user's profile on a host."""
    return F.concat(F.lit(f"{host}/people/"), slug, F.lit("/"))


def list_url(slug: Column, kind: str, start: Column, host: str) -> Column:
    """The address of a page of a user's list, the latest first, from the item ``start``."""
    return F.concat(F.lit(f"{host}/people/"), slug, F.lit(f"/{kind}?sort=time&start="), start.cast("string"), F.lit("&filter=all&mode=list"))


def feed_url(slug: Column, host: str) -> Column:
    """The address of a user's feed."""
    return F.concat(F.lit(f"{host}/feed/people/"), slug, F.lit("/interests"))


def local_time(slug: Column, mid: Column, kind: str, day: Column) -> Column:
    """A stable time of day for an event of which only the day is known."""
    n = F.conv(F.substring(F.sha2(F.concat_ws(":", slug, mid, F.lit(kind), day), 256), 1, 8), 16, 10).cast("long")
    first, span = {"wish": (18, 5), "collect": (19, 5)}.get(kind, (17, 6))
    return F.format_string("%s %02d:%02d:%02d", day, first + n % span, n % 60, F.floor(n / 60) % 60)


def idf(degree: Column) -> Column:
    """1 / ln(2 + max(degree, 1))."""
    return 1 / F.log(F.lit(2.0) + F.greatest(degree, F.lit(1)))


def relation_token(rel: Column, entity: Column) -> Column:
    return F.concat_ws(":", rel, entity)


def entity_key(kind: Column, key: Column) -> Column:
    return F.concat_ws("_", kind, key)


def rounded(c: Column, digits: int = 4) -> Column:
    """Half-up on the binary value, alike in every engine."""
    return F.floor(c * F.lit(float(10**digits)) + 0.5) / F.lit(float(10**digits))


def released(year: Column, date: Column, as_of: str) -> Column:
    """Whether a film is out on a day: by year, and in that year by the first ten characters of its date."""
    this = int(as_of[:4])
    return F.when(year > this, False).when(year == this, date.isNotNull() & (F.substring(date, 1, 10) <= as_of)).otherwise(True)


# Sentences of path relations, with the name of an entity and without.
REASONS = {
    "director": ("与你喜欢的电影有共同导演 %s", "与你喜欢的电影有共同导演"),
    "actor": ("有共同演员 %s", "与你喜欢的电影有共同演员"),
    "genre": ("同属 %s 类型", "与你喜欢的电影类型相近"),
    "actor_actor": ("通过演员关联发现 %s 参与的电影", "通过演员二跳关系发现"),
    "region": ("与你偏好的电影同属 %s 地区", "与你偏好的电影地区相近"),
    "language": ("与你偏好的电影同属 %s 语言", "与你偏好的电影语言相近"),
    "content_type": ("与你偏好的电影同属 %s 内容类型", "与你偏好的电影内容类型相近"),
    "year_bucket": ("与你偏好的电影年代接近（%s）", "与你偏好的电影年代接近"),
}
AUDIENCE_REASONS = ("与多位同样喜欢该类电影的用户兴趣重合", "与你喜欢的电影受众高度重合")
OTHER_REASON = "基于知识图谱路径关联推荐"


def reason(rel: Column, name: Column, hits: Column | None = None) -> Column:
    """A sentence for a relation of a recommendation; ``hits`` tells how many users a shared audience has."""
    out = F.lit(OTHER_REASON)
    for r, (with_name, without) in REASONS.items():
        out = F.when(rel == r, F.coalesce(F.replace(F.lit(with_name), F.lit("%s"), name), F.lit(without))).otherwise(out)
    many = F.lit(False) if hits is None else F.coalesce(hits >= 2, F.lit(False))
    return F.when(rel == "shared_audience", F.when(many, AUDIENCE_REASONS[0]).otherwise(AUDIENCE_REASONS[1])).otherwise(out)


def graph_token(c: Column) -> Column:
    """Slashes and spaces as hyphens."""
    return F.translate(c, "/ ", "--")
