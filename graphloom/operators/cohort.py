"""Cohort import: landed pages and feeds parsed, merged, classified and capped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.pages import FEED_PARTS, feed_fields, feed_item

#: Fixed thresholds of the cohort's classes and the caps for capped users.
USABLE_COLLECT, USABLE_TOTAL = 20, 80
LIGHT_WISH_MIN, LIGHT_COLLECT_MIN, LIGHT_COLLECT_MAX, LIGHT_WISH_MAX = 5, 20, 300, 200
MEDIUM_COLLECT_MAX, MEDIUM_WISH_MAX = 800, 400
CAP_COLLECT, CAP_WISH = 300, 200


def classify(df: DataFrame, collect: Column, wish: Column) -> DataFrame:
    """Adds category, max_collect and max_wish (null: none) from totals of seen and wished items."""
    c, w = F.coalesce(collect, F.lit(0)), F.coalesce(wish, F.lit(0))
    light = (c.between(LIGHT_COLLECT_MIN, LIGHT_COLLECT_MAX) & (w <= LIGHT_WISH_MAX)) | ((c < LIGHT_COLLECT_MIN) & w.between(LIGHT_WISH_MIN, LIGHT_WISH_MAX))
    category = F.when((c < USABLE_COLLECT) & (c + w < USABLE_TOTAL), "too_light").when(light, "light_native").when((c <= MEDIUM_COLLECT_MAX) & (w <= MEDIUM_WISH_MAX), "medium_native").otherwise("heavy_capped")
    cap = lambda n, light_cap, most: F.when(F.col("category") != "too_light", F.nullif(F.least(n, F.when(F.col("category") == "light_native", light_cap).otherwise(most)), F.lit(0)))
    df = df.withColumn("category", category)
    return df.withColumns({"max_collect": cap(c, LIGHT_COLLECT_MAX, CAP_COLLECT), "max_wish": cap(w, LIGHT_WISH_MAX, CAP_WISH)})


def tighter(cap: Column, given: int | None) -> Column:
    """The smaller of a recommended cap and a given one; 0 means none."""
    return F.nullif(F.least(cap, F.lit(given).cast("int")), F.lit(0))


def import_rows(items: DataFrame) -> DataFrame:
    """(slug, mid, table, kind, rating10): ratings, likes (rated 4.5 or more) and wishes of listed items (slug, mid, action, rating10)."""
    rated = items.filter("action = 'collect' AND rating10 IS NOT NULL")
    ratings = rated.select("slug", "mid", F.lit("rating").alias("table"), F.lit("rating").alias("kind"), "rating10")
    likes = rated.filter("rating10 >= 45").select("slug", "mid", F.lit("pref"), F.lit("like"), F.lit(None).cast("int"))
    wishes = items.filter("action = 'wish'").select("slug", "mid", F.lit("pref"), F.lit("want_to_watch"), F.lit(None).cast("int"))
    return ratings.union(likes).union(wishes)


def known_only(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Rows of known items; wishes for items that the user has rated go."""
    known = rows.join(catalogue.select("mid"), "mid", "left_semi")
    rated = known.filter("kind = 'rating'").select("slug", "mid", F.lit("want_to_watch").alias("kind"))
    return known.join(rated, ["slug", "mid", "kind"], "left_anti").select(*rows.columns)


def enrich(listed: DataFrame, feed: DataFrame) -> DataFrame:
    """Listed items with the feed's time, and its rating where the list has none."""
    f = feed.select("slug", "action", "mid", F.col("rating10").alias("_r"), F.col("happened").alias("_t"))
    joined = listed.join(f, ["slug", "action", "mid"], "left")
    return joined.withColumn("rating10", F.coalesce("rating10", "_r")).withColumn("happened", F.coalesce("_t", "happened")).drop("_r", "_t")


def contacts(pages: DataFrame, owner: Column) -> DataFrame:
    """(owner, slug) of people linked from landed pages, without the owner and deleted accounts."""
    links = F.regexp_extract_all("html", F.lit(r'href="https?://[^"]*?/people/([^/"]+)/?"'), F.lit(1))
    rows = pages.select(owner.alias("owner"), F.explode(F.array_distinct(links)).alias("slug"))
    return rows.filter((F.col("slug") != F.col("owner")) & ~F.startswith("slug", F.lit("deleted")))


def merge_groups(groups: list[DataFrame], key: str | list[str]) -> DataFrame:
    """Union in which the first group that has a key wins."""
    out = None
    for i, g in enumerate(groups):
        one = g.withColumn("_g", F.lit(i))
        out = one if out is None else out.unionByName(one)
    order = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy("_g")
    return out.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_g", "_k")


def harvest_complete(df: DataFrame) -> Column:
    """Whether a user's harvest is complete: capped, or all pages fetched, or 95 % of the items."""
    return F.col("capped") | (F.col("pages_fetched") >= F.col("pages_total")) | (F.col("n_items") >= 0.95 * F.col("n_total"))


def feed_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """(slug and the fields of pages.feed_item) of the items of landed RSS feeds (slug, xml) that have a title, a known action and a film."""
    rows = feeds.select("slug", F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1))).alias("item"))
    return _usable(rows.select("slug", *(c.alias(k) for k, c in feed_item(F.col("item")).items())))


def landed_feed_items(items: DataFrame) -> DataFrame:
    """The same from ``readers.feed_rows`` with a column ``slug``, in batch or as a stream."""
    return _usable(items.select("slug", *(c.alias(k) for k, c in feed_fields({t: F.col(t) for t in FEED_PARTS}).items())))


def _usable(fields: DataFrame) -> DataFrame:
    return fields.filter("title IS NOT NULL AND action IS NOT NULL AND mid IS NOT NULL")


def capped_items(items: DataFrame, owner: str, order: list, most: int) -> DataFrame:
    """The first ``most`` items of each owner, with the flag ``capped``: whether the owner has more."""
    n = F.count("*").over(Window.partitionBy(owner))
    k = F.row_number().over(Window.partitionBy(owner).orderBy(*order))
    return items.withColumns({"_k": k, "capped": n > most}).filter(F.col("_k") <= most).drop("_k")


def merged_harvest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The existing output and a new run's, the new row where both have a key."""
    return merge_groups([new, old], keys)


def growth_summary(seeds: DataFrame, discovered: DataFrame, screened: DataFrame, selected: DataFrame, imported: DataFrame) -> DataFrame:
    """One row: how many users each step of a growth run had."""
    steps = {"seeds": seeds, "discovered": discovered, "screened": screened, "selected": selected, "imported": imported}
    out = None
    for name, df in steps.items():
        one = df.select(F.lit(name).alias("step"))
        out = one if out is None else out.union(one)
    return out.agg(*(F.count_if(F.col("step") == name).alias(name) for name in steps))
