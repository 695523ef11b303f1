"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every text gets counts (words, characters in words, symbols, repeated lines,
words in repeated 5-word windows). Cutoffs are not fixed: for each language and
source mergeable quantile sketches of four ratios (built in parts on the map
side and merged, so a hot source is no hot task) give the quartiles, and the
limits are FENCE interquartile ranges outside them. Groups of fewer than
LEAST_ROWS documents use the sketch of all documents. The limits are joined back
and filter. A floor on the width of the fence keeps ratios that hardly vary from
rejecting ordinary documents.

Null texts have no words. Texts without words fail the base rule. Repeated rows
are judged each. Null languages and sources are groups of their own. Empty
tables give empty results. Only the id, the text, the language and the source are
read, whatever other columns are named. Texts are judged whole: the work is linear in
their length but for sorting the windows of a text that repeats some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import cut
from graphloom.llm.text import SPACE

WINDOW = 5
SYMBOLS = r"[^#*$%&|<>]"
FENCE = 4.0
LEAST_ROWS = 50
SKETCH_ACCURACY = 2000
#: Ratio: the least distance of its limits from the quartiles.
RATIOS = {"mean_word": 1.0, "symbol_share": 0.05, "dup_line_share": 0.3, "repeat_share": 0.1}


def _base(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, SPACE), lambda w: w != "")
    df = docs.withColumn("_words", words)
    lines = F.filter(F.split(body, "\n"), lambda s: F.length(F.regexp_replace(s, SPACE, "")) > 0)
    n = F.size("_words")
    w = F.col("_words")
    windows = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))),
    )
    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.regexp_replace(body, SPACE, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(body, SYMBOLS, "")).cast("long"),
            "_lines": lines,
            "_windows": windows,
        }
    )
    df = df.withColumns({"n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "n_lines": F.size("_lines").cast("long")})
    # Only texts with a repeated window are sorted; their repeated positions then count the words they cover.
    marked = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_sorted", marked)
    s = F.col("_sorted")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    repeated = F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), x["i"]))
    df = df.withColumn("_at", F.array_sort(F.filter(repeated, lambda i: i.isNotNull())))
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def text_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the counts of each text, with the base rule's ``base_failed``."""
    df = _base(docs, text).select(*keep, *COUNTS)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def ratios() -> dict[str, Column]:
    """The four ratios that are judged; words or lines that are missing count as one."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {"mean_word": F.col("word_chars") / words, "symbol_share": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)), "dup_line_share": F.col("n_dup_lines") / lines, "repeat_share": F.col("n_repeat_words") / words}


def limits(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Limits of each ratio per group, from merged quantile sketches over the documents that pass the base rule."""
    judged = counts.filter(~F.col("base_failed")).withColumns(ratios())
    aggs = [F.count("*").alias("group_rows")]
    aggs += [F.percentile_approx(r, [0.25, 0.75], SKETCH_ACCURACY).alias(f"q_{r}") for r in RATIOS]
    out = judged.groupBy(*groups).agg(*aggs) if groups else judged.agg(*aggs)
    for r, least in RATIOS.items():
        low, high = F.col(f"q_{r}")[0], F.col(f"q_{r}")[1]
        width = F.greatest(FENCE * (high - low), F.lit(least))
        out = out.withColumn(f"lo_{r}", low - width).withColumn(f"hi_{r}", high + width).drop(f"q_{r}")
    return out


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, lang, source, counts, base_failed, kept): kept is false if the base rule or a limit of the group rejects."""
    counts = cut(text_counts(docs, [key, lang, source], text), "quality-counts")
    groups = limits(counts, [lang, source]).filter(F.col("group_rows") >= LEAST_ROWS)
    groups = groups.select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), *(F.col(c) for r in RATIOS for c in (f"lo_{r}", f"hi_{r}")))
    overall = limits(counts, []).first()
    joined = counts.withColumns(ratios()).join(groups, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left")
    within = F.lit(True)
    for r in RATIOS:
        within &= F.col(r).between(F.coalesce(f"lo_{r}", F.lit(overall[f"lo_{r}"])), F.coalesce(f"hi_{r}", F.lit(overall[f"hi_{r}"])))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False))).select(key, lang, source, *COUNTS, "base_failed", "kept")
