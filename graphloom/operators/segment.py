"""Words of text that has no spaces, by the most probable path over a dictionary.

Every substring that is a dictionary word is an edge of the text's lattice; an edge costs
the word's negative log-probability in whole millionths, a character that begins no
word on the path costs more than any word. The cheapest path is the segmentation, ties
by fewer words, then by the word that begins last. Search mode adds the shorter
dictionary words inside each word of the path, as a search for a part should find it.

The dictionary is a table and is joined, so its size is not bounded by a task; texts are
titles and queries, whose lattices are small.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MICRO = 1_000_000
#: The longest word in characters, and what an unknown character costs.
LONGEST, UNKNOWN = 16, 30 * MICRO


def dictionary(tokens: DataFrame, word: str = "word") -> DataFrame:
    """(word, cost) of a table with a row per occurrence: words of at most LONGEST characters."""
    counted = tokens.filter(F.char_length(word).between(1, LONGEST)).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("all"))
    return counted.select("word", F.floor(F.ln(total.scalar() / F.col("n")) * MICRO + 0.5).cast("long").alias("cost"))


def segment(runs: DataFrame, words: DataFrame, run: str = "run") -> DataFrame:
    """(run, words) of the distinct non-empty texts of a column: the cheapest path over the dictionary (word, cost)."""
    texts = runs.select(F.col(run).alias("run")).filter(F.char_length("run") > 0).distinct()
    starts = texts.withColumn("at", F.explode(F.sequence(F.lit(1), F.char_length("run"))))
    parts = starts.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.char_length("run") - F.col("at") + 1)))).withColumn("word", F.substring("run", F.col("at"), F.col("size")))
    edges = parts.join(words.select("word", "cost"), "word", "left").filter("cost IS NOT NULL OR size = 1")
    edge = F.struct("at", "size", F.coalesce("cost", F.lit(UNKNOWN)).alias("cost"))
    lattice = edges.groupBy("run").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    # best[k]: (cost, words, -begin) of the cheapest path to the k-th character; edges come by their beginning, so best[at] is final.
    state = "struct<cost:bigint,n:int,back:int>"
    zero = F.transform(F.sequence(F.lit(0), F.char_length("run")), lambda k: F.when(k == 0, F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit(0).alias("n"), F.lit(0).alias("back"))).otherwise(F.lit(None).cast(state)))

    def relax(best, e):
        here = F.get(best, e["at"] - 1)
        to = F.struct((here["cost"] + e["cost"]).alias("cost"), (here["n"] + 1).alias("n"), (-(e["at"] - 1)).alias("back"))
        return F.transform(best, lambda old, k: F.when(k == e["at"] - 1 + e["size"], F.when(old.isNull() | (to < old), to).otherwise(old)).otherwise(old))

    solved = lattice.select("run", F.aggregate("edges", zero, relax).alias("best"))
    size = F.char_length("run")
    back = F.aggregate(F.sequence(F.lit(1), size), F.array(size), lambda ends, _: F.when(F.element_at(ends, -1) > 0, F.concat(ends, F.array(-F.get(F.col("best"), F.element_at(ends, -1))["back"]))).otherwise(ends))
    cuts = solved.select("run", F.reverse(back).alias("cuts"))
    return cuts.select("run", F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.substring("run", F.get("cuts", i) + 1, F.get("cuts", i + 1) - F.get("cuts", i))).alias("words"))


def search_words(segmented: DataFrame, words: DataFrame, least: int = 2) -> DataFrame:
    """(run, word): the words of each path of ``least`` characters or more, and the shorter dictionary words of so many inside them."""
    whole = segmented.select("run", F.explode("words").alias("word")).filter(F.char_length("word") >= least).distinct()
    inside = whole.withColumn("at", F.explode(F.sequence(F.lit(1), F.char_length("word") - least + 1)))
    inside = inside.withColumn("size", F.explode(F.sequence(F.lit(least), F.char_length("word") - F.col("at") + 1))).filter(F.col("size") < F.char_length("word"))
    parts = inside.select("run", F.substring("word", F.col("at"), F.col("size")).alias("word")).distinct().join(words.select("word"), "word", "left_semi")
    return whole.union(parts.select("run", "word")).distinct()


def query_words(words: DataFrame, q: str) -> list[str]:
    """The search words of one query: letters and digits of other scripts by their own runs, runs of Han characters by the dictionary."""
    runs = re.findall(r"[㐀-鿿]+|[^\W㐀-鿿]+", q.lower())
    han = [r for r in runs if "㐀" <= r[0] <= "鿿"]
    found: dict[str, list[str]] = {}
    if han:
        table = words.sparkSession.createDataFrame([(r,) for r in dict.fromkeys(han)], "run string")
        for r in search_words(segment(table, words), words).collect():
            found.setdefault(r.run, []).append(r.word)
    out = [w for r in runs for w in (sorted(found.get(r, [])) if r in han else [r])]
    return [w for w in dict.fromkeys(out) if len(w) > 1]
