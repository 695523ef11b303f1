"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's documents, in the order of a hash of their id, are cut into blocks
of ``block`` documents. A source of weight w/Q releases its block j (from 1) at
slot floor((j-1)*Q/w) and must have it placed before slot ceil(j*Q/w).
Earliest deadline first (ties: later group deadline by larger weight, then
source) fills each slot with one released block. The weights sum to Q, so the
schedule repeats every Q slots; one period of Q slots is computed with an SQL
fold and joined to the blocks. Up to every slot t each source that still has
blocks has had floor or ceil of t*w/Q of them: a deviation of less than one
block.

A source that has run out leaves its slots empty; the rest keep their relative
weights. No row is dropped or repeated. Sources without a target weight (null is
a source of its own, named '') get the least weight, 1. More than MAX_SOURCES
sources raise an error before any list of them is made, which bounds the tables of
weights and slots that are broadcast.

Rows are in the order of the hash of their id, rows of one id in that of a hash of
all their columns. Block numbers come from prefix sums: over the ids of a hash bucket
(an id that many rows share is counted in parts, by the hash of their columns), over
buckets, and over groups of buckets. So no task holds a whole source, or all rows of a
missing or repeated id.

Empty tables give empty results; repeated rows are kept. Extra columns of any type
pass through, whatever they are named.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.store import cut, hashable

PERIOD = 1000
BLOCK = 4
MAX_SOURCES = 5000
#: Rows that a window of one bucket should hold at most, on average.
BUCKET_ROWS = 256
ADDED = ("mix_source", "block_no", "release", "deadline", "slot")


def source_counts(docs: DataFrame, source: str) -> DataFrame:
    """(mix_source, n) of at most MAX_SOURCES sources; more raise an error."""
    counts = cut(docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("mix_source")).agg(F.count("*").alias("n")), "source-counts")
    n = counts.count()
    if n > MAX_SOURCES:
        raise ValueError(f"{n} sources; at most {MAX_SOURCES} are provided for")
    return counts


def count_weights(counts: DataFrame, period: int = PERIOD) -> DataFrame:
    """Integer target weights (mix_source, weight) in proportion to the square root of the sources' sizes (mix_source, n), summing to ``period``.

    Largest remainders round them; each is at least 1. With more than half as many
    sources the period is twice their number.
    """
    packed = counts.agg(F.array_sort(F.collect_list(F.struct("mix_source", "n"))).alias("all"))  # at most MAX_SOURCES
    packed = packed.filter(F.size("all") > 0).withColumn("period", F.greatest(F.lit(period), 2 * F.size("all")))
    roots = F.transform("all", lambda s: F.floor(F.sqrt(s["n"].cast("double")) * 1000).cast("long"))
    packed = packed.withColumn("roots", roots).withColumn("total", F.aggregate("roots", F.lit(0).cast("long"), lambda a, x: a + x))
    spare = F.col("period") - F.size("all")
    packed = packed.withColumn("whole", F.transform("roots", lambda r: F.expr("1L") + F.floor(r * spare / F.col("total")).cast("long")))
    left = F.col("period") - F.aggregate("whole", F.lit(0).cast("long"), lambda a, x: a + x)
    packed = packed.withColumn("left", left)
    rest = F.transform("roots", lambda r, i: F.struct(((r * spare) % F.col("total")).alias("r"), (-i).alias("i")))
    packed = packed.withColumn("ranked", F.reverse(F.array_sort(rest)))
    lucky = F.slice("ranked", 1, F.greatest(F.col("left"), F.lit(0)).cast("int"))
    packed = packed.withColumn("lucky", F.transform(lucky, lambda x: -x["i"]))
    rows = packed.select(F.posexplode("all").alias("i", "s"), "whole", "lucky")
    return rows.select(F.col("s")["mix_source"].alias("mix_source"), (F.get("whole", F.col("i")) + F.array_contains("lucky", F.col("i")).cast("long")).alias("weight"))


def period_slots(weights: DataFrame) -> DataFrame:
    """(mix_source, weight, period, turn, turn_slot): the slot within a period of each source's turn-th block, by earliest deadline first."""
    one = weights.agg(F.array_sort(F.collect_list(F.struct("mix_source", F.col("weight").cast("long").alias("weight")))).alias("s"))
    one = one.withColumn("period", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["weight"]))
    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("placed"), F.expr("cast(array() as array<int>)").alias("chosen"))
    choose = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("period") - 1), start, _place)
    one = one.filter(F.size("s") > 0).withColumn("chosen", choose["chosen"])
    turns = one.select("s", "period", F.posexplode("chosen").alias("turn_slot", "i"))
    turns = turns.select(F.get("s", F.col("i"))["mix_source"].alias("mix_source"), F.get("s", F.col("i"))["weight"].alias("weight"), "period", F.col("turn_slot").cast("long").alias("turn_slot"))
    return turns.withColumn("turn", F.row_number().over(Window.partitionBy("mix_source").orderBy("turn_slot")).cast("long") - 1)


def _place(state, t):
    """One slot: of the released blocks the one with the least (deadline, -weight, source) is placed."""
    open_ = F.transform(
        F.col("s"),
        lambda x, i: F.when(
            (F.get(state["placed"], i) < x["weight"]) & (F.floor(F.get(state["placed"], i) * F.col("period") / x["weight"]) <= t),
            F.struct(F.ceil((F.get(state["placed"], i) + 1) * F.col("period") / x["weight"]).alias("d"), (-x["weight"]).alias("w"), i.alias("i")),
        ),
    )
    best = F.array_min(open_)["i"]
    return F.struct(
        F.transform(state["placed"], lambda n, i: n + (i == best).cast("long")).alias("placed"),
        F.concat(state["chosen"], F.array(best)).alias("chosen"),
    )


def _before(counts: DataFrame, groups: list[str], order: list[str], n: str = "n"):
    """The sum of ``n`` over the earlier rows of the same groups."""
    within = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(within), F.lit(0))


def mix(docs: DataFrame, key: str, source: str, weights: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``docs`` with the columns ADDED: each row's source, block, release, deadline and slot.

    ``weights`` has (mix_source, weight) with integer weights; by default those of
    count_weights. A column of ``docs`` named as one of ADDED is replaced.
    """
    docs = docs.drop(*(c for c in ADDED if c not in (key, source)))
    sources = source_counts(docs, source)
    if weights is None:
        weights = count_weights(sources)
    total = sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    weights = sources.select("mix_source").join(weights, "mix_source", "left").select("mix_source", F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)).alias("weight"))
    upper = max(1, math.isqrt(math.ceil(total / BUCKET_ROWS)))
    parts = max(1, math.isqrt(total))
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    # The row travels as one struct, so that none of its columns clashes with those below.
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.coalesce(F.col(source), F.lit("")).alias("mix_source"), digest.alias("mix_hash"), F.xxhash64(*hashable(docs)).alias("mix_tie"))
    part = F.floor((F.shiftright("mix_tie", 32) + F.lit(1 << 31)) * parts / F.lit(1 << 32)).cast("int")
    rows = rows.withColumn("mix_part", part)
    # An id's parts, each at most a few rows unless rows are repeated; ids of a bucket; buckets of a group.
    each = rows.groupBy("mix_source", "mix_hash", "mix_part").agg(F.count("*").alias("n"))
    bucket = F.floor(F.conv(F.substring("mix_hash", 1, 8), 16, 10).cast("long") * (upper * upper) / F.lit(1 << 32)).cast("long")
    each = each.withColumn("mix_bucket", bucket).withColumn("before", _before(each, ["mix_source", "mix_bucket"], ["mix_hash", "mix_part"]))
    counts = each.groupBy("mix_source", "mix_bucket").agg(F.sum("n").alias("n")).withColumn("mix_upper", F.floor(F.col("mix_bucket") / upper))
    uppers = counts.groupBy("mix_source", "mix_upper").agg(F.sum("n").alias("n"))
    uppers = uppers.select("mix_source", "mix_upper", _before(uppers, ["mix_source"], ["mix_upper"]).alias("before_upper"))
    counts = counts.withColumn("before_bucket", _before(counts, ["mix_source", "mix_upper"], ["mix_bucket"]))
    starts = counts.join(uppers, ["mix_source", "mix_upper"]).select("mix_source", "mix_bucket", (F.col("before_bucket") + F.col("before_upper")).alias("start"))
    each = each.join(starts, ["mix_source", "mix_bucket"]).select("mix_source", "mix_hash", "mix_part", (F.col("before") + F.col("start")).alias("start"))
    order = Window.partitionBy("mix_source", "mix_hash", "mix_part").orderBy("mix_tie")
    rows = rows.withColumn("mix_row", F.row_number().over(order)).join(each, ["mix_source", "mix_hash", "mix_part"])
    rows = rows.withColumn("block_no", F.floor((F.col("start") + F.col("mix_row") - 1) / block).cast("long") + 1)
    plan = period_slots(weights)
    joined = rows.join(F.broadcast(weights.withColumnRenamed("weight", "mix_weight")), "mix_source").withColumn("turn", F.pmod(F.col("block_no") - 1, F.col("mix_weight")))
    joined = joined.join(F.broadcast(plan), ["mix_source", "turn"])
    cycle = F.floor((F.col("block_no") - 1) / F.col("weight"))
    release = F.floor((F.col("block_no") - 1) * F.col("period") / F.col("weight"))
    deadline = F.ceil(F.col("block_no") * F.col("period") / F.col("weight"))
    out = joined.withColumns({"release": release, "deadline": deadline, "slot": cycle * F.col("period") + F.col("turn_slot")})
    return out.select("row.*", *ADDED)


def in_mixed_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows sorted by slot, as a range-partitioned sort: written files follow the schedule."""
    return mixed.orderBy("slot", *columns[:1]).select(*columns)
