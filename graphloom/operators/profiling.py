"""Profiles of tables: completeness, histograms, token frequencies, cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as X


def completeness(df: DataFrame, columns: list[str], good: float, fair: float) -> DataFrame:
    """(field, non_null, missing, missing_rate, grade) of each column, in one pass. Blank strings are missing."""
    present = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    one = df.agg(F.count("*").alias("_n"), *(F.count_if(present(c)).alias(c) for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("non_null")) for c in columns)))
    rows = one.select("_n", pairs.alias("p")).select("p.field", "p.non_null", (F.col("_n") - F.col("p.non_null")).alias("missing"), "_n")
    rate = X.rounded(F.try_divide(F.col("missing") * 100.0, F.col("_n")), 2)
    rows = rows.withColumn("missing_rate", rate).drop("_n")
    return rows.withColumn("grade", F.when(F.col("missing_rate") < good, "good").when(F.col("missing_rate") < fair, "fair").otherwise("poor"))


def histogram(df: DataFrame, value: Column, edges: list[tuple[str, float | None, float | None]], none: str, none_if: Column) -> DataFrame:
    """(bucket, n): half-open buckets (label, low, high); rows for which ``none_if`` holds count as ``none``."""
    bucket = F.when(none_if, none)
    for label, low, high in edges:
        bucket = bucket.when((F.lit(True) if low is None else value >= low) & (F.lit(True) if high is None else value < high), label)
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def token_counts(df: DataFrame, column: str, pattern: str, top: int) -> DataFrame:
    """The ``top`` most frequent tokens of a delimited column."""
    tokens = df.select(F.explode(F.split(F.coalesce(column, F.lit("")), pattern)).alias("token")).filter(F.trim("token") != "")
    return tokens.groupBy(F.trim("token").alias("token")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(top)


def value_counts(df: DataFrame, column: str, unknown: str) -> DataFrame:
    """Counts of a column's values; null and blank count as ``unknown``."""
    return df.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(unknown)).alias("value")).agg(F.count("*").alias("n"))


def linkage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both, and those of the left that the right lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    marked = a.withColumn("_l", F.lit(1)).join(b.withColumn("_r", F.lit(1)), key, "full")
    return marked.agg(F.count("_l").alias("n_left"), F.count("_r").alias("n_right"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNull()).alias("left_only"))


def separator_estimate(df: DataFrame, columns: list[str], sep: str) -> DataFrame:
    """Upper bounds of the edges in delimited columns, by counting separators."""
    count = lambda c: F.sum(F.when(F.col(c) != "", F.length(c) - F.length(F.replace(c, F.lit(sep), F.lit(""))) + 1))
    return df.agg(*(F.coalesce(count(c), F.lit(0)).cast("long").alias(f"{c}_estimate") for c in columns))


def clean_movies(df: DataFrame) -> DataFrame:
    """Names, genres, regions, scores and blanks, cleaned in that order."""
    df = df.withColumn("name", F.trim("name")).withColumn("genres", X.clean_slashes(F.col("genres"), True)).withColumn("region", X.clean_slashes(F.col("region"), False))
    df = df.withColumn("score", X.zero_to_null(F.col("score"))).withColumn("votes", X.zero_to_null(F.col("votes")))
    return df.withColumns({c: X.blank_to_null(F.col(c)) for c in ("name", "genres", "region", "content_type")})


def malformed(df: DataFrame, column: str, mark: str = ":", samples: int = 5) -> DataFrame:
    """Rows whose non-blank column lacks ``mark``: their number and the least ``samples`` values."""
    bad = df.filter(F.col(column).isNotNull() & (F.col(column) != "") & ~F.contains(F.col(column), F.lit(mark)))
    least = bad.select(column).distinct().orderBy(column).limit(samples).agg(F.array_sort(F.collect_list(column)).alias("samples"))
    return bad.agg(F.count("*").alias("n_bad")).withColumn("samples", least.scalar())


def summary(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Counts of rows for which each condition holds, in one pass."""
    return df.agg(*(F.count_if(c).alias(k) for k, c in flags.items()))


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Union of frames by column name."""
    return reduce(DataFrame.unionByName, frames)


def blank(c: Column) -> Column:
    """Whether a value is null or the empty string."""
    return c.isNull() | (c == "")


def incomplete_films(films: DataFrame, least_votes: int = 50) -> DataFrame:
    """Rated films with enough votes whose cover or storyline is blank."""
    return films.filter(F.col("score").isNotNull() & (F.col("votes") >= least_votes) & (blank(F.col("cover")) | blank(F.col("storyline"))))


def incomplete_persons(persons: DataFrame) -> DataFrame:
    """Persons of whom sex, birthplace, profession and biography are all blank."""
    return persons.filter(blank(F.col("sex")) & blank(F.col("birthplace")) & blank(F.col("profession")) & blank(F.col("biography")))


def progress(days: DataFrame, goal: Column) -> DataFrame:
    """(day, done, added, rate, days_left) from (day, n): totals so far, the change since the last snapshot, items a day, and the days to reach ``goal`` at that rate (null: never)."""
    w = Window.orderBy("day")  # one row per snapshot
    total = days.withColumn("done", F.sum("n").over(w)).withColumn("last", F.lag("day").over(w))
    added = F.col("done") - F.lag("done").over(w)
    rows = total.withColumn("added", added).withColumn("rate", F.floor(F.col("added") / F.date_diff("day", "last") * 100.0 + 0.5) / 100.0)
    left = F.when(F.col("rate") > 0, F.ceil(F.greatest(goal - F.col("done"), F.lit(0)) / F.col("rate")).cast("long"))
    return rows.select("day", "done", "added", "rate", left.alias("days_left"))
