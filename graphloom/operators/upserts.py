"""Changes to tables that are written anew: upserts, syncs, deletes, status changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both, the new one where keys are equal; of several new rows the latest by ``order``."""
    ranked = new.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_k = 1").drop("_k")
    return old.join(ranked, keys, "left_anti").unionByName(ranked)


def delete(old: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose keys are not in ``keys``."""
    return old.join(keys, keys.columns, "left_anti")


def sync(old: DataFrame, incoming: DataFrame, owner: str, keys: list[str]) -> DataFrame:
    """Owners that come in have exactly the incoming rows; the others keep theirs."""
    return old.join(incoming.select(owner).distinct(), owner, "left_anti").unionByName(incoming.dropDuplicates(keys))


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key isn't there."""
    return new.dropDuplicates([key]).join(old, key, "left_anti")


def save_actions(old: DataFrame, new: DataFrame, key: str, may_update: bool) -> DataFrame:
    """(key, action): inserted, updated, skipped or kept."""
    both = old.select(key, F.lit(1).alias("_o")).join(new.select(key, F.lit(1).alias("_n")), key, "full")
    action = F.when(F.col("_o").isNull(), "inserted").when(F.col("_n").isNull(), "kept").otherwise("updated" if may_update else "skipped")
    return both.select(key, action.alias("action"))


def claim(tasks: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The ``n`` open tasks with the highest ids, as claimed."""
    return tasks.filter("status = 0").orderBy(F.desc(key)).limit(n).withColumn("status", F.lit(1))


def claim_one(tasks: DataFrame, wanted: Column, key: str = "id") -> DataFrame:
    """All tasks, the wanted one claimed if it is still open; ``claimed`` marks it."""
    hit = F.coalesce((F.col(key) == wanted) & (F.col("status") == 0), F.lit(False))
    return tasks.withColumn("claimed", hit).withColumn("status", F.when(hit, 1).otherwise(F.col("status")))


def release_stale(tasks: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Claims older than some minutes are open again."""
    stale = (F.col("status") == 1) & (F.col("locked_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return tasks.withColumn("status", F.when(stale, 0).otherwise(F.col("status"))).withColumn("locked_at", F.when(~stale, F.col("locked_at")))


def reopen(tasks: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """All tasks; those with a key in ``keys`` are open again, whatever their status."""
    marks = keys.select(F.col(keys.columns[0]).alias(key), F.lit(True).alias("_again")).distinct()
    return tasks.join(marks, key, "left").withColumn("status", F.when(F.col("_again"), 0).otherwise(F.col("status"))).drop("_again")


def finish(tasks: DataFrame, done: DataFrame, failed: DataFrame, key: str = "id") -> DataFrame:
    """Claimed tasks become done (2) or failed (3); failure wins."""
    marks = done.select(key, F.lit(2).alias("_m")).union(failed.select(key, F.lit(3))).groupBy(key).agg(F.max("_m").alias("_m"))
    return tasks.join(marks, key, "left").withColumn("status", F.when(F.col("status") == 1, F.coalesce("_m", "status")).otherwise(F.col("status"))).drop("_m")
