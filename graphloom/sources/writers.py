"""Writers: node and edge tables, embeddings, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest row of each key, and ``_n``, how many rows the key has."""
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.min(F.struct(*rest) if rest else F.lit(0)).alias("_row"), F.count("*").alias("_n"))
    return grouped.select(*keys, *(F.col("_row")[c].alias(c) for c in rest), "_n")


def write_nodes(nodes: DataFrame, key: str, path: str) -> dict[str, int]:
    """A node table with one row per key; what came in and what was written, counted in the pass that writes.

    Of repeated keys the smallest row is kept; null keys are left out. ``rows`` is
    ``written + duplicates + nulls``. The counts are taken after the last shuffle, where
    a task that is run again counts once. Columns must be orderable; ``_n`` and ``_row``
    are taken.
    """
    seen, known = Observation(), F.col(key).isNotNull()
    n = {"rows": F.col("_n"), "nulls": F.when(~known, F.col("_n")), "written": F.when(known, 1), "duplicates": F.when(known, F.col("_n") - 1)}
    counted = one_per_key(nodes, [key]).observe(seen, *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in n.items()))
    counted.filter(known).drop("_n").write.mode("overwrite").parquet(path)
    return dict(seen.get)


def write_edges(edges: DataFrame, keys: list[str], path: str, ends: dict[str, DataFrame], relations: list[str]) -> dict[str, dict[str, int]]:
    """An edge table partitioned by its column ``rel`` with one row per key and no loose ends; counts per relation.

    ``ends`` maps an edge column to a frame with that column, the keys of the nodes there.
    For each of ``relations`` (a few names; other edges are written, too) the counts are
    rows, duplicates, ``missing_<column>`` (keys without a node at that end, null included)
    and written, taken in the pass that writes, as in ``write_nodes``.
    """
    seen, checked = Observation(), one_per_key(edges, keys)
    for column, nodes in ends.items():
        checked = checked.join(nodes.select(column, F.lit(True).alias(f"_has_{column}")).distinct(), column, "left")
    has = {column: F.coalesce(f"_has_{column}", F.lit(False)) for column in ends}
    valid = F.lit(True)
    for flag in has.values():
        valid = valid & flag
    n = {"rows": F.col("_n"), "duplicates": F.col("_n") - 1, **{f"missing_{c}": (~flag).cast("long") for c, flag in has.items()}, "written": valid.cast("long")}
    metrics = [F.coalesce(F.sum(F.when(F.col("rel") == r, c)), F.lit(0)).cast("long").alias(f"{i}:{k}") for i, r in enumerate(relations) for k, c in n.items()]
    checked = checked.observe(seen, *metrics) if metrics else checked
    checked.filter(valid).select(*edges.columns).write.mode("overwrite").partitionBy("rel").parquet(path)
    found = seen.get if metrics else {}
    return {r: {k: found[f"{i}:{k}"] for k in n} for i, r in enumerate(relations)}


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that come more than once: what a uniqueness constraint would refuse."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def report_suffix(chosen: list[str], all_names: list[str], negatives: int, usual: int = 499) -> str:
    """What tells a report's name apart: the algorithms if not all, the number of negatives if not the usual one."""
    parts = [*(chosen if chosen and chosen != all_names else []), *([f"neg{negatives}"] if negatives != usual else [])]
    return "_" + "_".join(parts) if parts else ""


def next_free(spark: SparkSession, path: str) -> str:
    """``path``, or with the first number behind its name that is not taken."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found, number = path, 0
    while fs.exists(hadoop(found)):
        number += 1
        found = f"{path}_{number}"
    return found


def write_report(main: DataFrame, legacy: DataFrame, folder: str, stamp: str, suffix: str = "") -> list[str]:
    """The paths of the current report and its legacy form, overwritten, and of copies of both under ``history`` that overwrite nothing.

    Each is a folder with one file of JSON lines; reports are small.
    """
    spark, name = main.sparkSession, f"eval_results{suffix}"
    old = "eval_results_legacy" if not suffix else f"{name}_legacy"
    paths = []
    for df, base in ((main, name), (legacy, old)):
        for path, mode in ((f"{folder}/{base}", "overwrite"), (next_free(spark, f"{folder}/history/{stamp}_{base}"), "error")):
            df.coalesce(1).write.mode(mode).json(path)
            paths.append(path)
    return paths


def markdown_report(title: str, sections: dict[str, DataFrame], most: int = 1000) -> str:
    """A whole report: a heading and a table of at most ``most`` rows for each small result."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown_table(df, most)}" for name, df in sections.items())]) + "\n"


def markdown_table(metrics: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a small result (at most ``most`` rows)."""
    rows = metrics.limit(most).collect()
    lines = ["| " + " | ".join(metrics.columns) + " |", "|" + "---|" * len(metrics.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
