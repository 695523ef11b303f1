"""Two-phase title search: a phrase first, tokens if it hits nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.segment import query_words
from graphloom.sources.scratch import settled


def tokens(q: str) -> list[str]:
    """Query tokens of two or more characters; runs of Han characters as bigrams."""
    import re

    out: list[str] = []
    for run in re.findall(r"[㐀-鿿]+|[^\W㐀-鿿]+", q.lower()):
        out += [run[i : i + 2] for i in range(len(run) - 1)] if re.match(r"[㐀-鿿]", run) else [run]
    return [t for t in dict.fromkeys(out) if len(t) > 1]


def phrase(columns: list[str], q: str) -> Column:
    """Rows in which a column has the whole query, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit |= F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q.lower()))
    return hit


def search(df: DataFrame, columns: list[str], q: str, words: DataFrame | None = None) -> DataFrame:
    """Rows with the phrase; if there is none, rows in one of whose columns all tokens occur (of Han text the words of a dictionary, if given).

    The table is read once: rows that match either way are written, then told apart.
    """
    parts, loose = tokens(q) if words is None else query_words(words, q), F.lit(False)
    for c in columns:
        every = F.lit(bool(parts))
        for t in parts:
            every &= F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t))
        loose |= every
    flag = "exact"
    while flag in df.columns:
        flag = f"_{flag}"
    hits = settled(df.withColumn(flag, phrase(columns, q)).filter(F.col(flag) | loose), "hits")
    exact = hits.filter(flag)
    return (exact if exact.limit(1).count() else hits).drop(flag)
