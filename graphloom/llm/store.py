"""Tables between the steps of an operator, in the folder that all executors share (see sources.scratch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.scratch import fresh_path, settled, shared_dir

__all__ = ["cut", "fresh_path", "hashable", "shared_dir"]


def hashable(df: DataFrame) -> list[Column]:
    """The columns of ``df`` in a form that can be hashed: those that hold maps or variants as JSON."""
    return [F.to_json(F.struct(df[f"`{f.name}`"])) if any(x in f.dataType.simpleString() for x in ("map<", "variant")) else df[f"`{f.name}`"] for f in df.schema]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back from there."""
    return settled(df, name)
