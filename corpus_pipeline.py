"""A corpus pipeline of five of the operators, each stage written and read again.

Stages: documents scored as toxic go; of each group of near-duplicates (five-word
shingles, a similarity of 0.8 or more) the row with the smallest id stays; secrets are replaced by a mark; the rest is put in the order
of the mix of sources; every document is encoded and decoded, and carries its slot in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, jaccard, mixing, secrets, toxicity
from graphloom.llm.queries import not_mod_5, tokenizer
from graphloom.llm.store import cut, hashable

#: Near-duplicates of this stage: five-word shingles and Jaccard similarity.
SHINGLE, SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity operator doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = "toxicity"
    while out in docs.columns:
        out = f"_{out}"
    scored = toxicity.tag(docs, toxicity.fit(docs, labels, not_mod_5()), out=out)
    return scored.filter(F.col(f"{out}.score") < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one with the smallest id, then text hash. Rows without an id stay; of repeated rows of id and text one stays."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text"), F.xxhash64(*hashable(docs)).alias("tie"))
    found = cut(jaccard.groups(keyed.select(F.col("id").alias("doc_id"), "row", "text"), SHINGLE, SIMILARITY).filter("doc_id IS NOT NULL"), "groups")
    first = cut(found.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first")), "first")
    marked = found.join(first, "root").select(F.col("doc_id").alias("id"), "row", (F.struct("doc_id", "row") != F.col("first")).alias("gone"))
    marked = marked.groupBy("id", "row").agg(F.max("gone").alias("gone"), F.count("*").alias("n")).filter("gone OR n > 1")
    marked = cut(marked, "marked")
    once = keyed.join(marked, ["id", "row"], "left_anti")
    again = keyed.join(cut(marked.filter("NOT gone").select("id", "row"), "repeated"), ["id", "row"], "left_semi").groupBy("id", "row").agg(F.min_by("doc", "tie").alias("doc"))
    return once.select("doc.*").union(again.select("doc.*"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret masked and their lengths brought up to date."""
    masked = secrets.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted by their slots in the mix of sources."""
    whole = docs.select("doc_id", "source", F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"))
    return mixing.in_mixed_order(mixing.mix(whole, "doc_id", "source"), ["doc_id", "doc"]).select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed ids of every document, with digests of them and of the text decoded from them, and its slot in the mix.

    A table that is read again has no order, so the slot is made anew: it follows
    from the documents alone.
    """
    placed = mixing.mix(docs.select("doc_id", "source", "text"), "doc_id", "source").select("doc_id", "text", "slot")
    both = bpe.with_ids(placed, "text", tokenizer(), "decoded")
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), "slot")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("secrets", mask_secrets), ("mixing", mix_sources), ("bpe", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
