"""One query per operator over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, hard_negatives, lattice_lm, media, mixing, oracles, pieces, quality, secrets, simhash, spelling, substring_dedup, toxicity, warc


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(c) -> F.Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    docs = secrets.with_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"), out="s").drop("text")
    base = F.filter("s", lambda x: x["kind"] != "entropy")
    n = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    return docs.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), _sha(secrets.joined(base)).alias("base_sha256"), secrets.joined(F.col("s")).alias("spans"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated 35-word windows removed from every document."""
    kept = substring_dedup.drop_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", _sha(F.col("kept_text")).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subword-lattice and baseline scores of every document."""
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    return lattice_lm.score(_table(spark, sf_dir, "documents"), training, tokenizer())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot of every document in the mix of sources."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, "doc_id", "source").select("doc_id", "mix_source", "block_no", "release", "deadline", "slot")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to ids and decoded again."""
    both = bpe.with_ids(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", tokenizer(), "decoded")
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return warc.records(warc.read_chunks(manifest)).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def not_mod_5(key: str = "doc_id") -> F.Column:
    """Rows whose labels may be learnt from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), not_mod_5())
    scored = toxicity.tag(docs.select("doc_id", "text"), model)
    score = F.col("toxicity.score")
    return scored.select("doc_id", (~not_mod_5()).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.size("toxicity.spans").alias("n_spans"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a PNG image, read back and hashed."""
    stored = media.to_media(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "stored")
    return media.media_features(stored).select("doc_id", "stored.n_bytes", "read.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.judge(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, F.col("id") % 100 == 0)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to the ids of pieces and decoded again."""
    both = pieces.with_pieces(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", tokenizer("piece_bpe_32k.model"), "decoded")
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of the documents."""
    return spelling.variants(spelling.vocabulary(spelling.runs(_table(spark, sf_dir, "documents")))).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage but the pipeline."""
    found = (op1_secrets, op2_substring_dedup, op3_simhash, op4_lattice_lm, op5_mixing, op6_bpe, op7_warc, op8_toxicity, op9_media, op10_quality, op11_hard_negatives, op12_sentencepiece, op13_spelling)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op2_substring_dedup": oracles.OP2, "op5_mixing": oracles.OP5, "op7_warc": oracles.OP7, "op10_quality": oracles.op10(), "op11_hard_negatives": oracles.OP11, "op13_spelling": oracles.OP13}
