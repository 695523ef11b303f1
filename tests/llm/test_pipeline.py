"""The pipeline's rows as they leave it."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from graphloom.llm import mixing


def test_rows_keep_their_place_in_the_mix(spark, tmp_path):
    """The slots of the rows that were written in several files and read again are those of the mix."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: r.slot for r in mixing.mix(docs, "doc_id", "source").collect()}
    P.mix_sources(spark, docs, None).repartition(5).write.parquet(f"{tmp_path}/mixed")
    out = P.encode(spark, spark.read.parquet(f"{tmp_path}/mixed"), None)
    assert {r.doc_id: r.slot for r in out.select("doc_id", "slot").collect()} == want
    assert P.run(spark, "/root/testdata/sf0.001").filter(F.col("slot").isNull()).count() == 0


def test_rows_of_a_repeated_id_are_judged_by_their_texts(spark):
    rng = random.Random(23)
    one, two, three = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(3))
    rows = [(1, one, "a"), (2, one, "a"), (2, two, "a"), (3, two + " end", "a"), (4, three, "a"), (4, three, "a"), (5, three, "a"), (None, one, "a"), (None, one, "a"), (6, None, "a"), (7, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = P.drop_near_duplicates(spark, docs, None)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, one), (2, two), (4, three), (None, one), (None, one), (6, None)], key=repr)


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, clashing names and empty tables."""
    names = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, slot long, row string, doc string, id long, tie long, mix_source string, block_no long, m map<string,int>"
    one = (1, "some words of a text", "en", "a", 20, "t", 5, "r", "d", 9, 8, "s", 7, {"k": 1})
    rows = [one, one, (None, *one[1:]), (2, None, *one[2:]), (3, "", None, None, None, None, None, None, None, None, None, None, None, None), (1, "other words", *one[2:])]
    spark.createDataFrame([(1, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, names)
    for table, counts in ((docs, {"toxicity": 6, "near_dedup": 4, "secrets": 6, "mixing": 6, "bpe": 6}), (docs.limit(0), dict.fromkeys(dict(P.STAGES), 0))):
        for name, stage in P.STAGES:
            out = stage(spark, table, str(tmp_path))
            assert out.count() == counts[name], name
            assert name == "bpe" or out.schema.simpleString() == docs.schema.simpleString()
    mixed = P.mix_sources(spark, docs, str(tmp_path))
    assert sorted((repr(r.asDict()) for r in mixed.collect())) == sorted(repr(r.asDict()) for r in docs.collect())
    P.drop_near_duplicates(spark, docs.drop("n_chars"), str(tmp_path)).count()
    assert P.mask_secrets(spark, docs.drop("n_chars"), str(tmp_path)).columns == docs.drop("n_chars").columns
