"""Checks while writing, locks that open without a further event, and landed feeds."""

import datetime as dt

from pyspark.sql import functions as F

from graphloom.operators import cohort
from graphloom.sources import readers, writers
from graphloom.streaming import expiry

SCHEMA = "id string, ts timestamp, finished boolean, extra int"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def run(spark, tmp_path, batches, name):
    """The ends of locks from files that are taken one at a time."""
    source = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source / f"p{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    got = expiry.run_available(expiry.lock_ends(stream, "10 minutes"), name)
    minute = lambda c: ((F.unix_micros(c) - F.unix_micros(F.lit(at(0)))) / 60_000_000).cast("int")
    return sorted(tuple(r) for r in got.select("id", minute("claimed_at"), minute("ended_at"), "reason").collect())


def test_a_lock_opens_without_a_further_event(spark, tmp_path):
    first = [("a", at(0), False, 1), ("b", at(1), False, 1), ("c", at(2), False, 1), (None, at(2), False, 1), ("n", None, False, 1), ("e", at(3), True, 1)]
    second = [("b", at(20), True, 1), ("c", at(25), False, 1)]
    third = [("z", at(60), False, 1)]
    assert run(spark, tmp_path, [first, second, third], "locks") == [("a", 0, 30, "expired"), ("b", 1, 20, "finished")]
    fourth = [("y", at(300), True, 1)]
    assert run(spark, tmp_path, [first, second, third, fourth], "longer") == [("a", 0, 30, "expired"), ("b", 1, 20, "finished"), ("c", 25, 55, "expired"), ("z", 60, 90, "expired")]


def test_locks_inside_one_batch(spark, tmp_path):
    rows = [("a", at(100), True, 1), ("a", at(40), False, 1), ("a", at(0), False, 1), ("a", at(40), False, 1), ("b", at(0), False, 1), ("b", at(30), True, 1), ("c", at(5), False, 1), ("c", at(5), True, 1)]
    assert run(spark, tmp_path, [rows], "one") == [("a", 0, 30, "expired"), ("a", 40, 70, "expired"), ("b", 0, 30, "finished"), ("c", 5, 5, "finished")]
    assert run(spark, tmp_path, [[]], "none") == []


def test_nodes_are_counted_while_written(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("b", 1, "y"), (None, 1, "z"), (None, 1, "z")], "k string, v int, n string")
    assert writers.write_nodes(nodes, "k", str(tmp_path / "nodes")) == {"rows": 5, "nulls": 2, "written": 2, "duplicates": 1}
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "nodes")).collect())) == [("a", 1, "x"), ("b", 1, "y")]
    assert writers.write_nodes(nodes.limit(0), "k", str(tmp_path / "empty")) == {"rows": 0, "nulls": 0, "written": 0, "duplicates": 0}
    assert writers.write_nodes(nodes.select("k"), "k", str(tmp_path / "keys"))["written"] == 2


def test_edges_are_checked_while_written(spark, tmp_path):
    edges = spark.createDataFrame([("r", "a", "x", 1), ("r", "a", "x", 0), ("r", "a", "gone", 1), ("r", None, "x", 1), ("s", "gone", "gone", 1), ("other", "a", "x", 5)], "rel string, h string, t string, w int")
    ends = {"h": spark.createDataFrame([("a",), ("a",), ("b",)], "h string"), "t": spark.createDataFrame([("x", 1)], "t string, w int")}
    got = writers.write_edges(edges, ["rel", "h", "t"], str(tmp_path / "edges"), ends, ["r", "s", "none"])
    assert got == {
        "r": {"rows": 4, "duplicates": 1, "missing_h": 1, "missing_t": 1, "written": 1},
        "s": {"rows": 1, "duplicates": 0, "missing_h": 1, "missing_t": 1, "written": 0},
        "none": {"rows": 0, "duplicates": 0, "missing_h": 0, "missing_t": 0, "written": 0},
    }
    back = spark.read.parquet(str(tmp_path / "edges")).select("rel", "h", "t", "w")
    assert sorted(map(tuple, back.collect())) == [("other", "a", "x", 5), ("r", "a", "x", 0)]


def test_landed_feeds_in_batch_and_as_a_stream(spark, tmp_path):
    row = '<item><title>{0}</title><link>https://e.org/subject/{1}/</link><description><![CDATA[<p>备注: {2} & more</p>]]></description><pubDate>Tue, 3 Mar 2020 20:00:00 GMT</pubDate><guid isPermaLink="false">g{1}</guid></item>'
    rows = [("看过 A", 7, "good"), ("想看 B", 8, "x" * 100_000), ("other", 9, "")]
    for name, part in (("ann", rows), ("bob", rows[:1]), ("empty", [])):
        (tmp_path / f"{name}.xml").write_text('<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"><channel><title>t</title>' + "\n".join(row.format(*r) for r in part) + "</channel></rss>")
    slug = F.regexp_extract("file", r"^(.*)\.xml$", 1)
    batch = cohort.landed_feed_items(readers.feed_rows(spark, str(tmp_path)).withColumn("slug", slug))
    whole = cohort.feed_items(readers.xml_feeds(spark, str(tmp_path), slug))
    got = sorted(map(tuple, batch.collect()), key=repr)
    assert [(r[0], r[1], r[2]) for r in got] == [("ann", "7", "collect"), ("ann", "8", "wish"), ("bob", "7", "collect")]
    assert got == sorted(map(tuple, whole.collect()), key=repr)
    stream = cohort.landed_feed_items(readers.feed_rows(spark, str(tmp_path), stream=True, files_per_trigger=1).withColumn("slug", slug))
    assert got == sorted(map(tuple, expiry.run_available(stream, "feeds").collect()), key=repr)
    split = cohort.capped_items(batch, "slug", ["mid"], 1).orderBy("slug").collect()
    assert [(r.slug, r.mid, r.capped) for r in split] == [("ann", "7", True), ("bob", "7", False)]
