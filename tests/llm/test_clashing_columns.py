"""Tables whose other columns have names that the operators use."""

from pyspark.sql import functions as F

from graphloom.llm import media, quality, warc

PLAIN = "page_id long, url string, html string"
OTHERS = "payload string, digest string, record_id long, chunk_no int, refers_to long, record_type string, size long, stored string, read string, sha long, role string, holder long"


def test_pages_with_columns_of_the_archive(spark):
    pages = [(1, "u1", "x" * 300), (2, "u2", "x" * 300), (3, "u3", None), (4, None, "y" * 150)]
    more = ("p", "d", 9, 8, 7, "revisit", 6, "s", "r", 5, "o", 4)
    got = []
    for table in (spark.createDataFrame(pages, PLAIN), spark.createDataFrame([(*p, *more) for p in pages], f"{PLAIN}, {OTHERS}")):
        rows = warc.records(warc.read_chunks(warc.write_archives(table, "page_id", "url", "html")))
        got.append(sorted(map(tuple, rows.collect())))
    assert got[0] == got[1] and [r[3:] for r in got[0]] == [("response", None), ("revisit", 1), ("response", None), ("response", None)]


def test_media_columns_are_replaced_and_others_kept(spark):
    docs = spark.createDataFrame([(1, "text", "old", 7, 3), (2, None, "old", None, 4)], "doc_id long, text string, stored string, read int, feature int")
    out = media.media_features(media.to_media(docs))
    plain = media.media_features(media.to_media(docs.select("doc_id", "text")))
    columns = ("doc_id", "read.payload_sha256", "read.feature")
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(map(tuple, plain.select(*columns).collect()))
    assert sorted(r.feature for r in out.select("feature").collect()) == [3, 4]


def test_quality_reads_only_its_columns(spark):
    rows = [(i, " ".join(f"w{j % (5 + i)}" for j in range(40)), "en", None) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    odd = docs.withColumns({c: F.lit("x") for c in ("_words", "_lines", "_windows", "_sorted", "_at", "n_words", "n_lines", "kept", "base_failed", "group_rows", "lo_mean_word", "_lang", "_source")})
    assert sorted(map(tuple, quality.judge(odd).collect())) == sorted(map(tuple, quality.judge(docs).collect()))
