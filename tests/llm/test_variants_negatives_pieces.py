"""Hard negatives, pieces and spelling variants: the queries against SQL and the library, edge cases against brute force."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphloom.llm import hard_negatives as H
from graphloom.llm import oracles, pieces, spelling
from graphloom.llm import queries as Q
from tests.llm import brute as B
from tests.oracle import connect, rows_of_duckdb, rows_of_spark

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_spelling"])
def test_same_rows_as_sql(spark, name):
    assert rows_of_spark(Q.queries()[name](spark, FOLDER)) == rows_of_duckdb(connect(FOLDER), oracles.OP11 if "11" in name else oracles.OP13)


def mined(rows, anchor, scale=256):
    """All answers by scoring every pair; rows are (id, label, vector)."""
    fit = [(i, l, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (i, l, v) in enumerate(fit):
        if not anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, u)), j, m == l) for n, (j, m, u) in enumerate(fit) if n != k and len(u) == len(v))
        for p, pid, _ in [x for x in scored if x[2]][:5]:
            inside = [(-s, j) for s, j, same in scored if not same and -80 * p <= -100 * s <= -100 * p][:5]
            out += [(i, pid, r + 1, j, -p, s) for r, (s, j) in enumerate(inside)]
    return sorted(out)


def test_hard_negatives_of_odd_tables(spark, monkeypatch):
    """Copies, ties, repeated rows, nulls, other lengths, clashing names; blocks and leaves small enough that there are many."""
    monkeypatch.setattr(H, "BLOCK", 16)
    monkeypatch.setattr(H, "ANCHORS", 8)
    monkeypatch.setattr(H, "BOXES", 4)
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.choice((-0.5, 0.0, 0.25, 1.0)) for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, i % 2, [1.0, 1.0, 1.0, 0.5]) for i in range(60)]
    rows += [rows[0], rows[30], (None, 1, [1.0] * 4), (2000, None, [1.0] * 4), (2010, 1, None), (2020, 1, [1.0, None, 1.0, 1.0]), (2030, 1, [float("nan"), 1.0, 1.0, 1.0]), (2040, 1, [float("inf"), 1.0, 1.0, 1.0])]
    rows += [(3000 + i, i % 2, [0.5 * (i % 5)] * 2) for i in range(20)] + [(4000, 0, []), (4001, 1, []), (4010, 0, [])]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, label int, embedding array<float>, block string, aid int")
    got = H.mine(df, "vec_id", "embedding", F.col("label"), F.col("id") % 10 == 0)
    want = mined(rows, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500
    assert H.mine(df.limit(0), "vec_id", "embedding", F.col("label"), F.col("id") % 10 == 0).count() == 0


def test_queue_leaves_out_boxes():
    """Clustered points: few leaves are opened, and none that could hold an answer is left out."""
    rng = np.random.default_rng(2)
    points = (rng.normal(size=(20, 8))[rng.integers(0, 20, 4000)] * 300 + rng.normal(size=(4000, 8)) * 3).astype(np.int64)
    points = points[H.pack(points, H.LEAF)]
    tree, opened = H.Tree(points), []
    anchor = points[17]
    best = H.Best(tree, anchor, np.array([1 << 40]), np.array([H.NEVER]), 5, np.ones(4000, bool), [np.array([i]) for i in range(4000)], None)

    def fill(places, scores):
        opened.append(len(places))
        return best.fill(places, scores)

    tree.search(anchor, np.array([H.NEVER]), np.array([1 << 40]), fill, np.array([H.NEVER]))
    want = sorted((-int(s), i) for i, s in enumerate(points @ anchor))[:5]
    assert best.found[0] == want and len(opened) < 20


def test_pieces_are_those_of_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    got = Q.op12_sentencepiece(spark, FOLDER).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), B.sha(np.array(ids, "<u4").tobytes()), B.sha(library.decode(ids)))


def test_pieces_of_odd_texts():
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.load(PATH)
    rng = random.Random(9)
    names = list(own.id_of)
    texts = [None, "", " ", "\0", "a\0b", "▁", "<s></s><0x0A>", "\U0001f600", " " * 500 + "x", "a" * 5000, "".join(rng.choice("etaoin") for _ in range(20_000))]
    texts += ["".join(rng.choice(names) for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    texts += ["".join(rng.choice("  ab▁\n\t1é漢=-") for _ in range(rng.randrange(1, 40))) for _ in range(2000)]
    for t in texts:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids and own.decode(own.encode(t)) == library.decode(ids)
    for _ in range(2000):
        ids = [rng.choice((rng.randrange(3, 259), rng.randrange(1, 32_000), rng.randrange(3))) for _ in range(rng.randrange(12))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_pieces_by_joining_the_whole_text():
    own = pieces.load(PATH)
    rng = random.Random(4)
    for _ in range(500):
        word = pieces.SPACE + "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 60)))
        assert own.split(word) == own.merged(word)


def test_pieces_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", b"old", "x"), (1, "a b", b"old", "x"), (None, None, None, None)], "doc_id long, text string, ids binary, parts string")
    out = pieces.with_pieces(df, "text", PATH, "decoded")
    assert out.columns == ["doc_id", "text", "parts", "ids", "decoded"]
    assert sorted(((r.doc_id, r.decoded, len(r.ids)) for r in out.collect()), key=repr) == sorted([(1, "a b", 16), (1, "a b", 16), (None, "", 8)], key=repr)
    assert pieces.with_pieces(df.limit(0), "text", PATH).count() == 0


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(counts):
    out = {}
    for w, n in counts.items():
        beside = [v for v in counts if near(w, v)]
        best = min(beside, key=lambda v: (-counts[v], v), default=None)
        out[w] = (n, len(beside), best if best is not None and counts[best] >= 2 * n else None)
    def root(w):
        return w if out[w][2] is None else root(out[w][2])
    return sorted((w, n, k, f, counts.get(f), root(w)) for w, (n, k, f) in out.items())


@pytest.mark.parametrize("size", [2048, 3])
def test_variants_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(spelling, "SIZE", size)
    rng = random.Random(8)
    counts = {"".join(rng.choice("abcéÉλ") for _ in range(rng.randrange(3, 7))): rng.choice((1, 2, 3, 4, 8, 16, 33)) for _ in range(400)}
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    counts |= {long: 9, long[:1500] + long[1501:]: 3, long[:99] + "z" + long[100:]: 1, long[::-1]: 2}
    df = spark.createDataFrame([(w, n, 0) for w, n in counts.items()], "word string, n long, cell int")
    got = spelling.variants(df.select("word", "n"))
    assert sorted(tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()) == grouped(counts)
    assert spelling.variants(df.select("word", "n").limit(0)).count() == 0


def test_runs_of_odd_texts(spark):
    texts = [None, "", "Été-ÀB2c Straße", "x" * 50_000, *(f"word{chr(97 + i % 26)} Letters" for i in range(300))]
    docs = spark.createDataFrame([(i if i else None, t, "n", 1) for i, t in enumerate(texts)] * 2, "doc_id long, text string, word string, run int")
    want = []
    import re

    for i, t in enumerate(texts):
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{i or ''}:{w}".encode())
            want.append(w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w)
    assert sorted(r.word for r in spelling.runs(docs).collect()) == sorted(want * 2)
    words = {r.word: r.n for r in spelling.vocabulary(spelling.runs(docs)).collect()}
    assert words == {w: 2 * want.count(w) for w in set(want) if len(w) >= 5 and 2 * want.count(w) >= 3}
