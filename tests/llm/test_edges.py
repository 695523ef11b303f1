"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; the operators' own parts."""

import glob
import gzip
import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, lattice_lm, media, mixing, quality, secrets, simhash, substring_dedup, text, toxicity, warc
from graphloom.llm.queries import not_mod_5, tokenizer
from tests.llm import brute as B

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, weight long, turn int, row string, slot long, word string, fp long, n_words int, score double"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "été", "x", "delta-9", "ẞtraße"]
    body = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 34, 35, 36, 120)]
    values = [None, "", " \t\n", "one", LONG, *body, body[4], body[4] + " tail", "\x0b\x0c", "😀 " * 40, "a" * 3000]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, 0, 5, 1, "r", 9, "w", 7, 2, 0.5) for i, t in enumerate(values)]
    rows += [rows[9], (None, body[3], None, None, *rows[0][4:])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def listed(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def by_key(rows, *cols):
    return sorted((tuple(r[c] for c in ("doc_id", *cols)) for r in rows), key=repr)


def test_words_match_the_pattern(listed):
    column = pa.array([t for _, t in listed])
    data, offsets = text.raw(column)
    start, end, first = text.spans(data, offsets)
    for i, (_, t) in enumerate(listed):
        assert [data[a:b].tobytes().decode() for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], strict=True)] == B.WORD.findall(t or "")
    h = text.word_hashes(data, start, end)
    known = {}
    for x, a, b in zip(h, start, end, strict=True):
        assert known.setdefault(data[a:b].tobytes(), x) == x
    assert len(set(known.values())) == len(known)
    assert len(set(text.rolling(h, 5).tolist())) == len({tuple(h[i : i + 5]) for i in range(len(h) - 4)})


def test_secret_edges(docs, listed):
    assert len(secrets.with_spans(docs.select("doc_id", "text"), out="s").collect()) == len(listed)
    assert secrets.scan(None) == [] and secrets.scan("") == []
    rng = random.Random(1)
    key = "".join(rng.sample("ABCDEFGHJKMNPQRSTabcdefghijklmn23456789+/", 40))
    assert ("entropy", 4, 44) in secrets.scan(f"key {key} end")
    url = "https://x.org/example/of/pages/"
    assert any(k == "entropy" and b == len(url) + 40 for k, a, b in secrets.scan(f"see {url}{key}")) or "/" in key
    letters = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(40))
    assert secrets.scan(letters) == [("entropy", 0, 40)] and not secrets.scan("https://www.some-site.org/path/to/the/page/of/articles/2024/index.html getElementByIdAndParseTheDocument")
    assert not secrets.scan("see 123e4567-e89b-12d3-a456-426614174000 and " + "pqrs" * 12)
    assert secrets.scan("TOKEN='passwd: abcdefgh1") == []  # the short match uses up the second key word
    spans = secrets.scan('api_key = "AKIA' + "Z" * 16 + '"')
    assert [s[0] for s in spans][:2] == ["assign", "access"]


def test_entropy_is_that_of_each_window():
    rng = random.Random(2)
    s = "".join(rng.choice("abcdef0123456789") for _ in range(60))

    def bits(w):
        return -sum(w.count(c) / 20 * np.log2(w.count(c) / 20) for c in set(w))

    covered = {k for i in range(41) if bits(s[i : i + 20]) >= 3.2 for k in range(i, i + 20)}
    runs = {k for a, b in secrets.entropy_runs(s, None, 20, 3.2) for k in range(a, b)}
    assert runs == covered


def test_redaction(docs, listed):
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == len(listed) and out.filter("text IS NULL").count() == 1


def test_dedup_edges(docs, listed):
    keyed = {(i, k): t for k, (i, t) in enumerate(listed)}
    want = B.dedup(keyed)
    got = by_key(substring_dedup.drop_repeats(docs, width=1 << 12).withColumn("sha", F.sha2(F.encode("kept_text", "UTF-8"), 256)).collect(), "n_words", "n_removed", "sha")
    assert got == sorted(((i[0], *v) for i, v in want.items()), key=repr)


def test_dedup_width_changes_nothing(docs):
    a, b = (by_key(substring_dedup.drop_repeats(docs, width=w).collect(), "n_removed") for w in (1 << 8, 1 << 16))
    assert a == b


def test_simhash_edges(docs, listed):
    prints = {k: B.fingerprint(t) for k, (_, t) in enumerate(listed)}
    got = simhash.near_duplicates(docs).collect()
    assert sorted(r.fp for r in got) == sorted(simhash._signed(f) for f in prints.values())
    empty = [r for r in got if r.fp == 0]
    assert len(empty) == 4 and {r.component_id for r in empty} == {0}


def near_prints():
    """Groups of fingerprints around centres, some of which share a half."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)] + [0x1234ABCD << 32 | rng.getrandbits(32) for _ in range(200)] + [rng.getrandbits(32) << 32 | 0x77 for _ in range(200)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 3))) for b in base[:60] for _ in range(30)]
    return sorted({*base, *near})


@pytest.mark.parametrize("hot", [1 << 20, 330])
def test_links_lose_none(spark, hot):
    """All links are found, whether or not the variants of common halves are split."""
    prints = near_prints()
    nodes = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    assert (simhash.hot_variants(nodes, hot).count() > 0) == (hot == 330)
    want = B.components({simhash._signed(p): p for p in prints})
    got = {r.node: r.root for r in simhash.components(simhash.links(nodes, hot)).collect()}
    groups = {}
    for p, root in want.items():
        groups.setdefault(root, set()).add(p)
    for g in groups.values():
        assert {got.get(p, p) for p in g} == {min(g)}


def test_components_of_chains_and_stars(spark):
    """The smallest node of each component, however it hangs together, with loops and repeated edges."""
    rng = random.Random(8)
    chain = list(range(1000, 1400))
    star = [(5, k) for k in range(6, 300)] + [(2999, k) for k in range(3000, 3200)]
    shuffled = rng.sample(range(5000, 5300), 300)
    edges = [*zip(chain, chain[1:]), *star, *zip(shuffled, shuffled[1:]), (7, 7), (5, 6), (6, 5), (9000, 9000)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 1000 for k in chain} | {k: 5 for k in range(5, 300)} | {k: 2999 for k in range(2999, 3200)} | {k: 5000 for k in shuffled}
    assert got == want
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similarity_finds_near_copies(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(5000)]
    originals = [[rng.choice(words) for _ in range(300)] for _ in range(60)]
    rows = []
    for i, w in enumerate(originals):
        edited = [rng.choice(words) if rng.random() < 0.01 else x for x in w]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(edited))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, shingle=5, similarity=0.8).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(60)) >= 54
    assert all(got[2 * i] == 2 * i for i in range(60))


def test_lattice_edges(docs, listed):
    training = F.coalesce(F.col("doc_id"), F.lit(2)) % 7 != 2
    got = lattice_lm.score(docs, training, tokenizer()).collect()
    assert len(got) == len(listed) and all(np.isfinite(r.score) for r in got)
    assert all(r.n_tokens == len(B.WORD.findall(t or "")) + 1 for r, t in [(r, dict(listed)[r.doc_id]) for r in got if r.doc_id is not None])


def test_lattice_sums_all_segmentations():
    lat = lattice_lm.lattice(tokenizer())
    logp = np.append(np.log(np.maximum(lat.prior, 1e-300)), -np.inf)
    pieces = {b: i for i, b in bpe.load(tokenizer()).bytes_of.items()}

    def total(s):
        return 1.0 if not s else sum(lat.prior[pieces[s[:k]]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in pieces and s[:k] != b"<|endoftext|>")

    words = [b"the", b"thing", "été".encode(), b"q"]
    want = [np.log(total(b" " + w)) for w in words]
    assert lat.word_scores(words, logp) == pytest.approx(want, rel=1e-9)
    expected = lat.expected([b"the"], np.ones(1), logp)
    lengths = {i: len(b) for b, i in pieces.items()}
    assert sum(expected[i] * lengths[i] for i in np.flatnonzero(expected)) == pytest.approx(4)


def test_mixing_edges(docs, listed, spark):
    out = mixing.mix(docs, "doc_id", "source")
    assert out.count() == len(listed) and set(docs.columns) <= set(out.columns)
    weights = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1), ("d", 1)], "mix_source string, weight long")
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").when(F.col("id") % 6 == 2, "c").otherwise("d").alias("source"))
    rows = mixing.mix(many, "doc_id", "source", weights, block=2).select("mix_source", "block_no", "slot").distinct().collect()
    by_slot = {r.slot: r.mix_source for r in rows}
    assert len(by_slot) == len(rows)
    placed = dict.fromkeys("abcd", 0)
    for t in range(1000):
        placed[by_slot[t]] += 1
        for s, w in zip("abcd", (5, 3, 1, 1), strict=True):
            assert abs(placed[s] - (t + 1) * w / 10) < 1


def test_mixing_of_repeated_and_missing_ids(spark):
    """Ids that many rows share, rows that repeat and columns of maps: every row is numbered once, in the order of the id's hash."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 50).alias("x"), F.create_map(F.lit("k"), F.col("id") % 40).alias("m"), F.lit(1).alias("row"))
    rows = mixing.mix(df, "doc_id", "source", block=1).collect()
    assert sorted(r.block_no for r in rows) == list(range(1, 3001))
    rows.sort(key=lambda r: r.block_no)
    digests = [hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest() for r in rows]
    assert digests == sorted(digests)
    many = spark.range(mixing.MAX_SOURCES + 1).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"))
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(many, "doc_id", "source")


def test_count_weights(docs, spark):
    got = {r.mix_source: r.weight for r in mixing.count_weights(mixing.source_counts(docs, "source")).collect()}
    assert sum(got.values()) == mixing.PERIOD and min(got.values()) >= 1


def test_bpe_long_and_short_agree():
    b, rng = bpe.load(tokenizer()), random.Random(4)
    for _ in range(200):
        word = "".join(rng.choice("aeiou nrst") for _ in range(rng.randint(1, 300))).encode()
        assert b.merge_short(word) == b.merge_long(word)
    s = "x<|endoftext|>y \n\n  z\ttab 'll don't 12345 été😀"
    assert b.decode(b.encode(s)) == s and b.encode(None) == b""
    assert 50256 in np.frombuffer(b.encode(s), "<u4")


def test_bpe_edges(docs):
    back = bpe.with_ids(docs, "text", tokenizer(), "back")
    assert set(docs.columns) <= set(back.columns) and back.count() == docs.count()
    assert back.filter("coalesce(text, '') != back").count() == 0


def test_warc_edges(spark):
    big = "<p>" + "x" * (3 * warc.CHUNK_BYTES)
    rows = [(5, "u5", big), (2, "u2", big), (3, None, None), (4, "u\r\n4", ""), (6, "u6", "short"), (7, "u7", "short"), (2, "u2", big), (None, "n", "z" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    chunks = warc.read_chunks(warc.write_archives(pages, "page_id", "url", "html")).cache()
    got = sorted((tuple(r) for r in warc.records(chunks).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(5, len(big), sha(big), "revisit", 2), (2, len(big), sha(big), "response", None), (2, len(big), sha(big), "response", None), (3, 0, sha(""), "response", None), (4, 0, sha(""), "response", None), (6, 5, sha("short"), "response", None), (7, 5, sha("short"), "response", None), (None, 200, sha("z" * 200), "response", None)]
    assert got == sorted(want, key=repr)
    parts = chunks.filter("record_id = 2").orderBy("chunk_no").collect()
    assert max(len(r.chunk) for r in parts) <= warc.CHUNK_BYTES and parts[-1].chunk_no >= 3
    assert warc.records(warc.read_chunks(warc.write_archives(pages.limit(0), "page_id", "url", "html"))).count() == 0


def test_archives_are_valid_warc(spark):
    """A plain reader of the format: mandatory fields, unique ids, lengths, digests, profiles."""
    rows = [(1, "http://a.org/x y", "<p>" + "é" * 200), (2, "http://a.org/\r\nz", "<p>" + "é" * 200), (2, None, "short"), (2, None, "short"), (None, None, None)]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html", "2024-05-06T07:08:09Z")
    folder = manifest.first().path.rpartition("/")[0].replace("file:", "")
    ids, kinds = [], []
    for path in glob.glob(f"{folder}/*.warc.gz"):
        with gzip.open(path) as f:
            while first := f.readline():
                assert first == b"WARC/1.1\r\n"
                head = {}
                while (line := f.readline()) != b"\r\n":
                    name, _, value = line.decode("ascii").rstrip("\r\n").partition(": ")
                    head[name] = value
                block = f.read(int(head["Content-Length"]))
                assert f.read(4) == b"\r\n\r\n" and head["WARC-Date"] == "2024-05-06T07:08:09Z" and head["Content-Type"] == "application/http; msgtype=response"
                assert " " not in head["WARC-Target-URI"]
                if head["WARC-Type"] == "response":
                    http, _, payload = block.partition(b"\r\n\r\n")
                    assert http.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(payload)}".encode() in http
                    assert head["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
                else:
                    assert head["WARC-Profile"] == "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" and not block and head["X-Refers-To-Key"] == "1"
                ids.append(head["WARC-Record-ID"])
                kinds.append(head["WARC-Type"])
    assert len(ids) == len(set(ids)) == 5 and kinds.count("revisit") == 1


def test_a_damaged_payload_is_an_error(tmp_path):
    body = b"x" * 300
    head = warc._head(1, None, hashlib.sha256(body).hexdigest(), "http://a.org", 300, "2024-05-06T07:08:09Z")
    for text, good in ((body, True), (b"y" + body[1:], False)):
        path = f"{tmp_path}/{good}.warc.gz"
        with gzip.open(path, "wb") as f:
            f.write(head + text + b"\r\n\r\n")
        if good:
            assert [r[8] for r in warc.read_records(path, 100)] == [False, False, True]
        else:
            with pytest.raises(ValueError, match="digest"):
                list(warc.read_records(path, 100))


def test_toxicity_edges(docs, listed, spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(14)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, not_mod_5())
    assert toxicity.tag(docs, model).count() == len(listed)
    none = toxicity.fit(docs, labels.limit(0), not_mod_5())
    assert all(r.toxicity.score < 0.5 for r in toxicity.tag(docs, none).collect())


def test_marginals_match_full_forward_backward():
    model = toxicity.Model({"0bad": 6.0, "4fooz": 2.0}, np.array([-3.0, 1.0, 0.5, 0, 0, 0.2]), np.array([[0.3, -1.0], [-0.4, 0.6]]))
    scorer, words = model.scorer(), "ok bad ok ok ok foozle bad ok".split()
    hits, n = scorer.hits(" ".join(words))
    e = [scorer.emission(w) if scorer.emission(w) is not None else model.weights[0] for w in words]
    own = [np.array([1.0, np.exp(x)]) for x in e]
    step, want = np.exp(model.trans), []
    for t in range(n):
        f = own[0]
        for k in range(1, t + 1):
            f = (f @ step) * own[k]
        b = np.ones(2)
        for k in range(n - 1, t, -1):
            b = step @ (own[k] * b)
        want.append((f * b)[1] / (f * b).sum())
    assert scorer.marginals(hits, n) == pytest.approx([want[h[0]] for h in hits])


def test_chain_is_fitted_until_its_gradient_vanishes(monkeypatch):
    """The gradient is that of the likelihood over all labellings, and is flat at the end."""
    model = toxicity.Model({"0bad": 4.0, "0vile": 3.5, "0mean": 2.0})
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ok", "day", "mean", *(["bad", "vile"] * (i % 2))]) for _ in range(rng.randint(1, 9))) for i in range(40)]
    seen = []

    def spy(value, theta):
        at = theta + np.random.default_rng(2).normal(size=10) * 0.3
        got, grad = value(at)
        w, trans, total, n = at[:6], at[6:].reshape(2, 2), 0.0, 0
        for i, t in enumerate(texts):
            x = [f if (f := model.features(word)) is not None else np.eye(6)[0] for word in t.split()]
            y = [int(i % 2 and model.features(word) is not None and model.features(word)[-1] >= toxicity.LABEL_ODDS) for word in t.split()]
            score = lambda s: sum(k * (x[j] @ w) for j, k in enumerate(s)) + sum(trans[a, b] for a, b in zip(s, s[1:]))  # noqa: B023, E731
            total += score(y) - np.log(sum(np.exp(score(s)) for s in itertools.product((0, 1), repeat=len(x))))
            n += len(x)
        assert got == pytest.approx(toxicity.RIDGE * at @ at / 2 - total / n)
        assert grad == pytest.approx([(value(at + e)[0] - value(at - e)[0]) / 2e-6 for e in np.eye(10) * 1e-6], abs=1e-7)
        best = minimum(value, theta)
        seen.append(np.abs(value(best)[1]).max())
        return best

    minimum = toxicity._minimum
    monkeypatch.setattr(toxicity, "_minimum", spy)
    toxicity._fit_chain(model, texts, [i % 2 for i in range(40)])
    assert seen[0] <= 1e-5


def test_png_filters_and_checksums():
    data = bytes(random.Random(8).randbytes(192 * 9))
    blob = media.encode_png(data)
    assert media.decode_png(blob).tobytes() == data
    with pytest.raises(ValueError):
        media.decode_png(blob[:50] + bytes([blob[50] ^ 1]) + blob[51:])
    rows = np.frombuffer(data, np.uint8).reshape(9, 192).astype(int)
    lines = []
    for y in range(9):
        kind, out = y % 5, []
        for x in range(192):
            a, b = (rows[y, x - 3] if x >= 3 else 0), (rows[y - 1, x] if y else 0)
            c = rows[y - 1, x - 3] if y and x >= 3 else 0
            p = a + b - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((rows[y, x] - (0, a, b, (a + b) // 2, best)[kind]) % 256)
        lines.append(bytes([kind, *out]))
    head = (64).to_bytes(4, "big") + (9).to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    blob = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(b"".join(lines))) + media._chunk(b"IEND", b"")
    assert media.decode_png(blob).tobytes() == data


def test_media_edges(docs, listed):
    rows = media.media_features(media.to_media(docs)).collect()
    assert len(rows) == len(listed)
    for r in rows:
        assert r.read.payload_sha256 == hashlib.sha256(media.payload(r.text)).hexdigest() and r.read.payload_bytes % 192 == 0
    same = {r.read.feature for r in rows if r.text == listed[9][1]}
    assert len(same) == 1


def test_quality_edges(docs, listed):
    got = by_key(quality.judge(docs).collect(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((i, *B.quality(t)) for i, t in listed), key=repr)


def test_quality_rejects_outliers(spark):
    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(60))
    rows = [(i, line(), "en", "s") for i in range(300)] + [(300, " ".join(w + "#$%&*|" for w in line().split()), "en", "s"), (301, "\n".join(["q w e r"] * 40), "en", "s")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[300] and not got[301] and sum(got.values()) >= 297


@pytest.mark.parametrize("name", ["op1_secrets", "op2_substring_dedup", "op3_simhash", "op4_lattice_lm", "op5_mixing", "op6_bpe", "op7_warc", "op8_toxicity", "op9_media", "op10_quality"])
def test_empty_tables(spark, tmp_path_factory, name):
    from graphloom.llm import queries as Q

    folder = tmp_path_factory.mktemp("empty")
    for t in ("documents", "pages", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    assert Q.queries()[name](spark, str(folder)).count() == 0
