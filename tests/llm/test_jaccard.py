"""Near-duplicates by exact Jaccard similarity against all pairs."""

import random

from graphloom.llm import simhash
from tests.llm import brute as B


def sets_of(texts, n=5):
    out = {}
    for i, t in texts.items():
        w = B.WORD.findall((t or "").lower())
        out[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    return out


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def roots(sets, least=0.8):
    """The smallest id that each id reaches over pairs of at least this similarity."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if similarity(sets[i], sets[j]) >= least:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def found(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.near_duplicates(df, shingle=5, similarity=0.8).collect()}


def edited(rng, words, times, fresh):
    out = list(words)
    for at in rng.sample(range(len(words)), times):
        out[at] = fresh(rng)
    return out


def test_a_dissimilar_neighbour_separates_no_pair(spark):
    """B and C are near copies; A is within reach of both in fingerprint bits, but not similar enough."""
    rng = random.Random(21)
    fresh = lambda r: f"w{r.randrange(10**6)}"
    texts = {}
    for g in range(40):
        a = [fresh(rng) for _ in range(300)]
        b = edited(rng, a, 16, fresh)
        texts |= {10 * g: " ".join(a), 10 * g + 1: " ".join(b), 10 * g + 2: " ".join(edited(rng, b, 5, fresh))}
    sets = sets_of(texts)
    want = roots(sets)
    assert sum(want[10 * g + 1] == want[10 * g + 2] != want[10 * g] for g in range(40)) >= 30
    assert found(spark, texts) == want


def test_the_stage_finds_all_pairs_down_to_the_similarity(spark):
    """Pairs just above 0.8 and just below it, and texts that share a repeated line or differ only in one."""
    import corpus_pipeline as P

    rng = random.Random(22)
    fresh = lambda r: f"w{r.randrange(10**6)}"
    texts = {}
    for g in range(80):
        a = [fresh(rng) for _ in range(300)]
        texts |= {10 * g: " ".join(a), 10 * g + 1: " ".join(edited(rng, a, 5 + g % 4, fresh))}
    line = " ".join(fresh(rng) for _ in range(12))
    for g in range(80, 100):
        a = " ".join(fresh(rng) for _ in range(60))
        b = " ".join(fresh(rng) for _ in range(60))
        many = f" {line}" * 40
        texts |= {10 * g: a + many, 10 * g + 1: b + many, 10 * g + 2: a}
    texts |= {2000: "", 2001: " \n", 2002: "one two", 2003: "One  TWO", 2004: None}
    want = roots(sets_of(texts))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in P.drop_near_duplicates(spark, df, None).collect()}
    assert kept == {i for i, r in want.items() if i == r}


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    """A group of near copies, outliers among them, whose buckets are cut: the same groups as all pairs give."""
    from graphloom.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(24)
    fresh = lambda r: f"w{r.randrange(10**6)}"
    base = [fresh(rng) for _ in range(120)]
    texts = {k: " ".join(edited(rng, base, 1 + k % 9, fresh)) for k in range(150)}
    want = roots(sets_of(texts))
    assert len(set(want.values())) > 10 and found(spark, texts) == want


def test_sketches_lose_no_pair():
    """Two sketches differ in at most as many bits as the sets in elements."""
    import numpy as np

    from graphloom.llm import jaccard

    rng = np.random.default_rng(3)
    for _ in range(50):
        a = rng.integers(0, 2**63, rng.integers(0, 400), dtype=np.uint64)
        b = np.concatenate((a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(0, 100), dtype=np.uint64)))
        bits = [np.frombuffer(jaccard.sketch(np.unique(x)), np.uint64) for x in (a, b)]
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_a_pair_is_made_once_not_once_per_shared_shingle(spark, monkeypatch):
    """Near copies share many shingles of their prefixes; the buckets make each pair about once, and none is lost."""
    from fractions import Fraction

    from pyspark.sql import functions as F

    from graphloom.llm import jaccard

    rng = random.Random(25)
    fresh = lambda r: f"w{r.randrange(10**6)}"
    texts = {}
    for g in range(100):
        a = [fresh(rng) for _ in range(500)]
        texts |= {10 * g: " ".join(a), 10 * g + 1: " ".join(edited(rng, a, 3, fresh))}
    made, build = spark.sparkContext.accumulator(0), jaccard._pairs

    def counted(*given):
        run = build(*given)

        def count(batches):
            for batch in run(batches):
                made.add(batch.num_rows)
                yield batch

        return count

    monkeypatch.setattr(jaccard, "_pairs", counted)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").select("doc_id", F.col("doc_id").alias("row"), "text")
    least = Fraction("0.8")
    nodes = jaccard.with_prefix(rows, 5, least, jaccard.common_shingles(rows, 5)).drop("doc_id", "row")
    pairs = jaccard.candidates(jaccard.shared(nodes).withColumn("root", F.col("node")), least)
    assert pairs.count() == 100 and made.value <= 120
