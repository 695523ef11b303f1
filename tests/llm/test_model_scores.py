"""The lattice model's fitted scores against a plain version of expectation maximization and of the document score."""

import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from graphloom.llm import lattice_lm
from graphloom.llm import queries as Q
from graphloom.llm.bpe import load

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def edges(word, pieces):
    """(begin, end, piece) of every piece in a space and the word's bytes."""
    data = b" " + word.encode()
    return len(data), [(a, b, pieces[data[a:b]]) for b in range(1, len(data) + 1) for a in range(b) if data[a:b] in pieces]


def forward(n, lattice, p):
    alpha = [1.0] + [0.0] * n
    for a, b, k in lattice:  # by end, so alpha[a] is complete
        alpha[b] += alpha[a] * p[k]
    return alpha


def fitted(counts, n_docs, pieces, rounds=2):
    """Probabilities of the pieces and of the end, all segmentations weighted, twice."""
    prior = {k: 1 / (k + 10.0) for k in pieces.values()}
    total = sum(prior.values())
    prior = {k: x / total for k, x in prior.items()}
    p, end = prior, 0.5
    lattices = {w: edges(w, pieces) for w in counts}
    for _ in range(rounds):
        q = {k: x * (1 - end) for k, x in p.items()}
        expected = dict.fromkeys(prior, 0.0)
        for w, c in counts.items():
            n, lattice = lattices[w]
            alpha = forward(n, lattice, q)
            beta = [0.0] * n + [1.0]
            for a, b, k in sorted(lattice, key=lambda e: -e[1]):
                beta[a] += q[k] * beta[b]
            for a, b, k in lattice:
                expected[k] += c * alpha[a] * q[k] * beta[b] / alpha[n]
        mass = sum(expected.values())
        end = (n_docs + 1) / (mass + n_docs + 2)
        p = {k: (expected[k] + (1 + 1e-4 * mass) * prior[k]) / (1 + (1 + 1e-4) * mass) for k in prior}
    return {k: x * (1 - end) for k, x in p.items()}, end


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_document_scores_are_those_of_all_segmentations(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    bpe = load(Q.tokenizer())
    pieces = {b: i for i, b in bpe.bytes_of.items() if b not in {s.encode() for s in bpe.special}}
    train = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2}
    counts = Counter(w for t in train.values() for w in WORD.findall(lower(t)))
    p, end = fitted(counts, len(train), pieces)
    scores = {}
    for r in Q.op4_lattice_lm(spark, FOLDER).collect():
        want = math.log10(end)
        for w in WORD.findall(lower(texts[r.doc_id])):
            if w not in scores:
                n, lattice = edges(w, pieces)
                scores[w] = math.log10(forward(n, lattice, p)[n])
            want += scores[w]
        assert r.score == pytest.approx(want, rel=1e-7), r.doc_id


def test_end_and_pieces_are_a_distribution(spark):
    """The fitted probabilities of all pieces and the end sum to one."""
    import numpy as np

    counts = spark.createDataFrame([("alpha", 3), ("beta", 2), ("ẞx", 1)], "word string, c long")
    logp = lattice_lm.fit(counts, 4, Q.tokenizer())
    assert np.exp(logp[:-1]).sum() == pytest.approx(1.0)
