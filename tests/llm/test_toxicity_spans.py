"""Spans and scores of whole texts against sums over all label sequences."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from graphloom.llm import toxicity

MODEL = toxicity.Model({"0bad": 6.0, "0mild": 2.5, "4fooz": 2.0}, np.array([-3.0, 0.8, 0.5, 0, 0, 0.2]), np.array([[0.3, -1.0], [-0.4, 0.6]]), (-2.0, 1.5, 0.7))


def brute(text):
    """(score, spans) of a short text: every sequence of labels has a weight, marginals are shares of their sum."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^ \t-\r]+", text or "")]
    features = [MODEL.features(w) for _, _, w in words]
    own = [float(x @ MODEL.weights) if x is not None else MODEL.weights[0] for x in features]
    share, total = np.zeros(len(words)), 0.0
    for labels in itertools.product((0, 1), repeat=len(words)):
        weight = math.exp(sum(e for e, y in zip(own, labels) if y) + sum(MODEL.trans[a, b] for a, b in itertools.pairwise(labels)))
        share += weight * np.array(labels)
        total += weight
    hits = [(s, e, p / total) for (s, e, _), x, p in zip(words, features, share) if x is not None]
    a, b, c = MODEL.layer
    probs = [p for _, _, p in hits]
    return 1 / (1 + math.exp(-(a + b * math.log1p(sum(probs)) + c * max(probs, default=0.0)))), [h for h in hits if h[2] >= 0.5]


def test_spans_and_scores_are_those_of_all_label_sequences(spark):
    rng = random.Random(8)
    words = ["bad", "mild", "foozle", "ok", "fine", "word", "été", "\U0001f600"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(10))) for _ in range(60)]
    texts += [None, "", " \t ", "bad", "  bad\nbad\tbad ", "\U0001f600 bad", "ok " * 9, "bad ok ok ok ok ok ok bad"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = toxicity.tag(spark.createDataFrame(rows, "doc_id long, text string, score string"), MODEL).collect()
    assert len(got) == len(texts) and {r.score for r in got} == {"x"}
    spans = 0
    for r in got:
        score, want = brute(r.text)
        assert r.toxicity.score == pytest.approx(score)
        assert [(s.start, s.end) for s in r.toxicity.spans] == [(a, b) for a, b, _ in want]
        assert [s.p for s in r.toxicity.spans] == pytest.approx([p for _, _, p in want])
        spans += len(want)
    assert spans > 30


def test_a_long_text_is_scored_as_a_whole(spark):
    """A span at the end of a text of 300,000 words is found where it is."""
    long = "ok " * 300_000
    got = toxicity.tag(spark.createDataFrame([(1, long + "bad bad bad"), (2, long)], "doc_id long, text string"), MODEL).orderBy("doc_id").collect()
    assert [(s.start, s.end) for s in got[0].toxicity.spans] == [(900_000 + 4 * k, 900_003 + 4 * k) for k in range(3)]
    assert got[1].toxicity.spans == [] and got[0].toxicity.score > got[1].toxicity.score
