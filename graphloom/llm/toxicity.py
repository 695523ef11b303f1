"""Toxic spans by a linear-chain conditional random field.

1. A bounded sample of labelled rows (those of at most SAMPLE_BYTES in a share of
   a hash's range that holds SAMPLE_DOCS ids on average) gives the document frequencies of
   word forms (the lower-cased word without edge punctuation, and its first four,
   five and six characters) in toxic and clean documents. Forms whose
   log-likelihood ratio is at least twice the log of the number of forms tested
   keep their log-odds, at most FORMS.
2. Tokens get labels: in toxic documents those whose form has log-odds of at least
   LABEL_ODDS, as only documents are labelled. A two-state chain with the log-odds as
   features is fitted on CRF_DOCS short documents of the sample: its conditional
   likelihood is maximised until the gradient vanishes.
3. Every text: forward-backward marginals of the tokens with a form. Runs of
   tokens without any have one transition matrix, whose power is taken in closed
   form, so the marginals are exact at a cost of the number of forms. A logistic
   function of their sum and maximum, fitted on the sample, is the score;
   tokens with a marginal of 0.5 or more are the offending offsets.

Null and empty texts have no tokens and get the score of none. Without labels of
both kinds every score is the smoothed share of toxic labels; an empty table gives an
empty one. If an id has several labels the largest counts. Repeated rows are scored
each. Texts of any length are tagged whole, in time linear in them. Extra columns
pass through, whatever they are named.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.store import cut
from graphloom.llm.text import slices

SAMPLE_DOCS, SAMPLE_BYTES, FORMS = 16_000, 40_000, 20_000
CRF_DOCS, CRF_BYTES = 600, 3_000
#: The fit ends when no part of the mean gradient is larger, or no step improves it.
FLAT, RIDGE = 1e-6, 1e-4
LEAST_ODDS, LABEL_ODDS = 1.5, 3.0
EDGE = ".,;:!?\"'()[]{}<>«»*#-"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = (0, 4, 5, 6)
CACHE = 50_000


def forms(word: str) -> list[str]:
    """The forms of a word; each begins with its kind."""
    w = word.lower().strip(EDGE)
    return [f"0{w}", *(f"{k}{w[:k]}" for k in KINDS[1:] if len(w) >= k)] if w else []


@dataclass
class Model:
    """Log-odds of forms, the chain's weights and the document layer."""

    odds: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    layer: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def features(self, word: str) -> np.ndarray | None:
        """The feature vector of a word, or None if it has no form of the model."""
        got = [0.0] * 4
        for f in forms(word):
            got[KINDS.index(int(f[0]))] = self.odds.get(f, 0.0)
        return np.array([1.0, *got, max(got)]) if any(got) else None

    def plain(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Eigenvalues and vectors of the step over a token without forms, scaled to a largest value of 1."""
        m = np.exp(self.trans) * np.exp([0.0, self.weights[0]])[None]
        values, vectors = np.linalg.eig(m)
        return values.real / np.abs(values).max(), vectors.real, np.linalg.inv(vectors.real)

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A model with the tables that scoring needs."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.cache: dict[str, float | None] = {}
        self.values, self.left, self.right = model.plain()

    def emission(self, word: str) -> float | None:
        x = self.model.features(word)
        return None if x is None else float(x @ self.model.weights)

    def hits(self, text: str) -> tuple[list[tuple[int, int, int, float]], int]:
        """Tokens with a form (place, start, end, emission) and the number of all tokens."""
        cache, out, n = self.cache, [], 0
        for m in WORD.finditer(text):
            word = m[0]
            try:
                e = cache[word]
            except KeyError:
                e = self.emission(word)
                if len(cache) >= CACHE:
                    cache.clear()
                if len(word) <= 64:
                    cache[word] = e
            if e is not None:
                out.append((n, m.start(), m.end(), e))
            n += 1
        return out, n

    def _gap(self, n: int) -> np.ndarray:
        return (self.left * self.values**n) @ self.right

    def marginals(self, hits: list[tuple[int, int, int, float]], n: int) -> list[float]:
        """Probability of the toxic state at each hit, by forward-backward."""
        step = np.exp(self.model.trans)
        forward, state, at = [], np.array([1.0, math.exp(self.model.weights[0])]), 0
        for place, _, _, e in hits:
            own = np.array([1.0, math.exp(min(e, 300.0))])
            if place == 0:
                state = own
            else:
                state = state @ self._gap(place - at - 1) if place - at > 1 else state
                state = (state @ step) * own
            state = np.maximum(state / state.sum(), 0)
            forward.append(state)
            at = place
        back, at, probs = np.ones(2), n, []
        for i in range(len(hits) - 1, -1, -1):
            place, e = hits[i][0], hits[i][3]
            if at == n:
                back = self._gap(n - place - 1) @ np.ones(2) if n - place > 1 else np.ones(2)
            else:
                back = step @ (np.array([1.0, math.exp(min(hits[i + 1][3], 300.0))]) * back)
                back = self._gap(at - place - 1) @ back if at - place > 1 else back
            back = np.maximum(back / back.sum(), 0)
            both = forward[i] * back
            probs.append(float(both[1] / both.sum()))
            at = place
        return probs[::-1]

    def tag(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """(score, offending spans with their probability) of a text."""
        hits, n = self.hits(text or "")
        probs = self.marginals(hits, n) if hits else []
        a, b, c = self.model.layer
        total, most = (sum(probs), max(probs)) if probs else (0.0, 0.0)
        z = max(-60.0, min(60.0, a + b * math.log1p(total) + c * most))
        return 1 / (1 + math.exp(-z)), [(h[1], h[2], p) for h, p in zip(hits, probs, strict=True) if p >= 0.5]


def _fit_chain(model: Model, texts: list[str], labels: list[int]) -> None:
    """Weights and transitions at the largest likelihood of the documents' token labels, all documents side by side."""
    docs = []
    for text, toxic in zip(texts, labels, strict=True):
        x = [f if (f := model.features(w)) is not None else None for w in WORD.findall(text)]
        if x:
            docs.append((np.array([f if f is not None else [1.0, 0, 0, 0, 0, 0] for f in x]), np.array([int(toxic and f is not None and f[-1] >= LABEL_ODDS) for f in x])))
    docs.sort(key=lambda d: -len(d[0]))
    if not docs:
        return
    longest, count = len(docs[0][0]), len(docs)
    x, y = np.zeros((longest, count, 6)), np.zeros((longest, count), np.int64)
    for i, (f, l) in enumerate(docs):
        x[: len(f), i], y[: len(f), i] = f, l
    active = [sum(len(d[0]) > t for d in docs) for t in range(longest)]
    live = np.arange(longest)[:, None] < np.array([len(d[0]) for d in docs])[None]
    seen_t = np.zeros((2, 2))
    np.add.at(seen_t, (y[:-1][live[1:]], y[1:][live[1:]]), 1)

    def value(theta: np.ndarray) -> tuple[float, np.ndarray]:
        """The negative mean log-likelihood with a ridge, and its gradient, by forward-backward over all documents."""
        w, trans = theta[:6], np.exp(theta[6:].reshape(2, 2))
        scores = np.clip(x @ w, -30, 30)
        own = np.stack([np.ones_like(scores), np.exp(scores)], 2)
        alpha, beta, norm = np.zeros((longest, count, 2)), np.ones((longest, count, 2)), np.zeros(count)
        alpha[0] = own[0] / own[0].sum(1, keepdims=True)
        norm += np.log(own[0].sum(1))
        for t in range(1, longest):
            k = active[t]
            s = (alpha[t - 1, :k] @ trans) * own[t, :k]
            total = s.sum(1, keepdims=True)
            alpha[t, :k] = s / total
            norm[:k] += np.log(total[:, 0])
        for t in range(longest - 2, -1, -1):
            k = active[t + 1]
            s = (own[t + 1, :k] * beta[t + 1, :k]) @ trans.T
            beta[t, :k] = s / s.sum(1, keepdims=True)
        both = alpha * beta
        p = both[..., 1] / np.maximum(both.sum(2), 1e-300) * live
        pair = alpha[:-1, :, :, None] * trans[None, None] * (own[1:] * beta[1:])[:, :, None, :]
        pair = pair / np.maximum(pair.sum((2, 3), keepdims=True), 1e-300) * live[1:, :, None, None]
        free = live & (np.abs(scores) < 30)  # a clipped score doesn't move
        grad = np.concatenate(((x * (((y == 1) - p) * free)[..., None]).sum((0, 1)), (seen_t - pair.sum((0, 1))).ravel())) / live.sum()
        gained = (scores * y * live).sum() + (seen_t * theta[6:].reshape(2, 2)).sum() - norm.sum()
        return RIDGE * float(theta @ theta) / 2 - gained / live.sum(), RIDGE * theta - grad

    theta = np.zeros(10)
    theta[0] = -4.0
    theta = _minimum(value, theta)
    model.weights, model.trans = theta[:6], theta[6:].reshape(2, 2)


def _minimum(value, theta: np.ndarray) -> np.ndarray:
    """The minimum of a smooth function that gives its value and gradient, by quasi-Newton steps (BFGS) until the gradient is flat."""
    inverse, (f, grad) = np.eye(len(theta)), value(theta)
    while np.abs(grad).max() > FLAT:
        step = -inverse @ grad
        if step @ grad >= 0:
            inverse, step = np.eye(len(theta)), -grad
        size = 1.0
        while not (new := value(theta + size * step))[0] <= f + 1e-4 * size * (step @ grad):
            size /= 2
            if size < 1e-10:
                return theta
        s, d = size * step, new[1] - grad
        theta, f, grad = theta + s, *new
        if s @ d > 1e-14:
            rho = 1 / (s @ d)
            left = np.eye(len(theta)) - rho * np.outer(s, d)
            inverse = left @ inverse @ left.T + rho * np.outer(s, s)
    return theta


def _fit_layer(model: Model, sums: np.ndarray, labels: np.ndarray) -> None:
    """The document layer by Newton steps with a ridge."""
    x = np.stack([np.ones(len(sums)), np.log1p(sums[:, 0]), sums[:, 1]], 1)
    theta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (labels - p) - 0.5 * theta
        theta = theta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), grad)
    model.layer = tuple(float(t) for t in theta)


def fit(docs: DataFrame, labels: DataFrame, training: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model of the labelled rows for which ``training`` (on the labels' key) holds."""
    known = labels.filter(training & F.col(label).isNotNull()).groupBy(F.col(key).alias("label_id")).agg(F.max(label).cast("int").alias("label"))
    # A share of a hash's range instead of an ordered limit, which would send a full sample from each task to the driver.
    share_taken = min(1.0, SAMPLE_DOCS / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < round(share_taken * (1 << 20)))
    texts = docs.select(F.col(key).alias("label_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    sample = texts.join(F.broadcast(known), "label_id")  # at most SAMPLE_DOCS rows of two numbers

    @F.pandas_udf("array<string>")
    def _forms(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: sorted({f for w in set(WORD.findall(t)) for f in forms(w)}))

    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    model = Model()
    if not n1 or not n0:
        model.layer = (math.log((n1 + 0.1) / (n0 + 1.0)), 0.0, 0.0)
        return model
    found = cut(sample.select("label", F.explode(_forms("text")).alias("form")).groupBy("form").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).filter("a >= 3"), "toxic-forms")
    least = 2 * math.log(max(2, found.count()))
    a, b = F.col("a"), F.col("b")
    share = F.lit(n1 / (n1 + n0))
    llr = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    odds = F.log((a + 0.5) / (n1 + 1.0)) - F.log((b + 0.5) / (n0 + 1.0))
    kept = found.select("form", odds.alias("odds"), llr.alias("llr")).filter((F.col("llr") >= least) & (F.col("odds") >= LEAST_ODDS))
    model.odds = {r["form"]: r["odds"] for r in kept.orderBy(F.desc("llr"), "form").limit(FORMS).collect()}
    short = sample.filter(F.octet_length("text") <= CRF_BYTES)
    chosen = [r for k in (0, 1) for r in short.filter(F.col("label") == k).orderBy(F.xxhash64("label_id"), "label_id").limit(CRF_DOCS // 2).collect()]
    _fit_chain(model, [r["text"] for r in chosen], [r["label"] for r in chosen])
    held = sample.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("total double, most double")
    def _sums(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = held.value.scorer()
        for batch in batches:
            got = [scorer.marginals(h, n) for h, n in map(scorer.hits, batch)]
            yield pd.DataFrame({"total": [sum(p) for p in got], "most": [max(p, default=0.0) for p in got]})

    pdf = sample.select("label", _sums("text").alias("s")).select("label", "s.total", "s.most").toPandas()  # at most SAMPLE_DOCS rows of three numbers
    _fit_layer(model, pdf[["total", "most"]].to_numpy(float), pdf["label"].to_numpy(float))
    return model


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
TAGGED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))])
_ARROW = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))])


def tag(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the struct column ``out`` (score and offending spans of each text); a column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(out)
    schema = T.StructType([*kept.schema, T.StructField(out, TAGGED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held.value.scorer()
        for batch in slices(batches, text, 1 << 18):
            got = [scorer.tag(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            tagged = pa.array([{"score": s, "spans": [{"start": a, "end": b, "p": p} for a, b, p in x]} for s, x in got], _ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns, tagged], schema.names)

    return kept.mapInArrow(run, schema)
