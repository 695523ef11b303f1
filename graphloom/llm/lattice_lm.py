"""Language-model scores from a subword lattice.

The pieces are those of a public byte-level vocabulary; the prior score of a
piece falls with its rank there (the file has ranks, no log-probabilities). The
scores are then re-estimated on the training documents' words by EM_ROUNDS of
expectation maximization over all segmentations; the expected counts of the
pieces (at most the vocabulary's size) are summed by Spark. A word is a space and
its bytes; its probability is the sum over all segmentations of the product of
the pieces' probabilities, by a forward recursion in log space. A text is the
product over its words and one end.

Counts of words stay in tables. The most frequent words, at most TOP, are
broadcast for the add-one baseline; all others meet their counts in a
join, which no hot word can skew, as the hot ones are not in it. A task keeps the
scores of words that it has met, as words repeat.

Null and empty texts are one end token. With no training documents the prior
scores hold and all counts are 0; an empty table gives an empty one. Repeated rows
are scored, and counted, each. Only the id and the text are read, whatever other
columns are named. Texts of any length are scored whole, in time linear in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import load
from graphloom.llm.store import cut
from graphloom.llm.text import SPACE, raw, slices, spans, word_hashes

EM_ROUNDS = 2
TOP = 1 << 16
#: Words whose scores a worker keeps, and the bytes that such a word has at most.
CACHE, LONGEST_CACHED = 400_000, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_B = 0xC2B2AE3D27D4EB4F
_BASE, _INV = np.uint64(_B), np.uint64(pow(_B, -1, 2**64))
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Lattice:
    """Pieces found by the hash of their bytes, with log-probabilities."""

    def __init__(self, path: str) -> None:
        pieces = {i: b for i, b in load(path).bytes_of.items() if b not in {s.encode() for s in load(path).special}}
        self.ids = np.array(sorted(pieces), np.int64)
        self.size = int(self.ids.max()) + 1
        hashes = []
        for i in self.ids:
            data = np.frombuffer(pieces[int(i)], np.uint8)
            power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data) - 1, _BASE))), dtype=np.uint64)
            hashes.append((_BYTE[data] * power).sum(dtype=np.uint64))
        hashes = np.array(hashes, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.by_hash = hashes[order], self.ids[order]
        self.longest = max(map(len, pieces.values()))
        self.prior = np.zeros(self.size)
        self.prior[self.ids] = 1 / (self.ids + 10.0)
        self.prior /= self.prior.sum()

    def _groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """For words of one length: their indexes and, for each end, the piece index of each start (-1: none)."""
        lengths = np.array([len(w) + 1 for w in words])
        data = np.frombuffer(b" " + b" ".join(words), np.uint8)
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data), _BASE))), dtype=np.uint64)
        down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data), _INV))), dtype=np.uint64)
        total = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[data] * up[:-1], dtype=np.uint64)))
        for length in np.unique(lengths):
            same = np.flatnonzero(lengths == length)
            for at in range(0, len(same), 20_000):
                group = same[at : at + 20_000]
                spots = begin[group]
                found = []
                for j in range(1, length + 1):
                    i = np.arange(max(0, j - self.longest), j)[:, None]
                    h = (total[spots + j][None] - total[spots[None] + i]) * down[spots[None] + i]
                    k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                    found.append(np.where(self.hashes[k] == h, self.by_hash[k], -1))
                yield group, found

    @staticmethod
    def _sum(x: np.ndarray) -> np.ndarray:
        top = x.max(0)
        top = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            return np.log(np.exp(x - top).sum(0)) + top

    def word_scores(self, words: list[bytes], logp: np.ndarray) -> np.ndarray:
        """Natural log of each word's marginal probability; logp ends with -inf for a missing piece."""
        out = np.zeros(len(words))
        for group, found in self._groups(words) if words else ():
            alpha = [np.zeros(len(group))]
            for j, pieces in enumerate(found, 1):
                low = j - len(pieces)
                alpha.append(self._sum(np.stack(alpha[low:j]) + logp[pieces]))
            out[group] = alpha[-1]
        return out

    def expected(self, words: list[bytes], weights: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces over all segmentations of the weighted words."""
        counts = np.zeros(self.size + 1)
        for group, found in self._groups(words) if words else ():
            n = len(found)
            alpha = [np.zeros(len(group))]
            for j, pieces in enumerate(found, 1):
                alpha.append(self._sum(np.stack(alpha[j - len(pieces) : j]) + logp[pieces]))
            beta = [np.full(len(group), -np.inf) for _ in range(n)] + [np.zeros(len(group))]
            for j in range(n, 0, -1):
                pieces = found[j - 1]
                low = j - len(pieces)
                through = logp[pieces] + beta[j][None]
                for r in range(len(pieces)):
                    beta[low + r] = np.logaddexp(beta[low + r], through[r])
                share = np.exp(np.stack(alpha[low:j]) + through - alpha[n][None]) * weights[group][None]
                counts += np.bincount(np.where(pieces < 0, self.size, pieces).ravel(), share.ravel(), self.size + 1)
        return counts[:-1]


_lattices: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """The lattice of a vocabulary file, once in each Python process."""
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def lowered(text: Column) -> Column:
    """A-Z as a-z; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, c) over all texts."""
    words = docs.select(F.explode(F.split(lowered(F.col(text)), SPACE)).alias("word")).filter("word != ''")
    return words.groupBy("word").agg(F.count("*").alias("c"))


def frequent(counts: DataFrame, most: int = TOP) -> DataFrame:
    """The words above a count that at most ``most`` words reach, from a histogram of an eighth of a power of two per bin."""
    bins = counts.groupBy(F.floor(F.log2("c") * 8).alias("bin")).agg(F.count("*").alias("n"))
    total, least = 0, None
    for r in bins.orderBy(F.desc("bin")).collect():  # at most 8 * 63 rows
        total += r["n"]
        if total > most:
            break
        least = r["bin"]
    return counts.filter(F.lit(False)) if least is None else counts.filter(F.floor(F.log2("c") * 8) >= least)


def fit(counts: DataFrame, n_docs: int, path: str, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Natural log-probabilities of the pieces (the last: -inf, for no piece) and, before it, of the end."""
    lat, spark = lattice(path), counts.sparkSession
    p, end = lat.prior, 0.5
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            given = spark.sparkContext.broadcast(np.append(np.log(p * (1 - end)), -np.inf))

        def run(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            mine, total = lattice(path), 0
            for pdf in batches:
                total = total + mine.expected([w.encode() for w in pdf["word"]], pdf["c"].to_numpy(float), given.value)
            if not np.isscalar(total):
                at = np.flatnonzero(total)
                yield pd.DataFrame({"piece": at, "n": total[at]})

        got = counts.mapInPandas(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
        n = np.zeros(lat.size)
        for r in got:
            n[r["piece"]] = r["n"]
        mass = n.sum()
        end = (n_docs + 1) / (mass + n_docs + 2)
        p = (n + (1 + 1e-4 * mass) * lat.prior) / (1 + (1 + 1e-4) * mass)
    with np.errstate(divide="ignore"):
        return np.concatenate((np.log(p * (1 - end)), [np.log(end)], [-np.inf]))


def score(docs: DataFrame, training: Column, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), scores as log10."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), training.alias("training"))
    counts = cut(word_counts(rows.filter("training"), "text"), "word-counts")
    n_docs = rows.select("training").filter("training").count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = sums["n"] + n_docs, sums["v"] + (1 if n_docs else 0)
    below = float(n + v + 1)
    logp = spark.sparkContext.broadcast(fit(counts, n_docs, path))
    top = spark.sparkContext.broadcast({r["word"].encode(): r["c"] for r in frequent(counts).collect()})  # at most TOP rows
    names = ["doc_id", "training", "n_words", "top_known", "top_base", "score", "rare", "rare_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, given = lattice(path), logp.value
        pieces = np.append(given[:-2], -np.inf)
        cache: dict[bytes, float] = {}

        def word_scores(words: list[bytes]) -> np.ndarray:
            new = [w for w in words if w not in cache]
            scores = dict(zip(new, lat.word_scores(new, pieces).tolist(), strict=True))
            out = np.fromiter((cache[w] if w in cache else scores[w] for w in words), float, len(words))
            if len(cache) + len(new) > CACHE:
                cache.clear()
            cache.update((w, x) for w, x in scores.items() if len(w) <= LONGEST_CACHED)
            return out

        for batch in slices(batches, "text"):
            data, offsets = raw(batch.column(1))
            start, end, first = spans(data, offsets)
            h = word_hashes(data, start, end)
            _, at, which = np.unique(h, return_index=True, return_inverse=True)
            body = data.tobytes()
            words = [body[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            known = np.array([top.value.get(w, -1) for w in words], np.int64) if words else np.zeros(0, np.int64)
            size = len(offsets) - 1
            with np.errstate(invalid="ignore", divide="ignore"):
                base = np.where(known >= 0, np.log10((known + 1) / below), 0.0)
            sums_ = [np.bincount(doc, x[which], size) if len(which) else np.zeros(size) for x in ((known >= 0).astype(float), base, word_scores(words))]
            rare = np.flatnonzero(known[which] < 0) if len(which) else np.zeros(0, np.int64)
            pair, n_pair = np.unique(doc[rare] * np.int64(len(words) or 1) + which[rare], return_counts=True)
            owner, word = pair // (len(words) or 1), pair % (len(words) or 1)
            cuts = pa.array(np.searchsorted(owner, np.arange(size + 1)).astype(np.int32))
            listed = pa.array([words[k].decode() for k in word.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.diff(first)), pa.array(sums_[0].astype(np.int64)), pa.array(sums_[1]), pa.array((sums_[2] + given[-2]) / np.log(10)), pa.ListArray.from_arrays(cuts, listed), pa.ListArray.from_arrays(cuts, pa.array(n_pair.astype(np.int64)))], names
            )

    ids = docs.select(key).schema[0].dataType.simpleString()
    texts = rows.select("doc_id", lowered(F.col("text")).alias("text"), "training")
    each = texts.mapInArrow(run, f"doc_id {ids}, training boolean, n_words long, top_known long, top_base double, score double, rare array<string>, rare_n array<long>")
    each = cut(each.withColumn("row_id", F.monotonically_increasing_id()), "scored")
    pairs = each.select("row_id", F.explode(F.arrays_zip("rare", "rare_n")).alias("z")).select("row_id", F.col("z.rare").alias("word"), F.col("z.rare_n").alias("n"))
    c = F.coalesce("c", F.lit(0))
    rest = pairs.join(counts, "word", "left").select("row_id", (F.col("n") * F.log10((c + 1) / F.lit(below))).alias("base"), F.when(c > 0, F.col("n")).otherwise(0).alias("known"))
    rest = rest.groupBy("row_id").agg(F.sum("base").alias("rare_base"), F.sum("known").alias("rare_known"))
    ends = 1 if n_docs else 0
    return each.join(rest, "row_id", "left").select(
        "doc_id",
        (~F.col("training")).alias("held_out"),
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("top_known") + F.coalesce("rare_known", F.lit(0)) + ends).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("top_base") + F.coalesce("rare_base", F.lit(0.0)) + F.lit(float(np.log10((n_docs + 1) / below)))).alias("base_score"),
        "score",
    )
