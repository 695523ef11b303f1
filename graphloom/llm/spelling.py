"""Groups of spelling variants: words at one inserted, deleted or replaced code point.

Words are rows of letter counts. One edit changes the squared distance of the counts
to 1 (an insertion, so between neighbouring lengths) or to at most 2 (a replacement,
the same length), so the product of two blocks of rows, a Gram matrix, gives all
pairs that can be near; these are then compared letter by letter.

Blocks are cells: words with the same number of letters in each of GROUPS groups of
the alphabet (so of the same length). An edit adds one to a cell's numbers in one
place, or moves one from a group to another, so near words are in the same cell or in
one of its few neighbours, and no pair is lost. A word is the left side in its own
cell, and the right side in its own and in those of which its cell is the greater
neighbour. Cells of more than SIZE words (fewer of long ones) are cut into blocks by a
hash, and all pairs of blocks are products of their own: tasks stay bounded. Words are
counted before anything else, so a frequent word is one row.

Null texts have no words; an empty table gives an empty one; repeated rows count as
often as they stand there; a null id reads as the empty string in the rule of
deletions. Texts are read whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import cut

GROUPS, SIZE, WIDE = 6, 2048, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"([A-Za-zÀ-ÿ]+)"
#: Letters by their usual frequency, dealt out to the groups to and fro.
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"
ACCENTED = "".join(map(chr, range(0xC0, 0x100)))


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 97) -> DataFrame:
    """Every run of letters as the row ``word``; one of ``every``, by the checksum of id and run, lacks a letter."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    each = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(1))).alias("run"))
    each = each.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    return each.select(F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): the distinct words that are long and frequent enough."""
    return words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _groups() -> list[str]:
    order = FREQUENT + ACCENTED
    at = [min(i % (2 * GROUPS), 2 * GROUPS - 1 - i % (2 * GROUPS)) for i in range(len(order))]
    return ["".join(c for c, g in zip(order, at) if g == k) for k in range(GROUPS)]


def _cell_counts() -> list[Column]:
    """How many letters of each group a word has; characters of no group count in the last."""
    size = F.char_length("word")
    counts = [size - F.char_length(F.translate(F.col("word"), letters, "")) for letters in _groups()[:-1]]
    return [*counts, size - sum(counts, F.lit(0))]


def _cell(counts: list[Column], up: int | None = None, down: int | None = None) -> Column:
    return F.concat_ws(",", *(c + (1 if i == up else -1) if i in (up, down) else c for i, c in enumerate(counts)))


def _centres(counts: list[Column]) -> Column:
    """The cells of which this one is the greater neighbour: one letter less, or one letter moved to a later group."""
    less = [F.when(counts[i] > 0, _cell(counts, None, i)) for i in range(GROUPS)]
    moved = [F.when(counts[i] > 0, _cell(counts, j, i)) for i in range(GROUPS) for j in range(i + 1, GROUPS)]
    return F.array_compact(F.array(*less, *moved))


def codes(words: list[str], width: int) -> np.ndarray:
    """The code points of each word, zeros after its end."""
    out = np.zeros((len(words), width), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    out[np.arange(width) < size[:, None]] = flat
    return out


def _counts(c: np.ndarray, letters: np.ndarray, kind: type) -> np.ndarray:
    rows, _ = np.nonzero(c)
    at = np.searchsorted(letters, c[c > 0])
    return np.bincount(rows * len(letters) + at, minlength=len(c) * len(letters)).reshape(len(c), len(letters)).astype(kind)


def near_pairs(left: list[str], right: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs at one edit; all of ``left`` have one length, those of ``right`` the same or one more."""
    n = len(left[0])
    a, b = codes(left, n), codes(right, n + 1)
    letters = np.unique(np.concatenate((a.ravel(), b.ravel())))
    letters = letters[letters > 0]
    kind = np.float32 if n < 2000 else np.float64
    x, longer = _counts(a, letters, kind), b[:, n] > 0
    xx = np.einsum("ij,ij->i", x, x)
    step = max(1, min(SIZE, (8 << 20) // max(1, len(left))))
    for s in range(0, len(right), step):
        y = _counts(b[s : s + step], letters, kind)
        apart = xx[:, None] + np.einsum("ij,ij->i", y, y)[None, :] - 2 * (x @ y.T)
        i, j = np.nonzero(apart <= 2)
        chunk = max(1, (4 << 20) // n)
        for k in range(0, len(i), chunk):
            p, q = i[k : k + chunk], j[k : k + chunk] + s
            u, v = a[p], b[q]
            here = u == v[:, :n]
            one = here.sum(1) == n - 1
            prefix = np.where(here.all(1), n, here.argmin(1))
            there = (u == v[:, 1:])[:, ::-1]
            suffix = np.where(there.all(1), n, there.argmin(1))
            near = np.where(longer[q], prefix + suffix >= n, one)
            if near.any():
                yield p[near], q[near]


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of each block pair; rows come sorted by ``block``."""

    def found(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows)
        side, words, n = np.array(table["side"].to_pylist()), table["word"].to_pylist(), np.array(table["n"].to_pylist())
        at, beside = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
        if not len(at) or not len(beside):
            return None
        pairs = [(at[i], beside[j]) for i, j in near_pairs([words[k] for k in at], [words[k] for k in beside])]
        if not pairs:
            return None
        i, j = (np.concatenate(x) for x in zip(*pairs))
        once = np.fromiter((s > 1 or words[p] < words[q] for p, q, s in zip(i, j, side[j])), bool, len(i))
        i, j = i[once], j[once]
        pick = lambda k: pa.array([words[x] for x in k], pa.string())
        return pa.RecordBatch.from_arrays([pick(i), pa.array(n[i], pa.int64()), pick(j), pa.array(n[j], pa.int64())], ["a", "n_a", "b", "n_b"])

    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        block = np.array(batch.column(0).to_pylist(), dtype=object)
        ends = [*(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        begin = 0
        for end in ends:
            if begin < end:
                if held and block[begin] != name:
                    if (out := found(held)) is not None:
                        yield out
                    held = []
                name = block[begin]
                held.append(batch.slice(begin, end - begin))
            begin = end
    if held and (out := found(held)) is not None:
        yield out


def pairs_of(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of near words of a table (word, n), each once."""
    placed = words.select("word", "n", *(c.alias(f"g{i}") for i, c in enumerate(_cell_counts())))
    counts = [F.col(f"g{i}") for i in range(GROUPS)]
    placed = placed.select("word", "n", *counts, _cell(counts).alias("cell"), F.xxhash64("word").alias("h"))
    weight = F.sum(F.ceil(F.char_length("word") / 32)).alias("weight")
    cells = cut(placed.groupBy("cell", *counts).agg(weight), "cells")
    beside = cells.select(F.explode(F.concat(F.array("cell"), _centres(counts))).alias("cell"), "weight").groupBy("cell").agg(F.sum("weight").alias("beside"))
    plan = cells.join(beside, "cell").select("cell", F.ceil(F.col("weight") / SIZE).alias("lefts"), F.ceil(F.col("beside") / (WIDE * SIZE)).alias("rights"))
    plan = cut(plan, "plan")
    up_to = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    left = placed.select("cell", "word", "n", "h").join(plan, "cell").select("cell", "word", "n", F.pmod("h", "lefts").alias("l"), up_to(F.col("rights")).alias("r"), F.lit(0).alias("side"))
    sent = placed.select("cell", "word", "n", "h", F.explode(F.concat(F.array("cell"), _centres(counts))).alias("centre")).withColumn("side", F.when(F.col("cell") == F.col("centre"), 1).otherwise(2)).drop("cell")
    right = sent.withColumnRenamed("centre", "cell").join(plan, "cell").select("cell", "word", "n", up_to(F.col("lefts")).alias("l"), F.pmod(F.shiftrightunsigned("h", 20), "rights").alias("r"), "side")
    rows = left.unionByName(right).select(F.concat_ws(":", "cell", "l", "r").alias("block"), "side", "word", "n")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(_products, "a string, n_a long, b string, n_b long")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) without rings: every link is replaced by the link of its end until none changes."""
    at = cut(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "links")
    while at.filter("moved").limit(1).count():
        ends = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = cut(at.join(ends, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
    return at.select("word", "root")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a table (word, n).

    A word's form is its near word of largest n, ties by the smallest word, if that
    n is at least ``times`` the word's; its root is the last of the forms from it.
    """
    if times < 2:
        raise ValueError("a form must be at least twice as frequent, else forms can be a ring")
    words = cut(words, "words")
    pairs = pairs_of(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    strong = -F.col("best.m") >= times * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n"))
    found = cut(found, "forms")
    ends = roots(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
