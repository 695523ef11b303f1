"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A 64-bit fingerprint holds the majority bits of the XXH64 of all word shingles.
Fingerprints that differ in at most RADIUS = 3 bits are found without comparing all:
one of their halves of 32 bits differs in at most one bit, so in each half every
fingerprint emits all variants within half of the radius (one flipped bit), and two
halves that differ in up to two bits meet in a common variant. Variants are shuffled,
each bucket's colliding pairs are verified on all 64 bits, and each task emits a
spanning forest of its verified links, which are joined into connected components. No
link is lost.

Equal fingerprints are one node, so groups of exact copies of any size cost one
node. A half that more than HOT // 33 nodes have could make large buckets: its
variants are split by the other half, of which three of six parts are equal if at most
three bits differ (20 keys of 16 or 17 bits). So a bucket holds at most HOT nodes, or
33 values of a half with 16 equal bits of the other one, whatever the input.

Null and empty texts have the fingerprint 0 and link like any other; an empty table
gives an empty one. Ids are integers (or cast to them). Repeated ids keep their rows
and take the smallest component of their fingerprint. Only the id and the text are
read, whatever other columns are named. Texts of any length are hashed whole.

Texts of a given Jaccard similarity need more than this: see jaccard.py.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import cut
from graphloom.llm.text import raw, slices, spans

SEED, RADIUS = 42, 3
SMALL = 12
HALVES = (0xFFFFFFFF, 0xFFFFFFFF << 32)
#: Nodes of a bucket that is not split.
HOT = 8192


def majority(h: np.ndarray) -> np.uint64:
    """The bits that are set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for c in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[c : c + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]


def fingerprints(batch: pa.Array, shingle: int) -> np.ndarray:
    """Fingerprints of a string array."""
    data, offsets = raw(batch)
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    start, end, first = spans(data, offsets)
    size = end - start
    # One space after each word: a shingle is a slice of these bytes.
    stop = np.cumsum(size + 1)
    at = stop - size - 1
    line = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    line[within + np.repeat(at, size)] = data[within + np.repeat(start, size)]
    text = line.tobytes()
    out = np.zeros(len(offsets) - 1, np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if a == b:
            continue
        n = max(1, b - a - shingle + 1)
        low, high = at[a : a + n].tolist(), (stop[min(a + shingle, b) - 1 : b] - 1).tolist()
        out[i] = majority(np.array([digest(text[x:y], SEED) for x, y in zip(low, high, strict=True)], np.uint64))
    return out


def with_fingerprint(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, fp) of every row: fp is a signed long with the bits of the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1), shingle).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def variants(fp: Column, mask: int, part: int) -> Column:
    """Keys of all variants of the masked fingerprint within one flipped bit."""
    kept = fp.bitwiseAND(F.lit(_signed(mask)))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << b)).cast("long") for b in range(64) if mask >> b & 1))
    return F.transform(flips, lambda bit: F.xxhash64(F.lit(part), kept.bitwiseXOR(bit)))


def _split_keys(fp: Column, part: int) -> Column:
    """Keys of the fingerprint's other half: one of them is equal if at most three of its bits differ."""
    edges = [0, 6, 12, 17, 22, 27, 32]
    pieces = [((1 << (b - a)) - 1) << a + (32 if part == 0 else 0) for a, b in itertools.pairwise(edges)]
    return F.array(*(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(_signed(sum(three))))) for k, three in enumerate(itertools.combinations(pieces, 3))))


def hot_variants(nodes: DataFrame, hot: int) -> DataFrame:
    """(hot) keys of the variants whose buckets may hold more than ``hot`` of the distinct fingerprints of ``nodes`` (fp)."""
    halves = nodes.select(F.explode(F.array(*(F.struct(F.lit(part).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("half")) for part, mask in enumerate(HALVES)))).alias("h"))
    many = halves.groupBy("h.part", "h.half").agg(F.count("*").alias("n")).filter(F.col("n") > hot // 33)
    keys = F.when(F.col("part") == 0, variants(F.col("half"), HALVES[0], 0)).otherwise(variants(F.col("half"), HALVES[1], 1))
    return many.select(F.explode(keys).alias("hot")).distinct()


def _bucket_links(fp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within buckets given by their starts: a spanning forest of each.

    Buckets of up to SMALL nodes are first tested all at once for any link.
    """
    size = np.diff(np.append(starts, len(fp)))
    group = np.repeat(np.arange(len(starts)), size)
    small = np.repeat(size <= SMALL, size)
    left, right, linked = [], [], [np.flatnonzero(size > SMALL)]
    for lag in range(1, int(min(SMALL, size.max(initial=1)))):
        i = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
        near = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= RADIUS]
        pair = size[group[near]] == 2
        left.append(fp[near[pair]])
        right.append(fp[near[pair] + lag])
        linked.append(group[near[~pair]])
    for g in np.unique(np.concatenate(linked)):
        rest = np.unique(fp[starts[g] : starts[g] + size[g]])
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                node = front.pop()
                near = np.bitwise_count(rest ^ node) <= RADIUS
                found, rest = rest[near], rest[~near]
                left.append(np.full(len(found), node))
                right.append(found)
                front.extend(found)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


class Forest:
    """Union-find over the nodes of a task; keeps the links that join two trees."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    def joining(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """The pairs that join two trees, one after the other."""
        out = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self.find(x), self.find(y)
            if i != j:
                self.root[max(i, j)] = min(i, j)
                out.append((x, y))
        return out


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): verified links between the distinct fingerprints of ``nodes`` (fp), enough to connect all that are linked."""
    split = cut(hot_variants(nodes, hot), "hot-variants")
    each = F.flatten(F.array(*(F.transform(variants(F.col("fp"), mask, part), lambda v, part=part: F.struct(F.lit(part).alias("part"), v.alias("variant"))) for part, mask in enumerate(HALVES))))
    rows = nodes.select("fp", F.explode(each).alias("v")).select("fp", "v.part", "v.variant")
    marked = rows.join(split, F.col("variant") == F.col("hot"), "left")
    own = F.when(F.col("part") == 0, _split_keys(F.col("fp"), 0)).otherwise(_split_keys(F.col("fp"), 1))
    keys = F.when(F.col("hot").isNull(), F.array("variant")).otherwise(F.transform(own, lambda k: F.xxhash64("variant", k)))
    rows = marked.select("fp", F.explode(keys).alias("key")).repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_fp, held_key, forest = np.zeros(0, np.uint64), np.zeros(0, np.int64), Forest()

        def out(fp: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            multi = np.diff(np.append(begin, len(key))) > 1
            keep = np.repeat(multi, np.diff(np.append(begin, len(key))))
            fp, key = fp[keep], key[keep]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            pairs = np.array(forest.joining(*_bucket_links(fp, begin)), np.uint64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            fp = np.concatenate((held_fp, batch.column(0).to_numpy().view(np.uint64)))
            key = np.concatenate((held_key, batch.column(1).to_numpy()))
            if not len(key):
                continue
            at = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            held_fp, held_key = fp[at:], key[at:]
            if at:
                yield out(fp[:at], key[:at])
        if len(held_key):
            yield out(held_fp, held_key)

    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Rounds of contraction: every node points to its neighbour of least rank, or to
    itself, and takes over what that one points to; edges are relabelled by it, and
    loops and repeated edges go, until none are left. So each round has fewer edges
    than the last one, and joins each of them once per end. Ranks are hashes, so that
    chains shrink by a factor. Each round is written, so lost executors cost one round.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("other"))
    tidy = lambda df: df.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, labels = cut(tidy(edges), "links"), None
    while left.take(1):
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
        least = ends.groupBy("node").agg(F.min(rank("other")).alias("least"))
        up = cut(least.select("node", F.least("least", rank("node"))["other"].alias("up")), "pointers")
        further = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = cut(up.join(further, "up").select("node", "top"), "pointers")
        one, two = (up.select(F.col("node").alias(c), F.col("top").alias(f"top_{c}")) for c in "ab")
        left = cut(tidy(left.join(one, "a").join(two, "b").select(F.col("top_a").alias("a"), F.col("top_b").alias("b"))), "links")
        if labels is None:
            labels = up
        else:
            labels = cut(labels.join(up.select(F.col("node").alias("top"), F.col("top").alias("next")), "top", "left").select("node", F.coalesce("next", "top").alias("top")), "labels")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = cut(labels.groupBy("top").agg(F.min("node").alias("root")), "roots")
    return labels.join(roots, "top").select("node", "root")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest id that links reach.

    With ``similarity`` links are those of the exact Jaccard measure of the shingle
    sets (see jaccard.py) and fp names the set.
    """
    if similarity is not None:
        from graphloom.llm import jaccard

        return jaccard.near_duplicates(docs, key, text, shingle, similarity)
    prints = cut(with_fingerprint(docs, key, text, shingle), "fingerprints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp")))
    named = cut(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "nodes")
    groups = cut(named.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = cut(named.join(groups, "root").select("fp", "component_id"), "nodes")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
