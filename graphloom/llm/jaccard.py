"""Near-duplicates by the exact Jaccard similarity of shingle sets.

Every text is the set of the 64-bit hashes of its distinct word shingles. All sets
are put in one order, the shingles that are common in a sample last. Two sets of a
similarity of at least t have a shingle in common among the first
n - ceil(t * n) + 1 of each, whatever the order is (prefix filter), so that no pair
is lost. The sample only changes how many pairs are tested. Shingles of a prefix
are named by 32 bits; equal names only add pairs to test.

A set also has a sketch: SKETCH bits, each the parity of the number of its shingles
that fall on it. Two sketches differ in at most as many bits as there are shingles in
one set only, so that pairs whose sketches differ in too many bits are no links; no
pair is lost by this either. The bucket rows carry SKETCH bits; pairs that pass are
compared once more by sketches of about as many bits as a set has shingles, of which
the longer one is folded to the length of the other.

Two sets that are similar share many shingles of their prefixes, but make one pair, not
one per shingle: a row names the FIRSTS smallest shingles of its prefix, and a bucket
leaves out a pair that shares a smaller one. The bucket of the smallest shingle that
two prefixes share never does.

Links are tested on the whole sets, and only accepted ones join groups: first those
whose fingerprints of the sets meet by ball hashing (simhash.py) and those of near
neighbours in an order of the buckets of their FIRSTS, which together join most of
a large group of near copies; then all pairs of a bucket that are not in one group yet
and may be similar by their sizes and sketches. The groups are the connected
components of all pairs at or above the similarity. A bucket of more than BLOCK nodes
is cut into blocks by a hash, and each pair of blocks meets in a bucket of its own, so
that a task holds two blocks at most.

Equal sets are one node, named by a 64-bit hash of the set. Texts shorter than a
shingle are one shingle; texts without words are one node; an empty table gives an
empty one. Ids are integers (or cast to them); repeated rows keep their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.simhash import components, links, majority
from graphloom.llm.store import cut
from graphloom.llm.text import raw, rolling, slices, spans, word_hashes

#: One text of so many is sampled for common shingles; those of at least LEAST sampled texts count, at most COMMON of them.
SAMPLE, LEAST, COMMON = 16, 8, 1 << 17
#: The distance of neighbours in the first round.
REACH = 4
#: The smallest shingles of a prefix that its rows name, and what stands for missing ones.
FIRSTS, NONE = 8, (1 << 32) - 1
#: Bits of a sketch in bucket rows, and at most of a sketch whose bits follow the size of the set.
SKETCH, WIDE = 512, 1 << 15
#: Nodes of a block of a large bucket; buckets of up to SMALL nodes are compared side by side.
BLOCK, SMALL = 4096, 16
FLUSH = 1 << 18
#: Bytes of text that a task turns into sets at a time.
SLICE = 1 << 18


def shingle_sets(batch: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = raw(batch)
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    start, end, first = spans(data, offsets)
    words = word_hashes(data, start, end)
    rolled = rolling(words, shingle)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(rolled[a : b - shingle + 1]))
        else:
            out.append(rolling(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def sketch(s: np.ndarray, bits: int = SKETCH) -> bytes:
    """The parities of a set's shingles by ``bits`` remainders."""
    odd = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def wide_sketch(s: np.ndarray) -> bytes:
    """A sketch of about as many bits as the set has shingles."""
    return sketch(s, min(max(SKETCH, 1 << max(len(s) - 1, 0).bit_length()), WIDE))


def difference(a: bytes, b: bytes) -> int:
    """Bits that differ between two sketches, the longer one folded to the length of the other: at most the shingles in one set only."""
    one, two = (np.frombuffer(x, np.uint8) for x in (a, b))
    least = min(len(one), len(two))
    one, two = (np.bitwise_xor.reduce(x.reshape(-1, least), axis=0) for x in (one, two))
    return int(np.bitwise_count(one ^ two).sum(dtype=np.int64))


def names(prefix: np.ndarray) -> np.ndarray:
    """The distinct names of a prefix's shingles, sorted."""
    return np.unique(prefix >> np.uint64(32))


def firsts(named: np.ndarray) -> bytes:
    """The FIRSTS smallest of sorted names."""
    out = np.full(FIRSTS, NONE, np.uint32)
    out[: len(named)] = named[:FIRSTS]
    return out.tobytes()


def common_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """The commonest shingles of a sample of ``texts`` (text, row), the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(batch.column(0), shingle)).view(np.int64))], ["h"])

    found = texts.filter(F.pmod("row", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "h long")
    counts = found.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    top = counts.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow()
    return top.column("h").to_numpy()[::-1].view(np.uint64)


def with_prefix(texts: DataFrame, shingle: int, least: Fraction, common: np.ndarray) -> DataFrame:
    """(doc_id, row, node, size, fp, sketch, wide, firsts, prefix) of every row of ``texts`` (doc_id, row, text)."""
    order = np.argsort(common)
    known = common[order]

    def prefix(s: np.ndarray) -> np.ndarray:
        n = len(s)
        take = n - -(-n * least.numerator // least.denominator) + 1 if n else 0
        if len(known):
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            late = known[at] == s
            s = np.concatenate((s[~late], common[np.sort(order[at[late]])]))
        return s[:take]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets(batch.column(2), shingle)
            node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            size = np.array([len(s) for s in sets], np.int32)
            fp = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            named = [names(prefix(s)) for s in sets]
            sketches = [pa.array([f(s) for s in sets], pa.binary()) for f in (sketch, wide_sketch)]
            columns = [batch.column(0), batch.column(1), pa.array(node), pa.array(size), pa.array(fp), *sketches, pa.array(list(map(firsts, named)), pa.binary()), _lists(named)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "node", "size", "fp", "sketch", "wide", "firsts", "prefix"])

    return texts.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, node long, size int, fp long, sketch binary, wide binary, firsts binary, prefix array<long>")


def ball_pairs(nodes: DataFrame, least: Fraction) -> DataFrame:
    """(a, b), a < b: pairs of ``nodes`` (node, size, fp) that may be similar enough and whose fingerprints are equal or linked, one of each fingerprint with all others of it."""
    first = cut(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("first")), "first-nodes")
    same = nodes.join(first, "fp").select(F.struct("node", "size").alias("x"), F.col("first").alias("y"))
    one, two = (first.select(F.col("fp").alias(c), F.col("first").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    near = links(first.select("fp")).join(one, "a").join(two, "b").select("x", "y")
    low, high = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
    pairs = same.union(near).filter((F.col("x.node") != F.col("y.node")) & (low * least.denominator >= high * least.numerator))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Columns of batches sorted by the first of them, cut between its values: arrays, and binaries of one length as rows of bytes."""
    held = None
    for batch in batches:
        new = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1) if pa.types.is_binary(c.type) and len(c) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        at = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if at:
            yield [c[:at] for c in held]
            held = [c[at:] for c in held]
    if held is not None and len(held[0]):
        yield held


def shared(nodes: DataFrame) -> DataFrame:
    """(key, early, blocks, block, node, size, sketch, firsts): the prefix shingles of ``nodes`` (node, size, sketch, firsts, prefix) that several nodes have, whether they are among the node's FIRSTS, and their blocks."""
    rows = nodes.select(F.posexplode("prefix").alias("at", "key"), "node", "size")
    many = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    found = rows.join(many, "key").select("key", (F.col("at") < FIRSTS).alias("early"), blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), "node", "size")
    return cut(found, "shared-shingles").join(nodes.select("node", "sketch", "firsts"), "node").select("key", "early", "blocks", "block", "node", "size", "sketch", "firsts")


def _pairs(least: Fraction, reach: int | None):
    """The function that turns sorted bucket rows into pairs (a, b) that may be similar enough."""
    up, down = least.numerator, least.denominator

    def likely(i: np.ndarray, j: np.ndarray, key: np.ndarray, size: np.ndarray, root: np.ndarray, bits: np.ndarray, first: np.ndarray, block: np.ndarray, cross: np.ndarray) -> np.ndarray:
        near = (root[i] != root[j]) & (np.minimum(size[i], size[j]) * down >= np.maximum(size[i], size[j]) * up) & (~cross[i] | (block[i] != block[j]))
        i, j, at = i[near], j[near], np.flatnonzero(near)
        both = size[i] + size[j]
        most = both + 2 * (-up * both // (up + down))
        near = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= most
        i, j, at = i[near], j[near], at[near]
        if reach is None and len(at):  # a bucket of a smaller shingle has the pair, too
            one, two = first[i], first[j]
            at = at[~((one[:, :, None] == two[:, None, :]) & (one < key[i][:, None])[:, :, None]).any((1, 2))]
        return at

    def out(node: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        pairs = np.unique(np.stack((a, b), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, key, node, size, bits, first, root, block, cross in _whole_buckets(batches):
            size, bits, first = size.astype(np.int64), np.ascontiguousarray(bits).view(np.uint64), np.ascontiguousarray(first).view(np.uint32)
            given = (key, size, root, bits, first, block, cross)
            start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            count = np.diff(np.append(start, len(bucket)))
            wide = np.repeat(count, count) > SMALL if reach is None else np.zeros(len(bucket), bool)
            found, held, i = [], 0, np.flatnonzero(~wide)
            for lag in range(1, (SMALL if reach is None else reach + 1)):
                i = i[i + lag < len(bucket)]
                i = i[bucket[i] == bucket[i + lag]]
                if not len(i):
                    break
                k = likely(i, i + lag, *given)
                found.append((i[k], i[k] + lag))
            held = sum(len(x) for x, _ in found)
            for g in np.flatnonzero(count > SMALL) if reach is None else ():
                rows = np.arange(start[g], start[g] + count[g])
                _, which, sizes = np.unique(root[rows], return_inverse=True, return_counts=True)
                rows = rows[np.argsort(sizes[which], kind="stable")]  # those of the largest group last, as they need no test with each other
                for place in range(len(rows) - sizes.max()):
                    i = np.full(len(rows) - place - 1, rows[place])
                    k = likely(i, rows[place + 1 :], *given)
                    found.append((i[k], rows[place + 1 :][k]))
                    held += len(k)
                    if held > FLUSH:
                        yield out(node, found)
                        found, held = [], 0
            yield out(node, found)

    return run


def candidates(buckets: DataFrame, least: Fraction, reach: int | None = None) -> DataFrame:
    """(a, b), a < b: pairs of nodes of a bucket (key, early, blocks, block, node, size, sketch, firsts, root) with different roots that may be similar enough; only those within ``reach`` in an order of each block of an early key, if given."""
    if reach is None:
        mixed = buckets.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key")
        rows = buckets.join(mixed, "key", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"), "key", "node", "size", "sketch", "firsts", "root", "block", (F.col("other") != F.col("block")).alias("cross"))
    else:
        rows = buckets.filter("early").select(F.xxhash64("key", "block").alias("bucket"), "key", "node", "size", "sketch", "firsts", "root", "block", F.lit(False).alias("cross"))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", F.xxhash64("node", F.lit(1)), "node")
    return rows.mapInArrow(_pairs(least, reach), "a long, b long").distinct()


def sketched(pairs: DataFrame, nodes: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose sketches (``nodes``: node, size, wide) allow the similarity."""
    up, down = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, sb, wa, wb = batch.columns
            both = sa.to_numpy().astype(np.int64) + sb.to_numpy()
            most = (both + 2 * (-up * both // (up + down))).tolist()
            near = [difference(x, y) <= m for x, y, m in zip(wa.to_pylist(), wb.to_pylist(), most, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    one, two = (nodes.select(F.col("node").alias(c), F.col("size").alias(f"s{c}"), F.col("wide").alias(f"w{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb", "wa", "wb").mapInArrow(run, "a long, b long")


def accepted(pairs: DataFrame, texts: DataFrame, named: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets are at least so similar; ``named`` (node, row, size, wide) has a row of ``texts`` for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets(batch.column(0), shingle)
            node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), _lists(sets)], ["node", "shingles"])

    pairs = cut(sketched(pairs, named, least), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    asked = cut(named.join(nodes, "node", "left_semi").select("row"), "asked")
    wanted = texts.select("row", "text").join(asked, "row", "left_semi").dropDuplicates(["row"]).select("text")
    sets = cut(wanted.mapInArrow(run, "node long, shingles array<long>"), "sets")
    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    every = F.size("sa") + F.size("sb") - both
    return pairs.join(one, "a").join(two, "b").filter(both * least.denominator >= every * least.numerator).select("a", "b")


def groups(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, row, node, root) of every row of ``texts`` (doc_id, row, text): rows of one root are linked; ``row`` is equal for equal texts only."""
    least = Fraction(str(similarity))
    prints = cut(with_prefix(texts, shingle, least, common_shingles(texts, shingle)), "prefixes")
    nodes = cut(prints.select("node", "size", "sketch", "firsts", "prefix").dropDuplicates(["node"]), "sets")
    buckets = cut(shared(nodes), "buckets")
    named = cut(prints.groupBy("node").agg(F.min("row").alias("row"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("wide").alias("wide")), "named")
    first = candidates(buckets.withColumn("root", F.col("node")), least, REACH).union(ball_pairs(named, least)).distinct()
    roots = components(accepted(first, texts, named, shingle, least))
    labelled = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = accepted(candidates(labelled, least), texts, named, shingle, least)
    roots = components(rest.union(roots.filter("node != root").select("root", "node")))
    return prints.select("doc_id", "row", "node").join(roots, "node", "left").select("doc_id", "row", "node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest id of its group, fp names its shingle set."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    found = cut(groups(texts, shingle, similarity), "groups")
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "root").select("doc_id", F.col("node").alias("fp"), "component_id")
