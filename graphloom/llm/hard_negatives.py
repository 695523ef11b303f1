"""Hard negatives from vectors, by an STR-packed R-tree.

Components become whole numbers, so scores (inner products) are whole numbers and
ties are real. Rows of equal vector, label and length are one class that keeps the
smallest ids (as many as one answer can hold), so thousands of copies are one point.

Tiles come from a bounded sample: it is sorted by the first axis and cut into slabs,
each slab by the second, and so on (sort-tile-recursive). Every class is put into its
tile, tiles of more than BLOCK classes are cut by a hash, and each block is packed by
the same rule into leaves. The box of a block, of its nodes and of its leaves gives an
interval of each coordinate, hence of the inner product with an anchor.

Anchors first search the block of the highest bound for their positives, then all
blocks whose bound isn't strictly below the k-th score found so far; the score windows
of the positives then choose the blocks for the negatives. Inside a block a queue opens
the best box first, leaves out boxes outside all windows, and ends when every bound is
strictly below the k-th score. What blocks find is merged by score, ties by id.

Rows with a null id, label or vector or a component that is null or not finite take
no part; nor do rows with a component so large that a score could exceed a long. Vectors of different lengths are never compared. Repeated rows are rows:
a repeated anchor gives its answers again, and its other copy may be its positive. An
empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.store import cut

SAMPLE, TILES, BLOCK, LEAF, FAN, ANCHORS, BOXES = 16_384, 1024, 4096, 256, 4, 1024, 512
NEVER = -(1 << 62)


def whole_vectors(df: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(id, label, v) of the rows that take part; ``v`` is the whole components."""
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("int"))
    most = F.lit(float(1 << 30)) / F.sqrt(F.greatest(F.size(vector), F.lit(4)))
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < most))
    kept = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(fine)
    return kept.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), scaled.alias("v")).filter("label IS NOT NULL")


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """(v, label, ids): the ``keep`` smallest ids of each vector and label."""
    at = F.row_number().over(Window.partitionBy("v", "label").orderBy("id"))
    return rows.withColumn("at", at).filter(F.col("at") <= keep).groupBy("v", "label").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def stacked(v: pd.Series) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.stack(v.to_list()).astype(np.int64)


def tiles(vectors: np.ndarray, pieces: int, axes: list[int]) -> list:
    """Nested cuts [axis, bounds, parts] of a sample: slabs of equal size along one axis after the other."""
    if pieces <= 1 or not axes or len(vectors) < 2:
        return []
    slabs = max(2, min(pieces, round(pieces ** (1 / min(len(axes), max(1, round(np.log2(pieces) / 2)))))))
    column = np.sort(vectors[:, axes[0]])
    bounds = sorted({int(column[len(column) * k // slabs]) for k in range(1, slabs)})
    at = np.searchsorted(bounds, vectors[:, axes[0]], "right")
    return [axes[0], bounds, [tiles(vectors[at == k], -(-pieces // slabs), axes[1:]) for k in range(len(bounds) + 1)]]


def tile_of(vectors: np.ndarray, node: list) -> np.ndarray:
    """The tile of each vector, as the number of its leaf in ``node``."""
    if not node:
        return np.zeros(len(vectors), np.int64)
    axis, bounds, parts = node
    at, out, base = np.searchsorted(bounds, vectors[:, axis], "right"), np.zeros(len(vectors), np.int64), 0
    for k, part in enumerate(parts):
        here = at == k
        inner = tile_of(vectors[here], part)
        out[here] = base + inner
        base += count(part)
    return out


def count(node: list) -> int:
    """The number of tiles of ``node``."""
    return sum(map(count, node[2])) if node else 1


def pack(vectors: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the vectors in which each ``leaf`` of them are a leaf: sorted by the widest axis, cut into slabs, each sorted by the next."""
    axes = np.argsort(-vectors.var(0), kind="stable") if vectors.shape[1] else np.zeros(0, int)

    def sort(at: np.ndarray, depth: int) -> list[np.ndarray]:
        leaves = -(-len(at) // leaf)
        if leaves <= 1 or depth >= len(axes):
            return [at]
        slabs = max(2, round(leaves ** (1 / max(1, round(np.log2(leaves) / 2)))))
        at = at[np.argsort(vectors[at, axes[depth]], kind="stable")]
        step = -(-leaves // slabs) * leaf
        return [x for s in range(0, len(at), step) for x in sort(at[s : s + step], depth + 1)]

    return np.concatenate(sort(np.arange(len(vectors)), 0))


class Tree:
    """Boxes over packed vectors: level 0 are the leaves, each further level joins FAN boxes, the last is the root."""

    def __init__(self, vectors: np.ndarray) -> None:
        # Products of whole numbers below 2^53 are exact as doubles, and faster.
        most = int(np.abs(vectors).max(initial=0))
        self.vectors = vectors = vectors.astype(np.float64) if most and most * most * vectors.shape[1] < 1 << 52 else vectors
        self.most = most
        low = np.minimum.reduceat(vectors, np.arange(0, len(vectors), LEAF))
        high = np.maximum.reduceat(vectors, np.arange(0, len(vectors), LEAF))
        self.levels = [(low, high)]
        while len(low) > 1:
            low, high = np.minimum.reduceat(low, np.arange(0, len(low), FAN)), np.maximum.reduceat(high, np.arange(0, len(high), FAN))
            self.levels.append((low, high))

    def bounds(self, a: np.ndarray, level: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest inner product of ``a`` with any point of each box."""
        low, high = (x[begin:end] for x in self.levels[level])
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        return low @ up + high @ down, high @ up + low @ down

    def search(self, a: np.ndarray, low: np.ndarray, high: np.ndarray, fill: Callable[[np.ndarray, np.ndarray], np.ndarray], least: np.ndarray) -> None:
        """Open boxes, the best bound first, while one may hold a score within a window low..high that is not below the window's ``least``.

        ``fill`` gets the places and scores of a leaf and returns the new ``least`` of each window.
        """
        top = len(self.levels) - 1
        lower, upper = self.bounds(a, top, 0, 1)
        queue = [(-int(upper[0]), top, 0, int(lower[0]))]
        while queue:
            bound, level, at, under = heapq.heappop(queue)
            wanted = np.maximum(low, least)
            if -bound < wanted.min():
                break
            if not ((wanted <= -bound) & (high >= under)).any():
                continue
            if level == 0:
                leaf = slice(at * LEAF, (at + 1) * LEAF)
                least = fill(np.arange(len(self.vectors))[leaf], self.vectors[leaf] @ a)
                continue
            begin, end = at * FAN, min((at + 1) * FAN, len(self.levels[level - 1][0]))
            lower, upper = self.bounds(a, level - 1, begin, end)
            wanted = np.maximum(low, least)
            for k in np.flatnonzero((wanted[None, :] <= upper[:, None]).any(1)):
                heapq.heappush(queue, (-int(upper[k]), level - 1, begin + int(k), int(lower[k])))


class Best:
    """The k best (score, id) of each window of one anchor; ``skip`` is the anchor's own id, left out once where its own vector stands."""

    def __init__(self, tree: Tree, a: np.ndarray, high: np.ndarray, least: np.ndarray, k: int, fits: np.ndarray, ids: list, skip: int | None) -> None:
        self.tree, self.a, self.high, self.least, self.k, self.fits, self.ids, self.skip = tree, a, high, least.copy(), k, fits, ids, skip
        self.found: list[list[tuple[int, int]]] = [[] for _ in high]

    def fill(self, places: np.ndarray, scores: np.ndarray) -> np.ndarray:
        inside = self.fits[places][None, :] & (scores[None, :] >= self.least[:, None]) & (scores[None, :] <= self.high[:, None])
        for w in np.flatnonzero(inside.any(1)):
            mine = self.found[w]
            for k in np.flatnonzero(inside[w]):
                ids = self.ids[places[k]].tolist()
                if self.skip is not None and self.skip in ids and np.array_equal(self.tree.vectors[places[k]], self.a):
                    ids.remove(self.skip)
                mine += [(-int(scores[k]), i) for i in ids[: self.k]]
            mine.sort()
            del mine[self.k :]
            if len(mine) == self.k:
                self.least[w] = max(self.least[w], -mine[-1][0])
        return self.least


def index(points: DataFrame) -> DataFrame:
    """Every class in its block: (block, pos, v, label, ids), and with the first row of each block its box (low, high)."""
    n = points.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = points.select("v").filter(F.xxhash64("v") <= int(share * 2**64) - 2**63 - (share == 1)).toPandas()["v"]
    cuts = {}
    for dim, part in sample.groupby(sample.map(len)):
        if dim:
            vectors = stacked(part)
            cuts[dim] = tiles(vectors, min(TILES, round(len(part) / share / BLOCK)), np.argsort(-vectors.var(0), kind="stable").tolist())

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, part in f.groupby(f["v"].map(len)):
                at = tile_of(stacked(part["v"]), cuts.get(dim, []))
                yield part.assign(tile=[f"{dim}:{k}" for k in at])

    tiled = cut(points.mapInPandas(place, "v array<int>, label long, ids array<long>, tile string"), "tiled")
    parts = tiled.groupBy("tile").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("v", "label"), "parts")
    blocks = tiled.join(parts, "tile").select(F.concat_ws(":", "tile", part).alias("block"), "v", "label", "ids")

    def packed(f: pd.DataFrame) -> pd.DataFrame:
        vectors = stacked(f["v"])
        order = pack(vectors, LEAF)
        f = f.iloc[order].assign(pos=np.arange(len(f)))
        none = [None] * (len(f) - 1)
        return f.assign(low=[vectors.min(0).tolist(), *none], high=[vectors.max(0).tolist(), *none])

    return blocks.groupBy("block").applyInPandas(packed, "block string, v array<int>, label long, ids array<long>, pos int, low array<int>, high array<int>")


def _bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


ROUTE_COLUMNS = ("aid", "g", "id", "label", "v", "low", "high", "least", "block", "upper")
ROUTE = "aid long, g int, id long, label long, v array<int>, low array<long>, high array<long>, least array<long>, block string, upper long"


def routes(anchors: DataFrame, boxes: DataFrame, groups: int, first: bool) -> DataFrame:
    """(anchor, block): the blocks that may hold a score within a window of an anchor, or (``first``) the one of the highest bound.

    Anchors come in groups of about ANCHORS, boxes in groups of about BOXES; every
    group meets every group of boxes, as anchors are a stated query set.
    """
    chunks = max(1, -(-boxes.count() // BOXES))
    left = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = boxes.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, own in a.groupby(a["v"].map(len)):
            fit = b[b["low"].map(len) == dim]
            if not len(fit):
                continue
            lower, upper = _bounds(stacked(own["v"]), stacked(fit["low"]), stacked(fit["high"]))
            for k, row in enumerate(own.itertuples(index=False)):
                if first:
                    hits = [int(upper[k].argmax())]
                else:
                    wanted = np.maximum(row.low, row.least)
                    hits = np.flatnonzero(((wanted[None, :] <= upper[k][:, None]) & (np.asarray(row.high)[None, :] >= lower[k][:, None])).any(1))
                out += [(row.aid, row.g, row.id, row.label, row.v, row.low, row.high, row.least, fit["block"].iloc[h], int(upper[k][h])) for h in hits]
        return pd.DataFrame(out, columns=["aid", "g", "id", "label", "v", "low", "high", "least", "block", "upper"])

    return left.groupBy("g", "chunk").cogroup(right.groupBy("g", "chunk")).applyInPandas(meet, ROUTE)


def search(routed: DataFrame, points: DataFrame, k: int, same: bool) -> DataFrame:
    """(aid, w, score, id): the k best of each window in each block, of the anchor's label or of all others."""
    wanted = cut(routed, "routes")
    pairs = wanted.select(F.col("block").alias("in_block"), F.col("g").alias("for_g")).distinct()
    needed = points.select(F.col("block").alias("in_block"), "pos", "v", "label", "ids").join(pairs, "in_block")

    def look(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("pos")
            tree, labels, ids = Tree(stacked(b["v"])), b["label"].to_numpy(), b["ids"].to_list()
            for row in a.itertuples(index=False):
                v, low, high = (np.asarray(x, np.int64) for x in (row.v, row.low, row.high))
                least = np.maximum(low, np.asarray(row.least, np.int64))
                best = Best(tree, v, high, least, k, (labels == row.label) == same, ids, row.id if same else None)
                tree.search(v, low, high, best.fill, least)
                out += [(row.aid, w, -score, i) for w, found in enumerate(best.found) for score, i in found]
        return pd.DataFrame(out, columns=["aid", "w", "score", "id"])

    return wanted.groupBy("block", "g").cogroup(needed.groupBy("in_block", "for_g")).applyInPandas(look, "aid long, w int, score long, id long")


def _merged(hits: DataFrame, k: int, rank: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("aid", "w").orderBy(F.desc("score"), "id"))
    return hits.withColumn(rank, at).filter(F.col(rank) <= k)


def mine(df: DataFrame, key: str, vector: str, label: Column, anchor: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` is a predicate over ``id``. An anchor's positives are the other rows of
    its label with the highest scores, its negatives for each positive the rows of
    other labels with the highest scores between the two percentages of ``window`` of
    the positive's score.
    """
    rows = cut(whole_vectors(df, key, vector, label, scale), "vectors")
    points = cut(index(cut(classes(rows, max(positives + 1, negatives)), "classes")), "index")
    boxes = cut(points.filter("pos = 0").select("block", "low", "high"), "boxes")
    asked = cut(rows.filter(anchor).groupBy("id", "label", "v").agg(F.count("*").alias("times")).withColumn("aid", F.monotonically_increasing_id()), "anchors")
    groups = max(1, -(-asked.count() // ANCHORS))
    longs = lambda x: F.array(F.lit(x).cast("long"))
    asked = asked.withColumn("g", F.pmod(F.xxhash64("aid"), F.lit(groups)).cast("int"))
    open_ = asked.select("aid", "g", "id", "label", "v", longs(NEVER).alias("low"), longs(-NEVER).alias("high"), longs(NEVER).alias("least"))

    best = routes(open_, boxes, groups, True).groupBy("aid").agg(F.max_by(F.struct(*(c for c in ROUTE_COLUMNS)), F.struct("upper", "block")).alias("r")).select("r.*")
    begun = cut(best, "first")
    hits = cut(_merged(search(begun, points, positives, True), positives, "at"), "seeds")
    least = hits.filter(F.col("at") == positives).select("aid", F.array("score").alias("found"))
    later = routes(open_.join(least, "aid", "left").withColumn("least", F.coalesce("found", "least")).drop("found"), boxes, groups, False).join(begun.select("aid", "block"), ["aid", "block"], "left_anti")
    found = _merged(hits.drop("at").unionByName(search(later.select(*ROUTE_COLUMNS), points, positives, True)), positives, "w2")
    chosen = found.select("aid", (F.col("w2") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    least_of, most_of = F.expr(f"CAST(-floor(CAST(-positive_score * {window[0]} AS DECIMAL(38, 0)) / 100) AS LONG)"), F.expr(f"CAST(floor(CAST(positive_score * {window[1]} AS DECIMAL(38, 0)) / 100) AS LONG)")
    chosen = cut(chosen.withColumn("low", least_of).withColumn("high", most_of), "positives")
    windows = chosen.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("w", "low", "high"))).alias("ws")).select("aid", F.col("ws.low").alias("low"), F.col("ws.high").alias("high"), F.transform("ws", lambda x: F.lit(NEVER).cast("long")).alias("least"))
    narrow = asked.select("aid", "g", "id", "label", "v").join(windows, "aid").select("aid", "g", "id", "label", "v", "low", "high", "least")
    against = _merged(search(routes(narrow, boxes, groups, False), points, negatives, False), negatives, "rank")
    answers = against.select("aid", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(chosen.select("aid", "w", "positive_id", "positive_score"), ["aid", "w"])
    each = asked.select("aid", F.col("id").alias("anchor_id"), F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("copy"))
    return answers.join(each, "aid").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
