"""The property graph: nodes, edges, neighbourhoods, common neighbours, shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as X
from graphloom.sources.scratch import settled


def node_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of both; where a key is in both, the new row's non-null values win."""
    rest = [c for c in new.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key, "full")
    return joined.select(key, *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in rest))


def lookup_nodes(df: DataFrame, column: str, sep: str = "/") -> DataFrame:
    """Distinct tokens of a delimited column."""
    return df.select(F.explode(X.split_tokens(F.col(column), sep)).alias("name")).distinct()


def valid_edges(edges: DataFrame, ends: dict[str, DataFrame]) -> DataFrame:
    """Edges both of whose ends exist; ``ends`` maps an edge column to the frame with that key."""
    for column, nodes in ends.items():
        edges = edges.join(nodes.select(column).distinct(), column, "left_semi")
    return edges


def lookup_edges(items: DataFrame, key: str, column: str, sep: str = "/") -> DataFrame:
    """(key, name, rel) from items to the tokens of a delimited column, one per pair."""
    return items.select(key, F.explode(X.split_tokens(F.col(column), sep)).alias("name")).distinct().withColumn("rel", F.lit(column))


def credits_of(raw: DataFrame, key: str, column: str) -> DataFrame:
    """(pid, key, ord) from 'name:id|…': the largest position of repeated credits."""
    items = raw.select(key, F.explode(X.named_ids(F.col(column))).alias("c"))
    return items.groupBy(F.col("c.pid").alias("pid"), key).agg(F.max("c.ord").alias("ord"))


def triples(edges: dict[str, tuple[DataFrame, str, str, str, str]], inverse: bool = True) -> DataFrame:
    """(h, r, t) of relation: (frame, head column, head kind, tail column, tail kind), with inverses."""
    out = None
    for r, (df, h, hk, t, tk) in edges.items():
        one = df.select(X.entity_key(F.lit(hk), F.col(h)).alias("h"), F.lit(r).alias("r"), X.entity_key(F.lit(tk), F.col(t)).alias("t")).distinct()
        if inverse:
            one = one.union(one.select(F.col("t").alias("h"), F.concat("r", F.lit("_REV")).alias("r"), F.col("h").alias("t")))
        out = one if out is None else out.union(one)
    return out


def degrees(tokens: DataFrame) -> DataFrame:
    """(rel, entity, degree) of (mid, rel, entity)."""
    return tokens.groupBy("rel", "entity").agg(F.count("*").alias("degree"))


def collaborators(acted: DataFrame, pid: str, limit: int) -> DataFrame:
    """Those with most films in common with a person."""
    own = acted.filter(F.col("pid") == pid).select("mid").distinct()
    other = acted.filter(F.col("pid") != pid).join(own, "mid", "left_semi")
    return other.groupBy("pid").agg(F.count_distinct("mid").alias("n")).orderBy(F.desc("n"), "pid").limit(limit)


def common(acted: DataFrame, a: str, b: str) -> DataFrame:
    """Films of both persons."""
    one, two = (acted.filter(F.col("pid") == p).select("mid") for p in (a, b))
    return one.intersect(two)


def pairs(edges: DataFrame, item: str, key: str, sample: DataFrame | None = None) -> DataFrame:
    """(a, b, n): how many items each pair of keys shares, a < b. Bounded by a sample of items if given."""
    if sample is not None:
        edges = edges.join(sample, item, "left_semi")
    one, two = edges.select(item, F.col(key).alias("a")), edges.select(item, F.col(key).alias("b"))
    return one.join(two, item).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def neighbourhood(edges: DataFrame, centre: str, node_limit: int, per_node: int) -> DataFrame:
    """(hop, src, dst) around a node of undirected (src, dst) edges: all neighbours up to a limit, then the first few of each."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = both.filter(F.col("src") == centre).orderBy("dst").limit(node_limit)
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    start = near.select(F.col("dst").alias("src"))
    far = both.join(F.broadcast(start), "src", "left_semi").filter(F.col("dst") != centre).withColumn("k", rank).filter(F.col("k") <= per_node)
    return near.select(F.lit(1).alias("hop"), "src", "dst").union(far.select(F.lit(2), "src", "dst"))


#: Pairs in one word of bits, and pairs numbered in one partition.
WORD, NUMBERED = 64, 1 << 16


def shortest_paths(edges: DataFrame, asked: DataFrame, most: int = 6) -> DataFrame:
    """(start, goal, hops, path) of a shortest undirected path of at most ``most`` edges for each asked pair (start, goal); no row where there is none.

    All pairs are searched at once from both sides. A frontier row is a node and a word
    of 64 pairs, whose bits say which of them have reached the node, so a step makes at
    most a row per edge and word, however many pairs come over the same hub. In each step the side
    with fewer rows grows by one level, so hubs in the middle
    are reached by the cheaper side. A pair is done when its sides meet, and takes no part in further
    steps. Of several shortest paths the one is chosen that, read from the goal
    back, takes the smallest node of each level, as a search from the start alone would.
    """
    links = settled(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL"), "edges")  # repeated ones add nothing to a word
    both = links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    pairs = settled(asked.select("start", "goal").filter("start IS NOT NULL AND goal IS NOT NULL").distinct(), "asked")
    key = ["node", "word"]
    same = pairs.filter("start = goal").select("start", "goal", F.lit(0).alias("hops"), F.array("start").alias("path"))
    live = pairs.filter("start <> goal")
    numbered = live.repartition(live.count() // NUMBERED + 1).withColumn("id", F.monotonically_increasing_id())
    live = settled(numbered.select("start", "goal", F.floor(F.col("id") / WORD).alias("word"), (F.col("id") % WORD).cast("int").alias("bit")).withColumn("bits", F.expr("shiftleft(1L, bit)")), "pairs")
    sides = {name: [settled(_words(live.select(F.col(name).alias("node"), "word", "bits")), "frontier")] for name in ("start", "goal")}
    sizes = dict.fromkeys(sides, 1)
    out = same
    for hops in range(1, most + 1):
        grown, rest = sorted(sides, key=lambda name: (sizes[name], name != "start"))
        step = _words(sides[grown][-1].join(both.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node"), "word", "bits"))
        for before in sides[grown][-2:]:  # a neighbour of a level is in it, the one before or the next
            step = step.join(before.withColumnRenamed("bits", "old"), key, "left").select(*key, F.expr("bits & ~coalesce(old, 0L)").alias("bits"))
        level = settled(step.filter("bits <> 0"), "frontier")
        met = settled(_common(level, sides[rest][-1]), "met")
        sides[grown].append(level)
        found = settled(met.groupBy("word").agg(F.bit_or("bits").alias("found")), "found")
        if found.limit(1).count():
            out = out.union(_paths(both, sides, met, live.join(found, "word").filter("bits & found <> 0").drop("found"), hops))
            sides = {name: [*levels[:-1], settled(levels[-1].join(found, "word", "left").select(*key, F.expr("bits & ~coalesce(found, 0L)").alias("bits")).filter("bits <> 0"), "frontier")] for name, levels in sides.items()}
        sizes = {name: levels[-1].count() for name, levels in sides.items()}
        if not all(sizes.values()):
            break
    return out


def _words(rows: DataFrame) -> DataFrame:
    """(node, word, bits) with one row per node and word."""
    return rows.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))


def _common(one: DataFrame, two: DataFrame) -> DataFrame:
    """The bits that are in both."""
    joined = one.join(two.withColumnRenamed("bits", "other"), ["node", "word"])
    return joined.withColumn("bits", F.col("bits").bitwiseAND(F.col("other"))).drop("other").filter("bits <> 0")


def _paths(both: DataFrame, sides: dict[str, list[DataFrame]], met: DataFrame, pairs: DataFrame, hops: int) -> DataFrame:
    """The chosen paths of pairs whose sides met in the nodes of ``met``."""
    half = len(sides["start"]) - 1
    # From the meeting nodes towards the goal: which nodes of each level lie on a shortest path.
    on_path = [met]
    for level in reversed(sides["goal"][:-1]):
        beside = level.join(both.withColumnRenamed("src", "node"), "node").select(F.col("node").alias("next"), F.col("dst").alias("node"), "word", "bits")
        on_path.append(settled(_words(_common(beside, on_path[-1]).select(F.col("next").alias("node"), "word", "bits")), "on-path"))
    levels = [*sides["start"][:half], *on_path]  # the place of a level is its distance from the start
    walked = settled(pairs.select("*", F.col("goal").alias("at"), F.array("goal").alias("path")), "walked")
    each = F.explode(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("getbit", "bits", i) == 1)).alias("bit")
    for level in reversed(levels[:-1]):
        ends = _words(walked.select(F.col("at").alias("node"), "word", "bits"))
        beside = ends.join(both.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node"), "word", "bits")
        smallest = _common(beside, level).select("node", "word", each).groupBy("word", "bit").agg(F.min("node").alias("before"))
        walked = settled(walked.join(smallest, ["word", "bit"]).select("start", "goal", "word", "bit", "bits", F.col("before").alias("at"), F.concat(F.array("before"), "path").alias("path")), "walked")
    return walked.select("start", "goal", F.lit(hops).alias("hops"), "path")


def shortest_path(edges: DataFrame, start: str, goal: str, most: int = 6) -> DataFrame:
    """One row (hops, path) of a shortest undirected path between two nodes; no row if there is none."""
    asked = edges.sparkSession.createDataFrame([(start, goal)], "start string, goal string")
    return shortest_paths(edges, asked, most).select("hops", "path")


def path_parts(path: DataFrame) -> DataFrame:
    """(pos, src, dst) of the edges of each path."""
    at = F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("pos", "src")
    return path.select("path", at).select("pos", "src", F.get("path", F.col("pos") + 1).alias("dst"))


def public_path(path: DataFrame, allowed: list[str]) -> DataFrame:
    """Paths whose nodes are all of allowed kinds (the part before the first '_')."""
    return path.filter(F.forall("path", lambda n: F.split(n, "_")[0].isin(allowed)))


def drop_hidden(nodes: DataFrame, edges: DataFrame, hidden: list[str]) -> DataFrame:
    """Edges left when nodes of hidden kinds go."""
    kept = nodes.filter(~F.col("kind").isin(hidden)).select("id")
    return edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")


def visible_degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) over both ends."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def merged_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges as one with the sorted list of their labels."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.array_sort(F.collect_set("label")).alias("labels"))


#: Properties that each kind of node shows.
PUBLIC_PROPERTIES = {"movie": ["name", "year", "score"], "person": ["name", "birthplace"], "genre": ["name"]}


def node_payload(nodes: DataFrame) -> DataFrame:
    """(id, kind, label, properties) from (kind, key, properties): only public properties; the label is the name or else the key."""
    props = F.map_filter("properties", lambda k, v: _public(F.col("kind"), k) & v.isNotNull())
    label = F.coalesce(F.try_element_at("properties", F.lit("name")), F.col("key"))
    return nodes.select(F.concat_ws("_", "kind", "key").alias("id"), "kind", label.alias("label"), props.alias("properties"))


def _public(kind, name):
    shown = F.lit(False)
    for k, names in PUBLIC_PROPERTIES.items():
        shown = shown | ((kind == k) & name.isin(names))
    return shown


def truncated(df: DataFrame, limit: int, *order: str) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` rows, and one row (n, truncated) about all."""
    return df.orderBy(*order).limit(limit), df.agg(F.count("*").alias("n"), (F.count("*") > limit).alias("truncated"))
