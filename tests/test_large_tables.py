"""Plans that hold on large tables: small tables with the same results, and without what grows too fast."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("lines", "want"), [([1, 2, 2], 2), ([1, None], 0), ([], 5)])
def test_not_in_without_a_broadcast_of_all_lines(spark, tmp_path, lines, want):
    """Nulls count as in SQL; the anti join is by equality, not by null-aware broadcast."""
    spark.createDataFrame([(k,) for k in (1, 2, 3, 4, None)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k,) for k in lines], "l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = __spark_entry__.queries()["j5_not_in"](spark, str(tmp_path))
    assert df.collect()[0].n == want and df.schema["n"].dataType.simpleString() == "bigint"
    assert "isnull" not in plan(df).lower().split("leftanti")[1].split("\n")[0]


def test_similarity_makes_no_row_per_pair_of_a_list(spark):
    """Lists in several blocks and items with many raters give what all pairs give; no join makes their pairs."""
    import random
    from collections import defaultdict

    from graphloom.operators import recommend as R

    rng = random.Random(4)
    rows = [(u, f"m{m}", rng.randrange(1, 11)) for u in range(60) for m in rng.sample(range(40), rng.randrange(1, 30))]
    ratings = spark.createDataFrame(rows, "uid long, mid string, h int")
    lists, norm, dots = defaultdict(list), defaultdict(int), defaultdict(list)
    for u, m, h in rows:
        lists[u].append((m, h))
        norm[m] += h * h
    for one in lists.values():
        for a, x in one:
            for b, y in one:
                if a != b:
                    dots[a, b].append(x * y)
    want = {(a, b, int(sum(d) / (norm[a] * norm[b]) ** 0.5 * 1e6 + 0.5)) for (a, b), d in dots.items() if len(d) >= 2}
    for size, raters in ((2048, 4096), (7, 5)):
        found = R.item_similarity(ratings, size=size, most_raters=raters)
        assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "hb" not in plan(found) and "MapInArrow" in plan(found)


def test_one_hop_makes_no_row_per_pair_of_films(spark, monkeypatch):
    """Films over shared people, with lists in several blocks and batches cut: the same as by all pairs."""
    import random

    from graphloom.functions import scalars as X
    from graphloom.operators import recommend as R

    monkeypatch.setattr(R, "ENTITY_BLOCK", 4)
    monkeypatch.setattr(R, "ADDED", 16)
    rng = random.Random(6)
    tokens = sorted({(f"m{m}", rel, f"p{rng.randrange(25)}") for m in range(60) for rel in R.PEOPLE for _ in range(rng.randrange(9))})
    rows = spark.createDataFrame(tokens, "mid string, rel string, entity string")
    limits, idf = {"director": 6, "actor": 9}, {(r.rel, r.entity): r.idf6 for r in R.entity_idf(rows).collect()}
    own = {}
    for m, rel, e in tokens:
        own.setdefault((m, rel), set()).add(e)
    want = set()
    for (seed, rel), es in own.items():
        met = sorted(((len(es & fs), m, sorted(es & fs)[:5]) for (m, r), fs in own.items() if r == rel and m != seed and es & fs), reverse=True)
        want |= {(seed, rel, m, hits, sum(idf[rel, e] for e in first) // len(first)) for hits, m, first in met[: limits[rel]]}
    found = R.one_hop(rows, limits)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "MapInArrow" in plan(found)


def test_content_makes_no_row_per_user_and_class(spark, monkeypatch):
    """Classes met in several groups and blocks, with ties and seen items: the same as by all pairs."""
    import random

    from graphloom.operators import recommend as R

    monkeypatch.setattr(R, "TASTED", 3)
    monkeypatch.setattr(R, "CLASSED", 5)
    rng = random.Random(8)
    bags = {f"m{m:02d}": sorted(rng.sample("abcdef", rng.randrange(1, 4))) for m in range(70)}
    likes = [(u, m, rng.choice((70, 80, 100))) for u in range(20) for m in rng.sample(sorted(bags), rng.randrange(1, 5))]
    known = sorted({(u, m) for u, m, _ in likes} | {(u, m) for u in range(20) for m in rng.sample(sorted(bags), 12)})
    unit = {m: int(10000 / len(b) ** 0.5 + 0.5) for m, b in bags.items()}
    want = set()
    for u in range(20):
        taste = dict.fromkeys("abcdef", 0)
        for v, m, w in likes:
            for t in bags[m] if u == v else ():
                taste[t] += w * unit[m]
        long = sum(t * t for t in taste.values()) ** 0.5
        scores = [(-int(sum(taste[t] for t in b) * unit[m] / long / 10000.0 * 10000.0 + 0.5) / 10000.0, m) for m, b in bags.items() if (u, m) not in known]
        want |= {(u, m, -s, k) for k, (s, m) in enumerate(sorted(x for x in scores if x[0] < 0)[:7], 1)}
    seeds, seen = spark.createDataFrame(likes, "uid long, mid string, weight100 long"), spark.createDataFrame(known, "uid long, mid string")
    tokens = spark.createDataFrame([(m, t) for m, b in bags.items() for t in b], "mid string, token string")
    for users, classes in ((8192, 1 << 20), (6, 9)):
        found = R.content_top(seeds, tokens, 7, seen, users, classes)
        assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "FlatMapCoGroupsInPandas" in plan(found)


def test_two_hop_makes_no_row_per_step(spark):
    """Seeds in several groups: the same as by walking all paths."""
    import random

    from graphloom.functions import scalars as X
    from graphloom.operators import recommend as R

    rng = random.Random(9)
    billed = {f"m{m:02d}": rng.sample([f"p{p:02d}" for p in range(18)], rng.randrange(1, 6)) for m in range(50)}
    actors = spark.createDataFrame([(m, p, k) for m, ps in billed.items() for k, p in enumerate(ps, 1)], "mid string, pid string, ord int")
    idf = {r.pid: r.v for r in actors.groupBy("pid").agg(R.micro(X.idf(F.count("*"))).alias("v")).collect()}
    degree = {p: sum(p in ps for ps in billed.values()) for p in idf}
    kept = {m: sorted(ps, key=lambda p: (degree[p], ps.index(p), p))[:3] for m, ps in billed.items()}
    want = set()
    for seed in billed:
        reach = {}
        for a in kept[seed]:
            for bridge in billed:
                for b in kept[bridge] if bridge != seed and a in billed[bridge] else ():
                    if a != b:
                        reach.setdefault(b, set()).add(bridge)
        over = {m: [b for b in ps if reach.get(b, set()) - {m}] for m, ps in billed.items() if m != seed}
        best = sorted(((len(bs), m) for m, bs in over.items() if bs), reverse=True)[:4]
        want |= {(seed, m, n, sum(idf[b] for b in over[m][:3]) // len(over[m][:3])) for n, m in best}
    for group in (8192, 7):
        found = R.two_hop(actors, 4, group=group)
        assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "FlatMapCoGroupsInPandas" in plan(found)


def test_negatives_make_no_row_per_draw(spark):
    """Draws are lists; a user with few unrated items and a test item outside the catalogue get what draws one by one give."""
    import hashlib

    from graphloom.operators import evaluate as E

    mids = [f"m{k:02d}" for k in range(40)]
    rated = {u: set(mids[u : u + 3 * u]) for u in range(12)} | {12: set(mids[:36])}
    tests = {u: sorted(r)[0] if r else "gone" for u, r in rated.items()}
    numbered = sorted(mids, key=lambda m: (hashlib.md5(m.encode()).hexdigest(), m))
    draw = lambda *p: hashlib.md5(":".join(map(str, p)).encode()).hexdigest()
    want = set()
    for u, out in rated.items():
        for tries in (10, 160):
            free = dict.fromkeys(numbered[int(draw(3, u, t)[:8], 16) % 40] for t in range(tries))
            free = [m for m in free if m not in out and m != tests[u]][:5]
            if len(free) == 5:
                want |= {(u, m, k) for k, m in enumerate(free, 1)}
                break
    ratings = spark.createDataFrame([(u, m) for u, r in rated.items() for m in r], "uid long, mid string")
    found = E.negatives(spark.createDataFrame(list(tests.items()), "uid long, test_mid string"), spark.createDataFrame([(m,) for m in mids], "mid string"), ratings, 5, 3)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_candidates_make_no_row_per_shared_key(spark):
    """What candidates share with users' tastes, in several groups; those that share nothing have no row."""
    import random

    from graphloom.operators import recommend as R

    rng = random.Random(3)
    taste = {(u, k): rng.randrange(1, 10**9) for u in range(15) for k in rng.sample(range(30), 6)}
    held = [(f"m{m}", rng.randrange(30)) for m in range(25) for _ in range(rng.randrange(5))]
    pairs = sorted({(rng.randrange(17), f"m{rng.randrange(27)}") for _ in range(150)})
    want = {(u, m, sum(taste[u, k] for x, k in held if x == m and (u, k) in taste)) for u, m in pairs if any(x == m and (u, k) in taste for x, k in held)}
    rows = [spark.createDataFrame(r, s) for r, s in (([(*k, t) for k, t in taste.items()], "uid long, key long, t long"), (held, "mid string, key long"), (pairs, "uid long, mid string"))]
    for users in (1024, 2):
        found = R.shared_worth(*rows, users)
        assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "FlatMapCoGroupsInPandas" in plan(found)


def test_shared_audience_makes_no_row_per_pair_of_items(spark):
    """Seeds whose bridge users' lists come in several batches: the same as by all pairs; what users get are the unseen items."""
    import random
    from collections import defaultdict

    from graphloom.functions import scalars as X
    from graphloom.operators import recommend as R

    rng = random.Random(11)
    likes = {u: {f"m{m}": rng.choice((70, 80, 100)) for m in rng.sample(range(30), rng.randrange(1, 12))} for u in range(40)}
    index = spark.createDataFrame([(u, m, w, len(own)) for u, own in likes.items() for m, w in own.items()], "uid long, mid string, weight100 long, degree long")
    pen = {r.degree: r.v for r in index.select("degree", R.micro(X.idf(F.col("degree"))).alias("v")).distinct().collect()}
    want = set()
    for seed in {m for own in likes.values() for m in own}:
        lead = sorted(((own[seed] * pen[len(own)], str(u), u) for u, own in likes.items() if seed in own), reverse=True)[:5]
        found = defaultdict(lambda: [0, 0])
        for worth, _, u in lead:
            for m, w in likes[u].items():
                if m != seed:
                    found[m][0] += worth * w
                    found[m][1] += 1
        want |= {(seed, m, s, n) for s, n, m in sorted(((s, n, m) for m, (s, n) in found.items()), reverse=True)[:6]}
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        audience = R.shared_audience(index, 5, 6)
        assert sorted(map(tuple, audience.collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert "MapInArrow" in plan(audience)
    seeds = [(u, m) for u, own in likes.items() for m in sorted(own)[:3]]
    seen = sorted({(u, m) for u, own in likes.items() for m in own} | {(u, f"m{rng.randrange(30)}") for u in range(45)})
    met = defaultdict(int)
    for u, seed in seeds:
        for s, m, _, n in want:
            if s == seed and (u, m) not in seen:
                met[u, m] = max(met[u, m], n)
    hits = R.audience_hits(spark.createDataFrame(seeds, "uid long, mid string"), audience, spark.createDataFrame(seen, "uid long, mid string"), 5000)
    assert sorted(map(tuple, hits.collect())) == sorted((u, m, n) for (u, m), n in met.items())
    assert "LeftAnti" not in plan(hits)


def test_co_rating_ranks_users_without_a_row_per_candidate(spark):
    """The best unseen items with their best seeds: the same as by joining seeds and similar items."""
    import random

    from graphloom.operators import recommend as R

    rng = random.Random(12)
    rated = {u: {f"m{m}": rng.randrange(1, 11) for m in rng.sample(range(35), rng.randrange(2, 15))} for u in range(40)}
    ratings = spark.createDataFrame([(u, m, h) for u, own in rated.items() for m, h in own.items()], "uid long, mid string, h int")
    seeds = spark.createDataFrame([(u, m, h * 10) for u, own in rated.items() for m, h in own.items() if h >= 7], "uid long, mid string, weight100 long")
    seen = ratings.select("uid", "mid").union(spark.createDataFrame([(u, f"m{rng.randrange(40)}") for u in range(50)], "uid long, mid string")).distinct()
    all_ = R.item_cf(seeds, R.item_similarity(ratings))
    want = R.top_per_user(all_, 6, "raw", seen).join(all_.select("uid", "mid", "best_seed"), ["uid", "mid"])
    found = R.item_cf_top(seeds, ratings, 6, seen)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "LeftAnti" not in plan(found) and "MapInArrow" in plan(found)


def test_profiles_make_no_row_per_item_and_entity(spark):
    """Counts and means of rated items per entity, with ties and unrated items: the same as by all pairs."""
    import random

    from graphloom.operators import signals as S

    rng = random.Random(13)
    held = {f"m{m}": rng.sample([f"p{p}" for p in range(14)], rng.randrange(5)) for m in range(30)}
    likes = [(u, m, rng.choice((None, 7, 8, 9, 10))) for u in range(25) for m in rng.sample(sorted(held), rng.randrange(1, 12))]
    want = set()
    for u in range(25):
        found = {}
        for v, m, h in likes:
            for e in held[m] if u == v else ():
                found.setdefault(e, []).append(h)
        for e, hs in sorted(found.items(), key=lambda x: (-len(x[1]), x[0]))[:6]:
            rated = [h for h in hs if h is not None]
            want.add((u, e, len(hs), int(sum(rated) / len(rated) * 100 + 0.5) / 100 if rated else None))
    tokens = spark.createDataFrame([(m, e) for m, es in held.items() for e in es], "mid string, entity string")
    found = S.liked_entities(spark.createDataFrame(likes, "uid long, mid string, h int"), tokens, 6)
    assert set(map(tuple, found.collect())) == want and found.count() == len(want)
    assert "MapInArrow" in plan(found)


def test_pages_are_read_in_pieces(spark, monkeypatch):
    """Elements of few pages are held at a time: pieces of a batch, and null and empty pages, give the same elements; a user's rows are pages of at most PER_PAGE."""
    import pandas as pd

    from graphloom.functions import markup

    monkeypatch.setattr(markup, "LETTERS", 40)
    picks = (markup.Pick("b", "b"),)
    pages = pd.Series(["<b>x</b>" * (k % 4) for k in range(30)] + [None, ""])
    pieces = list(markup._reader(picks).func(iter([pages, pages.iloc[:1]])))
    assert len(pieces) > 5
    assert pd.concat(pieces).to_list() == [None if p is None else markup.elements(p, picks) for p in [*pages, pages[0]]]


def test_listed_tastes_rank_as_rows_do(spark):
    """Tastes as lists, without entities that no film with a vector has: the same ranking; no aggregate per user and entity."""
    import random

    from graphloom.operators import recommend as R
    from graphloom.operators.exact_rank import embed_top

    rng = random.Random(14)
    films = [f"m{m:02d}" for m in range(30)]
    tokens = spark.createDataFrame([(m, rel, f"e{e}") for m in films for rel in ("director", "genre") for e in rng.sample(range(9), 2)], "mid string, rel string, entity string")
    vectors = spark.createDataFrame([(m, [rng.randrange(-9, 10) for _ in range(4)] + [1]) for m in films[:20]], "mid string, vec array<int>")
    rows = [(u, m, rng.choice((70, 90))) for u in range(12) for m in rng.sample(films, 4)]
    seeds = spark.createDataFrame(rows, "uid long, mid string, weight100 long")
    seen = seeds.select("uid", "mid")
    rank = lambda taste: sorted(map(tuple, embed_top(seeds, taste, tokens, vectors, 5, seen, None, R.EMBED_WEIGHTS, 8, 5).collect()))
    listed = R.listed_taste(seeds, tokens, vectors)
    assert rank(listed) == rank(R.overlap_taste(seeds, tokens))
    assert listed.count() == len({u for u, m, _ in rows if m in films[:20]})


def test_paths_make_no_row_per_pair_and_hub_neighbour(spark, monkeypatch):
    """Pairs that come over the same hubs share the rows of their neighbours; the paths are those of each pair alone."""
    from graphloom.operators import graph as G

    links = [(f"f{k:03d}", f"g{k % 2}") for k in range(200)] + [(f"f{k:03d}", "h") for k in (0, 101)] + [("f001", "f150")]
    edges = spark.createDataFrame(links, "src string, dst string")
    asked = [(f"f{k:03d}", f"f{k + 101:03d}") for k in range(80)]
    kept, settled = {}, G.settled

    def keep(df, name):
        kept.setdefault(name, []).append(settled(df, name))
        return kept[name][-1]

    monkeypatch.setattr(G, "settled", keep)
    rows = {(r.start, r.goal): (r.hops, r.path) for r in G.shortest_paths(edges, spark.createDataFrame(asked, "start string, goal string"), 6).collect()}
    assert max(df.count() for df in kept["frontier"]) <= 2 * 203  # two words of pairs, 203 nodes
    monkeypatch.undo()
    assert len(rows) == 80 and rows["f000", "f101"] == (2, ["f000", "h", "f101"]) and rows["f002", "f103"] == (5, ["f002", "g0", "f150", "f001", "g1", "f103"])
    for a, b in (("f049", "f150"), ("f079", "f180")):
        alone = G.shortest_path(edges, a, b).first()
        assert rows[a, b] == (alone.hops, alone.path)


def test_ratings_have_tasks_as_many_as_lines_need(spark, tmp_path, monkeypatch):
    """More lines make more tasks, not larger ones; the rows are the same."""
    from graphloom.sources import catalog

    spark.range(4000).select("id", (F.col("id") % 800).alias("l_orderkey"), (F.col("id") % 300).alias("l_partkey"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(800).select(F.col("id").alias("o_orderkey"), (F.col("id") % 90).alias("o_custkey"), F.lit("2020-01-01").cast("date").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    few = catalog.Catalog(spark, str(tmp_path)).ratings
    monkeypatch.setattr(catalog, "LINES", 100)
    many = catalog.Catalog(spark, str(tmp_path)).ratings
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    assert many.rdd.getNumPartitions() == 40 and many.columns == few.columns and many.schema == few.schema
