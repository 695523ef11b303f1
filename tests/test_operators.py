"""Small fixtures for operators that SQL can't express, and edge cases of the others."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as X
from graphloom.operators import cohort, evaluate, graph, recommend, signals, upserts
from graphloom.streaming import activity


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def kg(spark):
    return spark.createDataFrame([("movie_a", "person_1"), ("movie_b", "person_1"), ("movie_b", "person_2"), ("movie_c", "person_2"), ("movie_d", "person_3")], "src string, dst string")


def test_shortest_path(kg):
    row = graph.shortest_path(kg, "movie_a", "movie_c").first()
    assert (row["hops"], row["path"]) == (4, ["movie_a", "person_1", "movie_b", "person_2", "movie_c"])
    assert graph.shortest_path(kg, "movie_a", "movie_d").count() == 0
    assert graph.shortest_path(kg, "movie_a", "movie_c", most=3).count() == 0
    assert graph.shortest_path(kg, "movie_a", "movie_a").first()["hops"] == 0


def test_path_through_hidden_kind(spark):
    paths = spark.createDataFrame([(["movie_a", "region_x", "movie_b"],), (["movie_a", "person_1"],)], "path array<string>")
    assert graph.public_path(paths, ["movie", "person"]).count() == 1


def test_signals_need_absence_of_rating(spark):
    ratings = spark.createDataFrame([(1, "m1", 10, None), (1, "m2", 4, None)], "uid long, mid string, h int, rated_at timestamp")
    prefs = spark.createDataFrame([(1, "m2", "want_to_watch", None), (1, "m3", "like", None)], "uid long, mid string, pref_type string, created_at timestamp")
    assert values(signals.positive_signals(ratings, prefs), "mid", "kind", "weight100") == [("m1", "rating", 100), ("m3", "like", 70)]
    index = signals.weight_index(ratings, prefs, spark.createDataFrame([(1, "m1")], "uid long, mid string"))
    assert values(index, "mid", "weight100", "degree") == [("m3", 70, 1)]


def test_item_cf_masks_seen(spark):
    ratings = spark.createDataFrame([(1, "s", 10), (2, "s", 8), (3, "s", 10), (2, "c1", 8), (3, "c1", 10), (1, "c2", 8), (2, "c2", 8)], "uid long, mid string, h int")
    seeds = spark.createDataFrame([(1, "s", 100)], "uid long, mid string, weight100 long")
    top = recommend.top_per_user(recommend.item_cf(seeds, recommend.item_similarity(ratings)), 10, "raw", ratings.select("uid", "mid"))
    assert values(top, "mid", "score") == [("c1", 1.0)]


def test_embedding_components(spark):
    """Centre, strongest seed and the user's own target, against numbers worked out by hand."""
    vectors = recommend.whole_vectors(spark.createDataFrame([("m1", [1.0, 0.0]), ("m2", [1.0, 1.0]), ("m3", [0.0, 0.0]), ("m4", [0.0, 3.0]), ("m5", [-1.0, 0.0])], "mid string, vec array<double>"))
    seeds = spark.createDataFrame([(1, "m1", 100), (1, "m4", 50)], "uid long, mid string, weight100 long")
    pairs = spark.createDataFrame([(1, m) for m in ("m1", "m2", "m3", "m4", "m5", "none")] + [(2, "m1")], "uid long, mid string")
    users = spark.createDataFrame([(1, [0, 10_000])], "uid long, vec array<int>")
    got = {r.mid: (r.centroid6 / 1e6, r.most_seed6 / 1e6, r.relation6 / 1e6) for r in recommend.embedding_components(pairs, seeds, vectors, users).collect()}
    half = 0.5**0.5
    want = {"m1": (2 / 5**0.5, 100, 0), "m2": (3 * half / 5**0.5, 100 * half, half), "m3": (0, 0, 0), "m4": (1 / 5**0.5, 50, 1), "m5": (0, 0, 0)}
    assert set(got) == set(want) and all(got[m] == pytest.approx(want[m], abs=1e-4 if m != "m2" else 1e-2) for m in want)
    flat = recommend.fuse_embedding(pairs.filter("uid = 1"), recommend.embedding_components(pairs, seeds, vectors), spark.createDataFrame([(1, "m1", 7)], "uid long, mid string, overlap long"))
    assert values(flat, "mid", "score")[0] == ("m1", pytest.approx(0.4 * (2 / 5**0.5) / (3 * half / 5**0.5) + 0.2 + 0.4, abs=1e-3))


def test_fusion_formulas(spark):
    schema = "uid long, mid string, score double"
    kg_branch = spark.createDataFrame([(1, "m1", 1.0), (1, "m3", 0.9)], schema)
    cf = spark.createDataFrame([(1, "m1", 0.4), (1, "m2", 1.0)], schema)
    fused = recommend.fuse_branches(kg_branch, cf, 0.6, 0.4, 0.05)
    got = values(fused, "mid", "raw", "sources")
    assert got == [("m1", pytest.approx(1 + 0.4 * 0.4 / 0.6 + 0.05, abs=1e-6), ["kg_embed", "item_cf"]), ("m2", 0.4, ["item_cf"]), ("m3", 0.9, ["kg_embed"])]
    fallback = spark.createDataFrame([(1, "m9", 0.5, 1), (2, "m8", 0.5, 1), (2, "m9", 0.25, 2)], "uid long, mid string, score double, rank int")
    assert values(recommend.fused_top(fused, 2, fallback), "uid", "mid", "score", "sources", "rank") == [(1, "m1", 1.0, ["kg_embed", "item_cf"], 1), (1, "m3", pytest.approx(0.9 / 1.316667, abs=1e-4), ["kg_embed"], 2), (2, "m8", 1.0, ["content"], 1), (2, "m9", 0.5, ["content"], 2)]


def tokens_of(spark, rows):
    return spark.createDataFrame([(m, rel, e) for m, rel, es in rows for e in es], "mid string, rel string, entity string")


def test_paths_of_all_relations(spark):
    """A candidate that only an audience or a bridge actor reaches is found; the strongest relation leads the reasons."""
    tokens = tokens_of(spark, [("s", "director", ["d"]), ("x", "director", ["d"]), ("s", "genre", ["rare", "common"]), ("y", "genre", ["common"]), ("z", "genre", ["common"])])
    hops = recommend.one_hop(tokens)
    assert values(hops.filter("seed = 's'"), "rel", "mid") == [("director", "x")]  # only the rarest genre of a seed counts
    acted = spark.createDataFrame([("s", "a", 1), ("b", "a", 1), ("b", "k", 2), ("t", "k", 1), ("b", "q", 3), ("t", "q", 2)], "mid string, pid string, ord int")
    far = recommend.two_hop(acted)
    assert values(far.filter("seed = 's'"), "mid", "hits") == [("t", 2)]
    index = spark.createDataFrame([(1, "s", 100, 2), (1, "u", 100, 2), (2, "s", 70, 3), (2, "u", 70, 3), (2, "v", 100, 3)], "uid long, mid string, weight100 long, degree long")
    audience = recommend.shared_audience(index)
    found = recommend.path_evidence(hops, far, audience)
    seeds = spark.createDataFrame([(9, "s", 100)], "uid long, mid string, weight100 long")
    scores = {r.mid: r.raw for r in recommend.path_scores(seeds, found).collect()}
    assert set(scores) == {"x", "t", "u", "v"} and scores["u"] > scores["x"] > scores["t"]
    reasons = recommend.path_reasons(seeds.withColumnRenamed("mid", "seed").join(found, "seed"))
    assert values(reasons.filter("mid = 'u'"), "rel", "k") == [("shared_audience", 1)]


def test_one_entity_relations_keep_the_last_ids(spark):
    """The lists of an entity give the same candidates as all pairs, with a shortlist held before the cut."""
    tokens = tokens_of(spark, [(f"m{k:03}", "content_type", [f"t{k % 2}"]) for k in range(40)])
    got = {}
    for r in recommend.one_hop(tokens).collect():
        got.setdefault(r.seed, set()).add(r.mid)
    for k in range(40):
        same = sorted((f"m{j:03}" for j in range(40) if j % 2 == k % 2 and j != k), reverse=True)
        assert got[f"m{k:03}"] == set(same[:5])
    allowed = spark.createDataFrame([("m000",), ("m002",)], "mid string")
    assert values(recommend.one_hop(tokens, allowed=allowed).filter("seed = 'm038'"), "mid") == [("m000",), ("m002",)]


def test_short_codes_and_reasons(spark):
    import hashlib

    from graphloom.functions import scalars as X

    urls = [f"https://e.org/{k}" for k in range(50)]
    want = {}
    for u in urls:
        bits = int(hashlib.md5(u.encode()).hexdigest()[24:32], 16) & 0x7FFFFFF
        want[u] = "".join(X.CODE_ALPHABET[(bits >> 3 * i) & 0x3D] for i in range(9))
    got = {r.u: r.c for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", X.short_code(F.col("u")).alias("c")).collect()}
    assert got == want
    rows = spark.createDataFrame([("director", "Jo", 1), ("director", None, 1), ("shared_audience", None, 2), ("shared_audience", None, 1), ("else", "x", 1)], "rel string, name string, hits int")
    said = [r.s for r in rows.select(X.reason(F.col("rel"), F.col("name"), F.col("hits")).alias("s")).collect()]
    assert said == [X.REASONS["director"][0].replace("%s", "Jo"), X.REASONS["director"][1], *X.AUDIENCE_REASONS, X.OTHER_REASON]


def test_shared_folder(spark):
    from graphloom.sources.scratch import settled, shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert settled(spark.range(3), "three").count() == 3


def test_negatives_are_always_as_many(spark):
    """Who rated much gets the rest by rank; who has fewer unrated items than asked for is left out."""
    catalogue = spark.range(30).select(F.concat(F.lit("m"), "id").alias("mid"))
    ratings = spark.createDataFrame([(1, f"m{k}") for k in range(22)] + [(2, "m3")] + [(3, f"m{k}") for k in range(25)], "uid long, mid string")
    tests = spark.createDataFrame([(1, "m0"), (2, "m3"), (3, "m1")], "uid long, test_mid string")
    got = {}
    for r in evaluate.negatives(tests, catalogue, ratings, 8, 42, oversample=1).collect():
        got.setdefault(r.uid, set()).add(r.mid)
    assert got[1] == {f"m{k}" for k in range(22, 30)} and len(got[2]) == 8 and 3 not in got
    ranked = evaluate.ranks(tests, evaluate.negatives(tests, catalogue, ratings, 8, 42), spark.createDataFrame([(1, "m0", 1.0)], "uid long, mid string, score double"))
    assert values(ranked, "uid") == [(1,), (2,)] and ranked.filter("uid = 1").first().rank == 1


def test_shortlist_paths_match_the_evidence(spark):
    """On a shortlist of all items the scores are those of the full evidence; a user is no bridge for the own seeds."""
    tokens = tokens_of(spark, [(f"m{k}", rel, es) for k in range(12) for rel, es in (("director", [f"d{k % 3}"]), ("actor", [f"a{k % 4}", f"a{k % 5}"]), ("genre", [f"g{k % 2}"]))]).distinct()
    actors = spark.createDataFrame([(f"m{k}", f"a{j}", i + 1) for k in range(12) for i, j in enumerate(sorted({k % 4, k % 5}))], "mid string, pid string, ord int")
    index = spark.createDataFrame([(u, f"m{k}", 80, 6) for u in range(2, 9) for k in range(12) if (u + k) % 2], "uid long, mid string, weight100 long, degree long")
    own = spark.createDataFrame([(1, "m0", 100, 2), (1, "m5", 70, 2), (1, "m9", 70, 2)], "uid long, mid string, weight100 long, degree long")
    seeds = spark.createDataFrame([(1, "m0", 100), (1, "m5", 70)], "uid long, mid string, weight100 long")
    pairs = spark.range(12).select(F.lit(1).cast("long").alias("uid"), F.concat(F.lit("m"), "id").alias("mid"))
    full = {r.mid: r.raw for r in recommend.path_scores(seeds, recommend.path_evidence(recommend.one_hop(tokens), recommend.two_hop(actors), recommend.shared_audience(index))).collect()}
    parts = recommend.shortlist_parts(seeds, tokens, pairs, actors, index.union(own), F.col("uid"))
    got = {r.mid: sum((r[f"p_{k}"] or 0) * w for k, w in recommend.PATH_WEIGHTS.items()) / 10000 for r in parts.collect()}
    assert full.keys() == got.keys() and all(got[m] == pytest.approx(full[m], rel=1e-3) for m in full)
    met = recommend.shortlist_audience(seeds, pairs, index.union(own), F.col("uid"))
    assert met.filter("mid = 'm9' AND seed = 'm0'").count() == 0 < met.filter("mid = 'm3' AND seed = 'm0'").count() + met.filter("mid = 'm7' AND seed = 'm5'").count() + met.count()


def test_ranks_of_all_configurations(spark):
    """Counting what is before the test item gives the ranks of sorting, for every configuration, ties by id."""
    import random

    rng = random.Random(6)
    rows = [(u, f"m{k:02d}", float(rng.randrange(4)), float(rng.randrange(4))) for u in range(12) for k in range(30)]
    tests = spark.createDataFrame([(u, f"m{u:02d}") for u in range(12)], "uid long, test_mid string")
    got = evaluate.config_ranks(spark.createDataFrame(rows, "uid long, mid string, a double, b double"), tests, {"a": F.col("a"), "sum": F.col("a") + 2 * F.col("b")})
    want = []
    for u in range(12):
        for name, score in (("a", lambda r: r[2]), ("sum", lambda r: r[2] + 2 * r[3])):
            mids = [r[1] for r in sorted((r for r in rows if r[0] == u), key=lambda r: (-score(r), r[1]))]
            want.append((u, name, mids.index(f"m{u:02d}") + 1))
    assert values(got, "uid", "config", "rank") == sorted(want)


def test_metrics_of_perfect_ranking(spark):
    row = evaluate.metrics(spark.createDataFrame([(1, 1), (2, 1)], "uid long, rank int")).first()
    assert (row["hr_5"], row["ndcg_10"], row["precision_5"]) == (1.0, 1.0, 0.2)
    spread = evaluate.over_seeds(spark.createDataFrame([(0.5,), (0.7,)], "hr double"), ["hr"]).first()
    assert (spread["hr_mean"], spread["hr_std"]) == (0.6, 0.1)
    assert evaluate.best_config(spark.createDataFrame([("a", 0.5, 0.6, 0.1), ("b", 0.5, 0.7, 0.0)], "config string, ndcg_10 double, hr_10 double, ndcg_5 double")).first()["config"] == "b"


def test_upsert_and_harvest(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, t int")
    assert values(upserts.upsert(old, new, ["k"], "t"), "k", "v") == [(1, "a"), (2, "d"), (3, "e")]
    rows = spark.createDataFrame([(True, 0, 9, 0, 9), (False, 9, 9, 0, 9), (False, 1, 9, 95, 100), (False, 1, 9, 90, 100)], "capped boolean, pages_fetched int, pages_total int, n_items int, n_total int")
    assert [r["ok"] for r in rows.select(cohort.harvest_complete(rows).alias("ok")).collect()] == [True, True, True, False]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(X.to_date(F.lit("2011-2"))) == dt.date(2011, 2, 1) and one(X.to_date(F.lit("2011-02-31"))) is None and one(X.to_date(F.lit("x"))) is None
    assert one(X.match_date(F.lit("on 1999-3-7"))) == "1999-03-07" and one(X.match_year(F.lit("in 1850"))) is None
    assert one(X.tidy_slashes(F.lit("/a//b  c/"))) == "a/b c" and one(X.with_scheme(F.lit(" x.org "))) == "http://x.org"
    assert one(X.slug_of(F.lit("https://example.org/people/ab/"))) == "ab" and one(X.path_id(F.lit("/subject/12/"))) == "12"
    assert [tuple(r) for r in one(X.named_ids(F.lit("A:1|bad|B:C:2")))] == [("A", "1", 1), ("B:C", "2", 3)]
    assert len(one(X.short_code(F.lit("http://example.org")))) == 9
    assert one(X.year_bucket(F.lit(0))) is None and one(X.clean_slashes(F.lit(" a / b/ "), True)) == "a/b"


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=10 * i), i % 3, "view" if i % 2 else "click", 1.0, "{}") for i in range(24)]
    for k in range(2):
        spark.createDataFrame(rows[12 * k : 12 * k + 12], activity.SCHEMA).write.parquet(str(tmp_path / f"in/p{k}"))
    source = str(tmp_path / "in/*")
    query = activity.upsert_batches(activity.event_stream(spark, source, 100), str(tmp_path / "t"), str(tmp_path / "c"))
    assert query.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "t"))
    assert out.count() == 6 and out.agg(F.max("event_id")).first()[0] == 23
    query = activity.cold_users(activity.event_stream(spark, source, 100)).writeStream.format("memory").queryName("cold").outputMode("update").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert values(spark.table("cold"), "user_id", "n", "cold") == [(0, 8, False), (1, 8, False), (2, 8, False)]
    query = activity.activity_windows(activity.event_stream(spark, source, 100)).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert spark.table("windows").agg(F.sum("n")).first()[0] >= 12


def test_transe_stops_and_tells_triples_apart(spark):
    """The validation loss falls, training ends early, and most held-out triples are nearer than wrong ones."""
    from graphloom.operators.transe import numbered_ends, train, validation

    rows = [(f"m{k}", r, f"{r}{k % 6}") for k in range(120) for r in "gcl"]
    triples = spark.createDataFrame(rows, "h string, r string, t string")
    vectors, losses = train(triples, size=16, rounds=8, patience=2, epochs=3, block=40)
    assert len(losses) <= 8 and min(losses) < losses[0]
    assert vectors.count() == 120 + 3 + 18 and validation(triples, vectors, numbered_ends(triples, 1), 1)[1] > 0.75


def test_pages_and_search(spark):
    from graphloom.functions.pages import movie_fields, person_fields
    from graphloom.operators.search import search, tokens

    html = '<h1><span>A &amp; B</span></h1> <span class="year">(1999)</span><span property="v:genre">x</span><span property="v:genre">y</span><strong property="v:average">7.5</strong><a href="https://e.org/celebrity/12/" rel="v:directedBy">Jo</a>'
    row = spark.createDataFrame([(html,)], "html string").select(*(c.alias(k) for k, c in movie_fields(F.col("html")).items())).first()
    assert (row["title"], row["year"], row["genres"], row["score"], row["director_ids"], row["votes"]) == ("A & B", 1999, "x/y", 7.5, "Jo:12", None)
    person = spark.createDataFrame([("<h1>Jo</h1><ul><li><span>性别</span>: 女</li><li>出生日期：1970-1-2</li><li>更多外文名: X</li><li>外文名: Joan</li><li>职业:</li></ul>",)], "html string").select(*(c.alias(k) for k, c in person_fields(F.col("html")).items())).first()
    assert (person["name"], person["sex"], str(person["birth"]), person["name_en"], person["profession"], person["death"]) == ("Jo", "女", "1970-01-02", "Joan", None, None)
    assert tokens("黑客帝国 the x") == ["黑客", "客帝", "帝国", "the"]
    names = spark.createDataFrame([("red ring",), ("ring",)], "name string")
    assert search(names, ["name"], "ring red").count() == 1 and search(names, ["name"], "RING").count() == 2


def test_files(spark, tmp_path):
    from graphloom.sources import readers, writers

    (tmp_path / "ids.txt").write_text("1, 2 x # 9\n2\n3")
    assert values(readers.id_list(spark, str(tmp_path / "ids.txt")), "id") == [("1",), ("2",), ("3",)]
    (tmp_path / "u.json").write_text('{"users": [{"profile_url": "a"}, {"import_username": "b"}]}')
    assert values(readers.user_specs(spark, str(tmp_path / "u.json")), "profile_url") == [("a",)]
    for name, n in (("eval_results_x.json", 99), ("eval_results_y.json", 499), ("eval_results_legacy.json", 999)):
        (tmp_path / name).write_text('{"algorithms": ["a", "b"], "num_negatives": %d, "generated_at": "t"}' % n)
    assert readers.best_report(readers.report_files(spark, str(tmp_path / "eval_*.json"))).first()["num_negatives"] == 499
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    assert writers.duplicate_keys(df, ["k"]).count() == 1 and writers.markdown_table(df).count("\n") == 3
    writers.write_nodes(df, "k", str(tmp_path / "nodes"))
    assert spark.read.parquet(str(tmp_path / "nodes")).count() == 1
    for turn in (1, 2):
        paths = writers.write_report(df, df.limit(1), f"{tmp_path}/reports", "2030-01-02_030405", writers.report_suffix(["a"], ["a", "b"], 99))
        assert [spark.read.json(p).count() for p in paths] == [2, 2, 1, 1]
        assert paths[0].endswith("/eval_results_a_neg99") and paths[1].endswith("history/2030-01-02_030405_eval_results_a_neg99" + ("_1" if turn == 2 else ""))
    assert writers.report_suffix(["a", "b"], ["a", "b"], 499) == "" and writers.markdown_report("All", {"One": df, "Two": df}).count("## ") == 2


def test_profile_and_list_pages(spark):
    from graphloom.functions.pages import list_items, list_totals, profile_fields
    from graphloom.operators.cohort import feed_items

    one = lambda html, fields: spark.createDataFrame([(html,)], "html string").select(*(c.alias(k) for k, c in fields.items())).first()
    profile = '<body><h1>ann <span>come in</span></h1><h2>ann的电影 · · ( 31部想看 · 2716部看过 )</h2><div>常居: <a>杭州</a> 5550123 (a.nn) 2011-03-04加入 IP属地：成都</div></body>'
    row = one(profile, profile_fields(F.col("html"), F.lit("a.nn")))
    assert row.asDict() == {"display_name": "ann", "tagline": "come in", "location": "杭州", "joined_at": "2011-03-04", "ip_location": "成都", "profile_id": "5550123", "n_doing": None, "n_wish": 31, "n_collect": 2716}
    assert one("<p>nothing</p>", profile_fields(F.col("html"), F.lit("x"))).display_name == "x"
    page = """<span class="subject-num">1-30&nbsp;/&nbsp;2716</span><ul class="list-view">
      <li id="list12" class="item"><div class="item-show"><div class="title"><a href="https://e.org/subject/12/">One / Two</a></div><div class="date"><span class="rating4-t"></span>&nbsp; 2032-05-04</div></div>
        <div data-cid="99" class="hide comment-item"><span class="intro">1953 / x</span></div></li>
      <li id="list13" class="item"><div class="item-show"><div class="title"><a href="https://e.org/subject/13/">Three</a></div><div class="date">2032-05-03</div></div><div class="comment-item"><div class="comment"> good  work (3 有用)</div></div></li></ul>
      <span class="thispage" data-total-page="49">1</span>"""
    items = one(page, {"i": list_items(F.col("html"))})["i"]
    assert [(i.mid, i.title, i.rating, i.rating_label, i.day, i.comment, i.intro, i.source_cid) for i in items] == [("12", "One / Two", 4.0, "推荐", "2032-05-04", None, "1953 / x", "99"), ("13", "Three", None, None, "2032-05-03", "good work", None, None)]
    assert one(page, list_totals(F.col("html"))).asDict() == {"total_pages": 49, "total_items": 2716} and one("", list_totals(F.col("html"))).asDict() == {"total_pages": 1, "total_items": None}
    feed = """<rss><channel><item><title>看过One</title><link>https://e.org/subject/12/</link><description><![CDATA[<p>推荐: 力荐</p><p>备注: fine</p>]]></description><pubDate>Tue, 10 Feb 2032 17:20:31 GMT</pubDate><guid>g1</guid></item>
      <item><title>想看Two</title><link>https://e.org/subject/13/</link><description></description><pubDate>Wed, 18 Feb 2032 09:00:00 GMT</pubDate></item><item><title>听过Three</title><link>https://e.org/subject/14/</link></item></channel></rss>"""
    rows = feed_items(spark.createDataFrame([("ann", feed)], "slug string, xml string")).orderBy("mid").collect()
    assert [(r.mid, r.action, r.rating, r.rating_label, r.comment, r.happened, r.guid) for r in rows] == [("12", "collect", 5.0, "力荐", "fine", "2032-02-11 01:20:31", "g1"), ("13", "wish", None, None, None, "2032-02-18 17:00:00", None)]


def test_cohort_parts(spark):
    people = spark.createDataFrame([("me", '<a href="https://e.org/people/you/"><a href="https://e.org/people/me/"><a href="https://e.org/people/deleted9/"><a href="https://e.org/people/you/">')], "owner string, html string")
    assert values(cohort.contacts(people, F.col("owner")), "slug") == [("you",)]
    totals = spark.createDataFrame([(5, 2), (50, 10), (600, 10), (2000, 900), (30, 0)], "c int, w int")
    got = values(cohort.classify(totals, F.col("c"), F.col("w")).na.fill(-1, ["max_collect", "max_wish"]), "c", "category", "max_collect", "max_wish")
    assert got == [(5, "too_light", -1, -1), (30, "light_native", 30, -1), (50, "light_native", 50, 10), (600, "medium_native", 300, 10), (2000, "heavy_capped", 300, 200)]


def test_words_of_text_without_spaces(spark):
    """The cheapest path against all paths, unknown characters, and search words of mixed Latin and Han queries."""
    import itertools

    from graphloom.operators import segment as G
    from graphloom.operators.search import search

    counts = {"黑客": 8, "帝国": 9, "黑客帝国": 3, "客": 1, "帝": 2, "国": 5, "王": 4, "国王": 2, "的": 30, "演讲": 3, "国王的演讲": 1}
    words = G.dictionary(spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "word string"))
    cost = {r.word: r.cost for r in words.collect()}

    def best(text):
        ways = []
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            ends = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
            parts = [text[a:b] for a, b in zip(ends, ends[1:])]
            if all(p in cost or len(p) == 1 for p in parts):
                ways.append((sum(cost.get(p, G.UNKNOWN) for p in parts), len(parts), [-e for e in reversed(ends[:-1])], parts))
        return min(ways)[3]

    texts = ["黑客帝国", "国王的演讲", "黑客的帝国王", "外星黑客", "国", "王国王国"]
    got = {r.run: r.words for r in G.segment(spark.createDataFrame([(t,) for t in [*texts, "", None, "国"]], "run string"), words).collect()}
    assert got == {t: best(t) for t in texts}
    assert G.query_words(words, "The 黑客帝国 x2!") == ["the", "黑客", "黑客帝国", "帝国", "x2"] or set(G.query_words(words, "The 黑客帝国 x2!")) == {"the", "黑客", "黑客帝国", "帝国", "x2"}
    films = spark.createDataFrame([("黑客与帝国", 1), ("黑客 Reloaded", 2), ("帝国时代", 3)], "name string, exact int")
    assert [r.name for r in search(films, ["name"], "帝国 黑客", words).collect()] == ["黑客与帝国"]
    assert [r.name for r in search(films, ["name"], "帝国时代", words).collect()] == ["帝国时代"]
    assert G.segment(spark.createDataFrame([], "run string"), words).count() == 0


def test_two_sided_paths(spark):
    """Many pairs at once on random graphs: the paths of a search from one side with smallest parents."""
    import random

    rng = random.Random(17)
    links = {tuple(rng.sample([f"n{i:02d}" for i in range(60)], 2)) for _ in range(75)} | {("hub", f"n{i:02d}") for i in range(0, 12)} | {("x", "y")}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def one_sided(start, goal, most):
        parent, frontier = {start: None}, [start]
        for _ in range(most):
            step = {}
            for a in sorted(frontier):
                for b in near.get(a, ()):
                    if b not in parent:
                        step[b] = min(step.get(b, a), a)
            parent |= step
            frontier = list(step)
        if goal not in parent:
            return None
        path = [goal]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        return path[::-1]

    asked = {(rng.choice(sorted(near)), rng.choice(sorted(near))) for _ in range(80)} | {("n01", "n01"), ("n01", "x"), ("x", "y"), ("n01", "absent")}
    want = {(a, b): one_sided(a, b, 5) if a != b else [a] for a, b in asked}
    frame = spark.createDataFrame([*asked, ("n01", "n01"), (None, "x")], "start string, goal string")
    got = {(r.start, r.goal): (r.hops, r.path) for r in graph.shortest_paths(spark.createDataFrame(sorted(links), "src string, dst string"), frame, 5).collect()}
    assert got == {k: (len(p) - 1, p) for k, p in want.items() if p}


def test_pairs_of_a_long_list_are_shared_out(spark):
    """A user of 20,000 films: no group of the join holds more than a block on either side, and no pair is lost or made twice."""
    long = spark.range(20_000).select(F.lit(1).cast("long").alias("uid"), F.format_string("m%05d", "id").alias("mid"), (F.col("id") % 10 + 1).cast("int").alias("h"))
    left, right = recommend.block_pairs(long, "uid", "mid", 1000)
    for side in (left, right):
        assert side.groupBy("uid", "i", "j").count().agg(F.max("count")).first()[0] == 1000
    assert left.count() == right.count() == 210 * 1000
    few = long.filter("mid < 'm00090'").union(spark.createDataFrame([(2, f"m{k:05d}", k % 10 + 1) for k in range(0, 90, 3)], "uid long, mid string, h int"))
    whole, cut = (values(recommend.item_similarity(few, size=n), "a", "b", "sim6") for n in (1000, 7))
    assert whole == cut and len(whole) == 30 * 29
