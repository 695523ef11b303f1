"""Statistics, search, profiling and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as X
from graphloom.operators import profiling as P
from graphloom.functions.pages import list_items, movie_fields, person_fields, profile_fields
from graphloom.operators.cohort import capped_items
from graphloom.plans.registry import query
from graphloom.sources.catalog import Catalog
from graphloom.sources.readers import digit_ids

R1 = "floor({} * 10 + 0.5) / 10"
R2 = "floor({} * 100 + 0.5) / 100"
R4 = "floor({} * 10000 + 0.5) / 10000"


@query("SELECT (SELECT count(*) FROM movies) AS n_movies, (SELECT count(*) FROM persons) AS n_persons, (SELECT count(DISTINCT genre) FROM genre_edges) AS n_genres, (SELECT count(*) FROM acted) + (SELECT count(*) FROM directed) + (SELECT count(*) FROM genre_edges) AS n_edges")
def a10_overview(c: Catalog) -> DataFrame:
    kinds = [c.movie_keys.select(F.lit("m").alias("k"), F.col("mid").alias("v")), c.persons.select(F.lit("p"), "pid"), c.genre_edges.select(F.lit("g"), "genre").distinct()]
    kinds += [c.acted.select(F.lit("e"), "mid"), c.directed.select(F.lit("e"), "mid"), c.genre_edges.select(F.lit("e"), "mid")]
    n = lambda k: F.count_if(F.col("k") == k)
    return P.stacked([k.toDF("k", "v") for k in kinds]).agg(n("m").alias("n_movies"), n("p").alias("n_persons"), n("g").alias("n_genres"), n("e").alias("n_edges"))


@query("SELECT genre, count(*) AS n FROM genre_edges GROUP BY genre")
def a11_genre_distribution(c: Catalog) -> DataFrame:
    return c.genre_edges.groupBy("genre").agg(F.count("*").alias("n"))


@query("SELECT year, count(*) AS n FROM movies WHERE year IS NOT NULL GROUP BY year")
def a12_year_distribution(c: Catalog) -> DataFrame:
    return c.movie_keys.filter("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("n"))


@query("SELECT * FROM (SELECT 'actor' AS role, pid, count(*) AS n FROM acted GROUP BY pid ORDER BY n DESC, pid LIMIT 20) UNION ALL SELECT * FROM (SELECT 'director' AS role, pid, count(*) AS n FROM directed GROUP BY pid ORDER BY n DESC, pid LIMIT 20)")
def a13_top_people(c: Catalog) -> DataFrame:
    top = lambda df, role: df.groupBy("pid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pid").limit(20).select(F.lit(role).alias("role"), "pid", "n")
    return top(c.acted, "actor").union(top(c.directed, "director"))


@query("SELECT CAST(floor(score) AS INTEGER) AS rating, count(*) AS n FROM movies WHERE score IS NOT NULL GROUP BY 1")
def a14_rating_distribution(c: Catalog) -> DataFrame:
    return c.movies.filter("score IS NOT NULL").groupBy(F.col("score").cast("int").alias("rating")).agg(F.count("*").alias("n"))


TREND = """
WITH top8 AS (SELECT genre FROM genre_edges GROUP BY genre ORDER BY count(*) DESC, genre LIMIT 8)
SELECT g.genre, m.year, count(*) AS n FROM genre_edges g JOIN top8 USING (genre) JOIN movies m ON m.mid = g.mid
WHERE m.year BETWEEN 1980 AND 2030 GROUP BY 1, 2
"""


def _trend(c: Catalog) -> DataFrame:
    top = c.genre_edges.groupBy("genre").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "genre").limit(8).select("genre")
    edges = c.genre_edges.join(top, "genre", "left_semi").join(c.movie_keys.select("mid", "year").filter("year BETWEEN 1980 AND 2030"), "mid")
    return edges.groupBy("genre", "year").agg(F.count("*").alias("n"))


@query(TREND)
def a15_genre_year_trend(c: Catalog) -> DataFrame:
    return _trend(c)


@query("WITH t AS (SELECT m.year, g.genre FROM genre_edges g JOIN movies m ON m.mid = g.mid WHERE g.genre IN ('red', 'blue', 'old')) SELECT year, count(*) FILTER (genre = 'red') AS red, count(*) FILTER (genre = 'blue') AS blue, count(*) FILTER (genre = 'old') AS old FROM t GROUP BY year")
def a41_year_genre_pivot(c: Catalog) -> DataFrame:
    joined = c.genre_edges.join(c.movie_keys.select("mid", "year"), "mid").filter(F.col("genre").isin("red", "blue", "old"))
    return joined.groupBy("year").pivot("genre", ["red", "blue", "old"]).count().na.fill(0)


@query(f"SELECT year, count(*) AS n, {R1.format('(sum(CAST(round(score * 10) AS BIGINT)) / count(*) / 10)')} AS avg_score FROM movies WHERE score IS NOT NULL AND year BETWEEN 1950 AND 2030 GROUP BY year HAVING count(*) >= 10")
def a16_rating_year_trend(c: Catalog) -> DataFrame:
    rated = c.movies.filter("score IS NOT NULL AND year BETWEEN 1950 AND 2030")
    return rated.groupBy("year").agg(F.count("*").alias("n"), X.rounded(F.sum(F.round(F.col("score") * 10).cast("long")) / F.count("*") / 10, 1).alias("avg_score")).filter("n >= 10")


def _best(c: Catalog, edges: DataFrame, role: str, least: int) -> DataFrame:
    joined = edges.join(c.movies.filter("score IS NOT NULL").select("mid", F.round(F.col("score") * 10).cast("long").alias("s")), "mid")
    grouped = joined.groupBy("pid").agg(F.count("*").alias("n"), X.rounded(F.sum("s") / F.count("*") / 10, 2).alias("avg_score")).filter(F.col("n") >= least)
    return grouped.orderBy(F.desc("avg_score"), "pid").limit(20).select(F.lit(role).alias("role"), "pid", "n", "avg_score")


BEST = "SELECT * FROM (SELECT '{r}' AS role, pid, count(*) AS n, floor(sum(CAST(round(score * 10) AS BIGINT)) / count(*) / 10 * 100 + 0.5) / 100 AS avg_score FROM {t} JOIN movies USING (mid) WHERE score IS NOT NULL GROUP BY pid HAVING count(*) >= {k} ORDER BY avg_score DESC, pid LIMIT 20)"


@query(BEST.format(r="actor", t="acted", k=10) + " UNION ALL " + BEST.format(r="director", t="directed", k=5))
def a17_top_rated_people(c: Catalog) -> DataFrame:
    return _best(c, c.acted, "actor", 10).union(_best(c, c.directed, "director", 5))


@query("WITH busy AS (SELECT pid FROM acted GROUP BY pid ORDER BY count(*) DESC, pid LIMIT 10) SELECT a.pid, p.name, count(*) AS n, CAST(sum(CAST(round(score * 10) AS BIGINT)) AS BIGINT) AS total10, min(score) AS low, max(score) AS high FROM acted a JOIN busy USING (pid) JOIN movies m USING (mid) JOIN persons p USING (pid) WHERE score IS NOT NULL GROUP BY 1, 2")
def a18_busiest_actor_ratings(c: Catalog) -> DataFrame:
    busy = c.acted.groupBy("pid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pid").limit(10).select("pid")
    joined = c.acted.join(F.broadcast(busy), "pid").join(c.movies.filter("score IS NOT NULL").select("mid", "score"), "mid").join(c.persons.select("pid", "name"), "pid")
    ratings = joined.groupBy("pid", "name").agg(F.array_sort(F.collect_list("score")).alias("ratings"))
    total = F.aggregate("ratings", F.lit(0).cast("long"), lambda a, x: a + F.round(x * 10).cast("long"))
    return ratings.select("pid", "name", F.size("ratings").cast("long").alias("n"), total.alias("total10"), F.array_min("ratings").alias("low"), F.array_max("ratings").alias("high"))


@query("SELECT mid, name, score, votes FROM movies WHERE score > 0 AND votes > 0 ORDER BY votes DESC, mid LIMIT 200")
def a19_rating_vote_scatter(c: Catalog) -> DataFrame:
    return c.movies.filter("score > 0 AND votes > 0").orderBy(F.desc("votes"), "mid").limit(200).select("mid", "name", "score", "votes")


@query("SELECT 'DIRECTED' AS rel, count(*) AS n FROM directed UNION ALL SELECT 'ACTED_IN', count(*) FROM acted UNION ALL SELECT 'HAS_GENRE', count(*) FROM genre_edges UNION ALL SELECT 'RATED', count(*) FROM ratings")
def a20_edge_counts(c: Catalog) -> DataFrame:
    frames = {"DIRECTED": c.directed, "ACTED_IN": c.acted, "HAS_GENRE": c.genre_edges, "RATED": c.ratings}
    return P.stacked([df.select(F.lit(rel).alias("rel")) for rel, df in frames.items()]).groupBy("rel").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT mid, name FROM movies WHERE contains(name, 'red')) SELECT t.mid, t.name, (SELECT string_agg(pid, ',' ORDER BY pid) FROM (SELECT DISTINCT pid FROM acted a WHERE a.mid = t.mid ORDER BY pid LIMIT 5)) AS actors, (SELECT string_agg(genre, ',' ORDER BY genre) FROM (SELECT DISTINCT genre FROM genre_edges g WHERE g.mid = t.mid ORDER BY genre LIMIT 5)) AS genres FROM t")
def a21_verification_sample(c: Catalog) -> DataFrame:
    first = lambda df, col: df.groupBy("mid").agg(F.array_join(F.slice(F.array_sort(F.collect_set(col)), 1, 5), ",").alias(col))
    hit = c.movie_keys.filter(F.contains("name", F.lit("red"))).select("mid", "name")
    return hit.join(first(c.acted, "pid"), "mid", "left").join(first(c.genre_edges, "genre"), "mid", "left").select("mid", "name", F.col("pid").alias("actors"), F.col("genre").alias("genres"))


@query(
    "WITH t AS (SELECT count(*) AS n, count(*) FILTER (name <> '') AS a, count(*) FILTER (genres <> '') AS b, count(score) AS c, count(votes) AS d, count(*) FILTER (region <> '') AS e FROM movies), "
    "u AS (SELECT 'name' AS field, a AS non_null, n FROM t UNION ALL SELECT 'genres', b, n FROM t UNION ALL SELECT 'score', c, n FROM t UNION ALL SELECT 'votes', d, n FROM t UNION ALL SELECT 'region', e, n FROM t), "
    f"v AS (SELECT field, non_null, n - non_null AS missing, {R2.format('((n - non_null) * 100.0 / n)')} AS missing_rate FROM u) "
    "SELECT *, CASE WHEN missing_rate < 5 THEN 'good' WHEN missing_rate < 20 THEN 'fair' ELSE 'poor' END AS grade FROM v"
)
def a1_movie_completeness(c: Catalog) -> DataFrame:
    return P.completeness(c.movies, ["name", "genres", "score", "votes", "region"], 5, 20)


@query(
    "WITH t AS (SELECT count(*) AS n, count(*) FILTER (name <> '') AS a, count(*) FILTER (birthplace <> '') AS b, count(*) FILTER (profession <> '') AS c FROM persons), "
    "u AS (SELECT 'name' AS field, a AS non_null, n FROM t UNION ALL SELECT 'birthplace', b, n FROM t UNION ALL SELECT 'profession', c, n FROM t), "
    f"v AS (SELECT field, non_null, n - non_null AS missing, {R2.format('((n - non_null) * 100.0 / n)')} AS missing_rate FROM u) "
    "SELECT *, CASE WHEN missing_rate < 5 THEN 'good' WHEN missing_rate < 30 THEN 'fair' ELSE 'poor' END AS grade FROM v"
)
def a2_person_completeness(c: Catalog) -> DataFrame:
    return P.completeness(c.persons, ["name", "birthplace", "profession"], 5, 30)


@query("SELECT CASE WHEN score IS NULL OR score = 0 THEN 'none' WHEN score < 3 THEN '1-3' WHEN score < 5 THEN '3-5' WHEN score < 7 THEN '5-7' WHEN score < 8 THEN '7-8' WHEN score < 9 THEN '8-9' ELSE '9-10' END AS bucket, count(*) AS n FROM movies GROUP BY 1")
def a3_score_histogram(c: Catalog) -> DataFrame:
    edges = [("1-3", None, 3), ("3-5", 3, 5), ("5-7", 5, 7), ("7-8", 7, 8), ("8-9", 8, 9), ("9-10", 9, None)]
    return P.histogram(c.movies, F.col("score"), edges, "none", F.col("score").isNull() | (F.col("score") == 0))


@query("SELECT CASE WHEN year IS NULL THEN 'none' WHEN year < 1960 THEN '<1960' WHEN year < 1980 THEN '60-79' WHEN year < 2000 THEN '80-99' WHEN year < 2010 THEN '00s' WHEN year < 2020 THEN '10s' ELSE '20+' END AS bucket, count(*) AS n FROM movies GROUP BY 1")
def a4_decade_histogram(c: Catalog) -> DataFrame:
    edges = [("<1960", None, 1960), ("60-79", 1960, 1980), ("80-99", 1980, 2000), ("00s", 2000, 2010), ("10s", 2010, 2020), ("20+", 2020, None)]
    return P.histogram(c.movie_keys, F.col("year"), edges, "none", F.col("year").isNull())


@query("SELECT coalesce(nullif(content_type, ''), 'unknown') AS value, count(*) AS n FROM movies GROUP BY 1")
def a5_content_types(c: Catalog) -> DataFrame:
    return P.value_counts(c.movie_keys, "content_type", "unknown")


@query("SELECT trim(token) AS token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[/,\\s]+')) AS token FROM documents) WHERE trim(token) <> '' GROUP BY 1 ORDER BY n DESC, token LIMIT 20", prelude=False)
def a6_token_frequency(c: Catalog) -> DataFrame:
    return P.token_counts(c.table("documents"), "text", r"[/,\s]+", 20)


@query("SELECT coalesce(nullif(profession, ''), 'unknown') AS value, count(*) AS n FROM persons GROUP BY 1")
def a7_profession_counts(c: Catalog) -> DataFrame:
    return P.value_counts(c.persons, "profession", "unknown")


@query("WITH l AS (SELECT DISTINCT pid FROM acted), r AS (SELECT DISTINCT pid FROM directed) SELECT (SELECT count(*) FROM l) AS n_left, (SELECT count(*) FROM r) AS n_right, (SELECT count(*) FROM l WHERE pid NOT IN (SELECT pid FROM r)) AS left_only")
def a8_linkage(c: Catalog) -> DataFrame:
    return P.linkage(c.acted, c.directed, "pid")


def raw_credits(c: Catalog) -> DataFrame:
    """(mid, actor_ids): 'name:id|name:id' in the order of the lines, with a malformed item where a line is returned."""
    lines = c.table("lineitem").select(F.col("l_partkey").cast("string").alias("mid"), F.col("l_suppkey").cast("string").alias("pid"), "l_orderkey", "l_linenumber", "l_returnflag")
    item = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Supplier "), "pid")).otherwise(F.concat(F.lit("Supplier "), "pid", F.lit(":"), "pid"))
    each = lines.select("mid", F.struct("l_orderkey", "l_linenumber", item.alias("item")).alias("s"))
    return each.groupBy("mid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["item"]), "|").alias("actor_ids"))


RAW = "raw AS (SELECT CAST(l_partkey AS VARCHAR) AS mid, string_agg(CASE WHEN l_returnflag = 'R' THEN 'Supplier ' || l_suppkey ELSE 'Supplier ' || l_suppkey || ':' || l_suppkey END, '|' ORDER BY l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'Supplier ' || l_suppkey ELSE 'Supplier ' || l_suppkey || ':' || l_suppkey END) AS actor_ids FROM lineitem GROUP BY 1)"
ITEMS = "items AS (SELECT mid, unnest(string_split(actor_ids, '|')) AS item, generate_subscripts(string_split(actor_ids, '|'), 1) AS ord FROM raw)"


@query(f"WITH {RAW} SELECT CAST(sum(length(actor_ids) - length(replace(actor_ids, '|', '')) + 1) AS BIGINT) AS actor_ids_estimate FROM raw")
def a9_separator_estimate(c: Catalog) -> DataFrame:
    return P.separator_estimate(raw_credits(c), ["actor_ids"], "|")


@query(f"WITH {RAW}, {ITEMS} SELECT split_part(item, ':', 2) AS pid, mid, max(ord) AS ord FROM items WHERE contains(item, ':') AND split_part(item, ':', 2) <> '' GROUP BY 1, 2")
def sk5_credits_load(c: Catalog) -> DataFrame:
    from graphloom.operators.graph import credits_of

    return credits_of(raw_credits(c), "mid", "actor_ids")


@query(f"WITH {RAW} SELECT count(*) FILTER (NOT contains(actor_ids, ':')) AS n_bad, (SELECT list_sort(list(a)) FROM (SELECT DISTINCT actor_ids AS a FROM raw WHERE NOT contains(actor_ids, ':') AND actor_ids <> '' ORDER BY a LIMIT 5)) AS samples FROM raw")
def pf7_malformed_credits(c: Catalog) -> DataFrame:
    return P.malformed(raw_credits(c), "actor_ids").select("n_bad", F.when(F.size("samples") > 0, F.col("samples")).alias("samples"))


@query("SELECT count(*) FILTER (score < 0 OR score > 10) AS out_of_range, count(*) FILTER (score IS NULL) AS no_score, count(*) FILTER (contains(genres, ' / ')) AS spaced_genres, count(*) FILTER (name IS NULL OR name = '') AS no_name, count(*) FILTER (year IS NULL) AS no_year, count(*) AS n FROM movies")
def a23_clean_summary(c: Catalog) -> DataFrame:
    s = F.col("score")
    flags = {"out_of_range": (s < 0) | (s > 10), "no_score": s.isNull(), "spaced_genres": F.contains(F.col("genres"), F.lit(" / ")), "no_name": F.col("name").isNull() | (F.col("name") == ""), "no_year": F.col("year").isNull(), "n": F.lit(True)}
    return P.summary(c.movies, flags)


@query("SELECT mid, trim(' ' || name || ' ') AS name, regexp_replace(CASE WHEN contains(g, ' / ') THEN replace(replace(g, ' / ', '/'), '/ ', '/') ELSE g END, '/+$', '') AS genres, region, nullif(score, 0) AS score, nullif(votes, 0) AS votes FROM (SELECT *, trim(' ' || replace(genres, '/', ' / ') || '/') AS g FROM movies)")
def x5_clean_pipeline(c: Catalog) -> DataFrame:
    dirty = c.movies.withColumn("name", F.concat(F.lit(" "), "name", F.lit(" "))).withColumn("genres", F.concat(F.lit(" "), F.replace("genres", F.lit("/"), F.lit(" / ")), F.lit("/")))
    return P.clean_movies(dirty).select("mid", "name", "genres", "region", "score", "votes")


@query("WITH b AS (SELECT CASE WHEN l_shipdate IS NULL THEN 'open' ELSE l_linestatus END AS s, l_returnflag FROM lineitem) SELECT l_returnflag, count(*) FILTER (s = 'O') AS n_open, count(*) FILTER (s = 'F') AS n_done, count(*) AS n FROM b GROUP BY 1")
def a24_status_pivot(c: Catalog) -> DataFrame:
    n = lambda s: F.count_if(F.col("l_linestatus") == s)
    return c.table("lineitem").groupBy("l_returnflag").agg(n("O").alias("n_open"), n("F").alias("n_done"), F.count("*").alias("n"))


@query(f"WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS done FROM d), t AS (SELECT day, done, CAST(done - lag(done) OVER (ORDER BY day) AS BIGINT) AS added, lag(day) OVER (ORDER BY day) AS last FROM s), r AS (SELECT *, floor(CAST(added AS DOUBLE) / (day - last) * 100.0 + 0.5) / 100.0 AS rate FROM t) SELECT day, done, added, rate, CASE WHEN rate > 0 THEN CAST(ceil(greatest((SELECT count(*) FROM lineitem) - done, 0) / rate) AS BIGINT) END AS days_left FROM r", prelude=False)
def a25_progress_deltas(c: Catalog) -> DataFrame:
    days = c.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return P.progress(days, c.table("lineitem").agg(F.count("*").alias("n")).scalar())


@query("SELECT mid, name, floor(((50000 * 7 + coalesce(votes, 0) * score) / (50000 + coalesce(votes, 0))) * 1e6 + 0.5) / 1e6 AS rank_score FROM movies WHERE score IS NOT NULL ORDER BY rank_score DESC, mid LIMIT 50")
def l2_weighted_rank(c: Catalog) -> DataFrame:
    v, s = F.coalesce("votes", F.lit(0)), F.col("score")
    rank = X.rounded((50000 * 7 + v * s) / (50000 + v), 6)
    return c.movies.filter("score IS NOT NULL").select("mid", "name", rank.alias("rank_score")).orderBy(F.desc("rank_score"), "mid").limit(50)


@query("SELECT mid, name, votes FROM movies ORDER BY votes DESC NULLS FIRST, mid LIMIT 50")
def l3_order_modes(c: Catalog) -> DataFrame:
    return c.movies.orderBy(F.col("votes").desc_nulls_first(), "mid").limit(50).select("mid", "name", "votes")


@query("SELECT m.mid, m.name, m.year, m.score FROM movies m WHERE m.mid IN (SELECT mid FROM genre_edges WHERE genre = 'red') AND content_type = 'ECONOMY' AND year >= 1975 AND year <= 2015 AND score >= 4 ORDER BY score DESC, mid LIMIT 20 OFFSET 5")
def pf1_filter_movies(c: Catalog) -> DataFrame:
    hits = c.movies.filter("content_type = 'ECONOMY' AND year >= 1975 AND year <= 2015 AND score >= 4")
    hits = hits.join(c.genre_edges.filter("genre = 'red'").select("mid"), "mid", "left_semi")
    return hits.orderBy(F.desc("score"), "mid").offset(5).limit(20).select("mid", "name", "year", "score")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'stupid')", prelude=False)
def pf2_token_search(c: Catalog) -> DataFrame:
    tokens = F.filter(F.split(F.lower(F.lit("The, stupid a")), r"[^\w]+"), lambda t: F.length(t) > 1)
    return c.table("documents").filter(F.forall(tokens, lambda t: F.contains(F.lower("text"), t))).select("doc_id")


@query("SELECT pid, name FROM persons WHERE contains(lower(translate(name, '#·・. ', '')), lower('supplier00'))")
def pf3_person_search(c: Catalog) -> DataFrame:
    return c.persons.filter(F.contains(F.lower(F.translate("name", "#·・. ", "")), F.lit("supplier00"))).select("pid", "name")


@query("SELECT m.mid, m.name, m.score FROM movies m WHERE score IS NOT NULL AND EXISTS (SELECT 1 FROM genre_edges g WHERE g.mid = m.mid AND genre = 'blue') ORDER BY score DESC, mid LIMIT 25")
def pf4_top_by_genre(c: Catalog) -> DataFrame:
    hits = c.movies.filter("score IS NOT NULL").join(c.genre_edges.filter("genre = 'blue'"), "mid", "left_semi")
    return hits.orderBy(F.desc("score"), "mid").limit(25).select("mid", "name", "score")


@query("SELECT DISTINCT genre FROM genre_edges")
def pf21_genres(c: Catalog) -> DataFrame:
    return c.genre_edges.select("genre").distinct()


LANDED = "landed AS (SELECT *, CASE WHEN contains(name, 'old') THEN '' ELSE 'c' || mid END AS cover, CASE WHEN year % 7 > 0 THEN name END AS storyline FROM movies)"


def landed_films(c: Catalog) -> DataFrame:
    """Films with covers and storylines, some of them blank."""
    return c.movies.withColumns({"cover": F.when(F.contains("name", F.lit("old")), "").otherwise(F.concat(F.lit("c"), "mid")), "storyline": F.when(F.col("year") % 7 > 0, F.col("name"))})


@query(f"WITH {LANDED} SELECT mid, votes FROM landed WHERE score IS NOT NULL AND votes >= 20 AND (cover = '' OR storyline IS NULL) ORDER BY votes DESC, mid LIMIT 100")
def pf8_incomplete_items(c: Catalog) -> DataFrame:
    return P.incomplete_films(landed_films(c), 20).orderBy(F.desc("votes"), "mid").limit(100).select("mid", "votes")


@query("SELECT pid FROM persons WHERE CAST(pid AS BIGINT) % 3 = 0 AND starts_with(profession, 'A') AND contains(birthplace, 'I')")
def pf9_incomplete_persons(c: Catalog) -> DataFrame:
    return P.incomplete_persons(landed_persons(c)).select("pid")


def landed_persons(c: Catalog) -> DataFrame:
    """Persons with four facts each, some of them blank."""
    drop = lambda name, hit: F.when(~hit, F.col(name))
    number = F.col("pid").cast("long") % 3 == 0
    return c.persons.withColumns({"sex": F.when(~number, "x"), "biography": F.when(number, "").otherwise(F.col("name")), "profession": drop("profession", F.startswith("profession", F.lit("A"))), "birthplace": drop("birthplace", F.contains("birthplace", F.lit("I")))})


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) > 1998 THEN false WHEN year(o_orderdate) = 1998 THEN strftime(o_orderdate, '%Y-%m-%d') <= '1998-06-30' ELSE true END AS released FROM orders", prelude=False)
def pf10_release_gate(c: Catalog) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return c.table("orders").select("o_orderkey", X.released(F.year("o_orderdate"), day, "1998-06-30").alias("released"))


@query("SELECT r.uid, r.mid, r.h FROM ratings r JOIN users u USING (uid) WHERE u.username LIKE 'machinery_%'")
def sc4_ratings_by_source(c: Catalog) -> DataFrame:
    chosen = c.users.filter(F.col("username").like("machinery_%")).select("uid")
    return c.ratings.join(chosen, "uid").select("uid", "mid", "h")


@query("SELECT count(*) AS n FROM ratings r JOIN users u USING (uid) WHERE NOT starts_with(u.username, 'machinery_')")
def pf11_source_excluded(c: Catalog) -> DataFrame:
    chosen = c.users.filter(~F.startswith("username", F.lit("machinery_"))).select("uid")
    return c.ratings.join(chosen, "uid", "left_semi").agg(F.count("*").alias("n"))


@query("SELECT mid, list_sort(list(DISTINCT genre)) AS genres FROM genre_edges GROUP BY mid")
def sc5_entities_by_item(c: Catalog) -> DataFrame:
    return c.genre_edges.groupBy("mid").agg(F.array_sort(F.collect_set("genre")).alias("genres"))


@query("SELECT user_id, event_id, n > 30 AS capped FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k <= 30", prelude=False)
def sc7_capped_lists(c: Catalog) -> DataFrame:
    return capped_items(c.table("events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], 30).select("user_id", "event_id", "capped")


@query("SELECT doc_id, t AS id FROM (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '#[^\\n]*', '', 'g'), '[\\s,]+')) AS t FROM documents) WHERE regexp_matches(t, '^[0-9]+$')", prelude=False)
def sc8_id_lists(c: Catalog) -> DataFrame:
    return c.table("documents").select("doc_id", F.explode(digit_ids(F.col("text"))).alias("id"))


@query("SELECT tag, sort, n * 20 AS start FROM (SELECT DISTINCT genre AS tag FROM genre_edges), (SELECT unnest(['R', 'S', 'T']) AS sort), (SELECT unnest([0, 1, 2]) AS n)")
def sc12_work_list(c: Catalog) -> DataFrame:
    tags = c.genre_edges.select(F.col("genre").alias("tag")).distinct()
    sorts = tags.withColumn("sort", F.explode(F.array(*map(F.lit, "RST"))))
    return sorts.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("tag", "sort", (F.col("n") * 20).alias("start"))


@query(
    "SELECT p_partkey, CASE WHEN year < 1990 THEN 'before_1990' WHEN year < 2000 THEN '1990s' WHEN year < 2010 THEN '2000s' WHEN year < 2020 THEN '2010s' ELSE '2020s' END AS bucket, "
    "md5(name) AS h, CASE WHEN NOT contains(name, 'old') THEN 'https://e.org/lpst/lpic/' || name END AS cover, floor(1 / ln(2.0 + greatest(p_size, 1)) * 1e6 + 0.5) / 1e6 AS idf "
    "FROM (SELECT p_partkey, p_name AS name, p_size, p_size + 1970 AS year FROM part)",
    prelude=False,
)
def x2_item_scalars(c: Catalog) -> DataFrame:
    part = c.table("part")
    cover = X.large_cover(F.concat(F.lit("https://e.org/spst/"), F.when(F.contains("p_name", F.lit("old")), "default/").otherwise("mpic/"), "p_name"))
    return part.select("p_partkey", X.year_bucket(F.col("p_size") + 1970).alias("bucket"), F.md5("p_name").alias("h"), cover.alias("cover"), X.rounded(X.idf(F.col("p_size")), 6).alias("idf"))


@query("WITH e AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, list_sort(list_distinct(regexp_extract_all(html, 'href=\"/([^\"/]+)\"', 1))) AS links FROM pages) SELECT page_id, host, links, md5(host) AS code FROM e", prelude=False)
def x21_page_links(c: Catalog) -> DataFrame:
    links = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"/]+)"'), F.lit(1))))
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return c.table("pages").select("page_id", host.alias("host"), links.alias("links"), F.md5(host).alias("code"))


@query("SELECT mid, name AS title, year, CASE WHEN year % 5 = 0 THEN 'tv' ELSE 'movie' END AS content_type, genres, region AS regions, language AS languages, name || '/' || region AS alias, score, votes, 'P1/P2' AS actors, 'P1:' || mid || '|P2:' || year AS actor_ids, CAST(year AS INTEGER) % 90 + 60 AS mins, year || '-03-01' AS day, 'tt' || mid AS imdb_id, name || ' and' AS storyline FROM movies")
def x19_film_pages(c: Catalog) -> DataFrame:
    """The fields of a film's page, from pages that the films are written into."""
    genres = F.array_join(F.transform(F.split("genres", "/"), lambda g: F.concat(F.lit('<span property="v:genre">'), g, F.lit("</span>"))), " / ")
    bits = [
        F.lit('<h1><span property="v:itemreviewed">'), F.col("name"), F.lit('</span> <span class="year">('), F.col("year"), F.lit(')</span></h1><div id="info">'), genres, F.lit("<br/>"),
        F.lit('<a href="/celebrity/'), F.col("mid"), F.lit('/" rel="v:starring">P1</a> / <a href="/celebrity/'), F.col("year"), F.lit('/" rel="v:starring">P2</a><br/><span class="pl">制片国家/地区:</span> '), F.col("region"),
        F.lit('<br/><span class="pl">语言:</span> '), F.col("language"), F.when(F.col("year") % 5 == 0, '<br/><span class="pl">集数:</span> 12').otherwise(""), F.lit('<br/><span class="pl">又名:</span> '), F.col("name"), F.lit(" // "), F.col("region"),
        F.lit('<br/><span property="v:initialReleaseDate" content="'), F.col("year"), F.lit('-3">x</span><span property="v:runtime" content="'), F.col("year") % 90 + 60, F.lit('">y</span><br/><a href="https://www.e.org/title/tt'), F.col("mid"), F.lit('/">IMDb</a></div>'),
        F.when(F.col("score").isNotNull(), F.concat(F.lit('<strong property="v:average">'), F.col("score").cast("string"), F.lit('</strong><span property="v:votes">'), F.col("votes"), F.lit("</span>"))).otherwise(""), F.lit('<span class="all hidden"> '), F.col("name"), F.lit("  and </span>"),
    ]
    made = c.movies.select("mid", F.concat(*bits).alias("html"))
    fields = movie_fields(F.col("html"))
    wanted = ("title", "year", "content_type", "genres", "regions", "languages", "score", "votes", "actors", "actor_ids", "mins", "imdb_id", "storyline")
    return made.select("mid", *(fields[k].alias(k) for k in wanted), F.replace(fields["alias"], F.lit(" / "), F.lit("/")).alias("alias"), F.date_format(fields["release_date"], "yyyy-MM-dd").alias("day"))


@query("SELECT pid, name, CASE WHEN CAST(pid AS BIGINT) % 2 = 0 THEN '男' ELSE '女' END AS sex, birthplace, profession, '19' || (10 + CAST(pid AS BIGINT) % 90) || '-01-01' AS born, 'A person of ' || birthplace AS biography FROM persons")
def x20_person_pages(c: Catalog) -> DataFrame:
    """The fields of a person's page, from pages that the persons are written into."""
    n = F.col("pid").cast("long")
    bits = [F.lit("<h1>"), F.col("name"), F.lit('</h1><div class="info"><li><span>性别</span>: '), F.when(n % 2 == 0, "男").otherwise("女"), F.lit("</li><li><span>出生日期</span>: 19"), n % 90 + 10, F.lit("年</li><li><span>出生地</span>: "), F.col("birthplace"), F.lit("</li><li><span>职业</span>： "), F.col("profession"), F.lit('</li></div><div id="intro"><div class="bd"><span class="all">A person of '), F.col("birthplace"), F.lit(" · · · (展开全部)</span></div></div>")]
    made = c.persons.select("pid", F.concat(*bits).alias("html"))
    fields = person_fields(F.col("html"))
    return made.select("pid", *(fields[k].alias(k) for k in ("name", "sex", "birthplace", "profession", "biography")), F.date_format(fields["birth"], "yyyy-MM-dd").alias("born"))


@query("SELECT uid, 'U' || uid AS display_name, 'hi' AS tagline, split_part(username, '_', 1) AS location, '2011-03-04' AS joined_at, CAST(uid AS VARCHAR) AS profile_id, CAST((SELECT count(*) FROM ratings r WHERE r.uid = users.uid) AS INTEGER) AS n_collect FROM users")
def x24_profile_pages(c: Catalog) -> DataFrame:
    """The fields of a user's profile page, from pages that the users are written into."""
    n = c.ratings.groupBy("uid").agg(F.count("*").alias("n"))
    users = c.users.join(n, "uid", "left").na.fill(0, ["n"])
    slug = F.concat(F.lit("u"), "uid")
    bits = [F.lit("<h1>U"), F.col("uid"), F.lit(" <span>hi</span></h1><h2>U的电影 · ( "), F.col("n"), F.lit("部看过 )</h2><div>常居: <a>"), F.split("username", "_")[0], F.lit("</a> "), F.col("uid"), F.lit(" ("), slug, F.lit(") 2011-03-04加入</div>")]
    made = users.select("uid", slug.alias("slug"), F.concat(*bits).alias("html"))
    fields = profile_fields(F.col("html"), F.col("slug"))
    return made.select("uid", *(fields[k].alias(k) for k in ("display_name", "tagline", "location", "joined_at", "profile_id", "n_collect")))


#: Rows of a list page at most.
PER_PAGE = 15


@query("SELECT uid, mid, CAST(h + 1 AS INTEGER) // 2 * 1.0 AS rating, CASE CAST(h + 1 AS INTEGER) // 2 WHEN 1 THEN '很差' WHEN 2 THEN '较差' WHEN 3 THEN '还行' WHEN 4 THEN '推荐' ELSE '力荐' END AS rating_label, strftime(rated_at, '%Y-%m-%d') AS day, 'c' || mid AS comment FROM ratings")
def x25_list_pages(c: Catalog) -> DataFrame:
    """The rows of users' list pages, from pages that the ratings are written into."""
    stars = F.floor((F.col("h") + 1) / 2).cast("int")
    bits = [F.lit('<li id="list'), F.col("mid"), F.lit('" class="item"><div class="item-show"><div class="title"><a href="https://e.org/subject/'), F.col("mid"), F.lit('/">T</a></div><div class="date"><span class="rating'), stars, F.lit('-t"></span>&nbsp; '), F.date_format("rated_at", "yyyy-MM-dd"), F.lit('</div></div><div data-cid="1" class="comment-item"><div class="comment"> c'), F.col("mid"), F.lit(" (3 有用)</div></div></li>")]
    page = F.floor((F.row_number().over(Window.partitionBy("uid").orderBy("mid")) - 1) / PER_PAGE).alias("page")
    pages = c.ratings.select("uid", F.concat(*bits).alias("row"), page).groupBy("uid", "page").agg(F.concat(F.lit('<ul class="list-view">'), F.array_join(F.collect_list("row"), ""), F.lit("</ul>")).alias("html"))
    return pages.select("uid", F.explode(list_items(F.col("html"))).alias("i")).select("uid", "i.mid", "i.rating", "i.rating_label", "i.day", "i.comment")


@query("SELECT url, CASE WHEN y <> '' THEN y || '-' || lpad(m, 2, '0') || '-01' WHEN z <> '' THEN z || '-01-01' END AS day FROM (SELECT url, regexp_extract(u, '([0-9]{4})-([0-9]{1,2})', 1) AS y, regexp_extract(u, '([0-9]{4})-([0-9]{1,2})', 2) AS m, regexp_extract(u, '([0-9]{4})', 1) AS z FROM (SELECT url, replace(url, '/', '-') AS u FROM pages))", prelude=False)
def x12_match_date(c: Catalog) -> DataFrame:
    return c.table("pages").select("url", X.match_date(F.replace("url", F.lit("/"), F.lit("-"))).alias("day"))


@query("SELECT DISTINCT p.pid FROM persons p WHERE NOT EXISTS (SELECT 1 FROM directed d WHERE d.pid = p.pid)")
def j3_open_tasks(c: Catalog) -> DataFrame:
    return c.persons.select("pid").join(c.directed, "pid", "left_anti").distinct()


@query("SELECT count(*) AS n_open, (SELECT count(*) FROM persons) AS n_all FROM persons p WHERE NOT EXISTS (SELECT 1 FROM directed d WHERE d.pid = p.pid)")
def a44_open_task_count(c: Catalog) -> DataFrame:
    open_ = c.persons.select("pid").join(c.directed, "pid", "left_anti").agg(F.count("*").alias("n_open"))
    return open_.select("n_open", c.persons.agg(F.count("*").alias("n")).scalar().alias("n_all"))


@query("SELECT count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)", prelude=False)
def j5_not_in(c: Catalog) -> DataFrame:
    """Parts that no line names; one line without a key leaves none, and without lines every part counts, as SQL has it."""
    lines = c.table("lineitem").agg(F.count("*").alias("n_lines"), F.count("l_partkey").alias("n_keys"))
    part = c.table("part").select("p_partkey")
    left = part.join(c.table("lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")
    counted = left.agg(F.count("*").alias("n_left"), F.count("p_partkey").alias("n_named"))
    n = F.when(F.col("n_lines") == 0, F.col("n_left")).when(F.col("n_keys") < F.col("n_lines"), 0).otherwise(F.col("n_named"))
    return counted.crossJoin(lines).select(n.cast("long").alias("n"))  # one row each


@query("SELECT u.uid, u.username FROM users u WHERE EXISTS (SELECT 1 FROM ratings r WHERE r.uid = u.uid)")
def j2_users_with_ratings(c: Catalog) -> DataFrame:
    return c.users.join(c.ratings.select("uid"), "uid", "left_semi").select("uid", "username")


@query("SELECT source, lang, n FROM (SELECT CASE WHEN k <= 15 THEN source ELSE 'other' END AS source, lang, CAST(sum(n) AS BIGINT) AS n FROM (SELECT source, lang, count(*) AS n, dense_rank() OVER (ORDER BY t DESC, source) AS k FROM (SELECT *, count(*) OVER (PARTITION BY source) AS t FROM documents) GROUP BY source, lang, t) GROUP BY 1, 2)", prelude=False)
def a40_top_and_other(c: Catalog) -> DataFrame:
    counts = c.table("documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    top = counts.groupBy("source").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "source").limit(15).select(F.col("source").alias("top"))
    named = counts.join(F.broadcast(top), F.col("source") == F.col("top"), "left").withColumn("source", F.coalesce("top", F.lit("other")))
    return named.groupBy("source", "lang").agg(F.sum("n").alias("n"))


@query("SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, arg_min(text, turn) AS opening FROM conversations GROUP BY conv_id", prelude=False)
def a33_role_merge(c: Catalog) -> DataFrame:
    grouped = c.table("conversations").groupBy("conv_id")
    return grouped.agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.min_by("text", "turn").alias("opening"))


@query("SELECT mid, name FROM movies WHERE contains(lower(name), 'red') AND contains(lower(name), 'ring')")
def pf2_title_search(c: Catalog) -> DataFrame:
    from graphloom.operators.search import search

    return search(c.movie_keys.select("mid", "name", "content_type"), ["name", "content_type"], "ring, RED").select("mid", "name")


@query("SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<h1>((?s:.)*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS title FROM pages", prelude=False)
def x20_page_headings(c: Catalog) -> DataFrame:
    from graphloom.functions.pages import inner

    return c.table("pages").select("page_id", inner(F.col("html"), "h1").alias("title"))


#: Titles without their spaces, and all ways to cut them into the titles' own words; one title has few.
SEGMENTS = """w AS (SELECT word, CAST(floor(ln(CAST(sum(count(*)) OVER () AS DOUBLE) / count(*)) * 1000000 + 0.5) AS BIGINT) AS cost FROM (SELECT unnest(string_split(name, ' ')) AS word FROM movies) WHERE len(word) BETWEEN 1 AND 16 GROUP BY word),
runs AS (SELECT DISTINCT replace(name, ' ', '') AS run FROM movies),
ways AS (SELECT run, 0 AS at_, CAST(0 AS BIGINT) AS cost, CAST([] AS VARCHAR[]) AS words, CAST([] AS INTEGER[]) AS backs FROM runs
  UNION ALL SELECT run, at_ + len(w.word), ways.cost + w.cost, list_append(words, w.word), list_append(backs, -at_) FROM ways JOIN w ON substr(run, at_ + 1, len(w.word)) = w.word WHERE at_ < len(run)),
best AS (SELECT run, words FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY cost, len(words), list_reverse(backs)) AS k FROM ways WHERE at_ = len(run)) WHERE k = 1)"""


@query(f"WITH RECURSIVE {SEGMENTS} SELECT run, list_aggregate(words, 'string_agg', ' ') AS words FROM best")
def pf2_segmented_titles(c: Catalog) -> DataFrame:
    """Every title written without spaces, cut into words again by a dictionary of the titles' words."""
    from graphloom.operators import segment as G

    titles = c.table("part").select(F.col("p_name").alias("name"))
    words = G.dictionary(titles.select(F.explode(F.split("name", " ")).alias("word")))
    return G.segment(titles.select(F.replace("name", F.lit(" "), F.lit("")).alias("run")), words).select("run", F.array_join("words", " ").alias("words"))


@query("SELECT username, 'https://example.org/people/' || username || '/' AS profile, 'https://example.org/people/' || username || '/collect?sort=time&start=' || (uid % 5 * 30) || '&filter=all&mode=list' AS list, 'https://example.org/feed/people/' || username || '/interests' AS feed FROM users")
def x23_addresses(c: Catalog) -> DataFrame:
    """The addresses of every user's profile, a page of the list, and the feed, from the slug in a profile address."""
    host = "https://example.org"
    slug = X.slug_of(F.concat(F.lit(f"{host}/people/"), "username", F.lit("/?from=x")))
    return c.users.select("username", X.profile_url(slug, host).alias("profile"), X.list_url(slug, "collect", F.col("uid") % 5 * 30, host).alias("list"), X.feed_url(slug, host).alias("feed"))
