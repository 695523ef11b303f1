"""Graph loading and traversal, people, and users' activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as X
from graphloom.operators import graph as G
from graphloom.operators import signals as S
from graphloom.operators.profiling import stacked
from graphloom.plans.registry import query
from graphloom.sources.catalog import Catalog
from graphloom.sources.scratch import settled


@query("SELECT DISTINCT trim(t) AS name FROM (SELECT unnest(string_split(genres, '/')) AS t FROM movies) WHERE trim(t) <> ''")
def sk3_lookup_nodes(c: Catalog) -> DataFrame:
    return G.lookup_nodes(c.movies.select("genres"), "genres")


@query("SELECT d.pid, d.mid FROM directed d WHERE d.pid IN (SELECT pid FROM persons) AND d.mid IN (SELECT mid FROM movies WHERE votes >= 20)")
def sk4_valid_edges(c: Catalog) -> DataFrame:
    return G.valid_edges(c.directed, {"pid": c.persons, "mid": c.movies.filter("votes >= 20")}).select("pid", "mid")


@query("SELECT DISTINCT CAST(uid AS VARCHAR) AS uid, mid, h / 2.0 AS rating FROM ratings WHERE mid IN (SELECT mid FROM movies)")
def sk8_rating_edges(c: Catalog) -> DataFrame:
    edges = c.ratings.select(F.col("uid").cast("string").alias("uid"), "mid", (F.col("h") / 2.0).alias("rating"))
    return G.valid_edges(edges, {"mid": c.movie_keys}).select("uid", "mid", "rating")


@query("SELECT coalesce(n.mid, o.mid) AS mid, coalesce(n.name, o.name) AS name, coalesce(n.year, o.year) AS year FROM (SELECT * FROM movies WHERE year < 2000) o FULL JOIN (SELECT mid, upper(name) AS name, CASE WHEN year > 1990 THEN year END AS year FROM movies WHERE year >= 1985) n ON n.mid = o.mid")
def sk1_node_upsert(c: Catalog) -> DataFrame:
    m = c.movie_keys
    new = m.filter("year >= 1985").select("mid", F.upper("name").alias("name"), F.when(F.col("year") > 1990, F.col("year")).alias("year"))
    return G.node_upsert(m.filter("year < 2000").select("mid", "name", "year"), new, "mid")


def tokens(c: Catalog, most_ord: int = 5) -> DataFrame:
    """(mid, rel, entity) of all relations; actors up to a billing position."""
    t = lambda df, rel, col: df.select("mid", F.lit(rel).alias("rel"), F.col(col).alias("entity"))
    m = c.movie_keys.withColumn("bucket", X.year_bucket(F.col("year")))
    return stacked([t(c.directed, "director", "pid"), t(c.acted.filter(F.col("ord") <= most_ord), "actor", "pid"), t(c.genre_edges, "genre", "genre"), t(m, "region", "region"), t(m, "language", "language"), t(m, "content_type", "content_type"), t(m, "year_bucket", "bucket")])


TOKENS = """tokens AS (
  SELECT mid, 'director' AS rel, pid AS entity FROM directed UNION ALL SELECT mid, 'actor', pid FROM acted WHERE ord <= 5
  UNION ALL SELECT mid, 'genre', genre FROM genre_edges UNION ALL SELECT mid, 'region', region FROM movies UNION ALL SELECT mid, 'language', language FROM movies UNION ALL SELECT mid, 'content_type', content_type FROM movies
  UNION ALL SELECT mid, 'year_bucket', CASE WHEN year < 1990 THEN 'before_1990' WHEN year < 2000 THEN '1990s' WHEN year < 2010 THEN '2000s' WHEN year < 2020 THEN '2010s' ELSE '2020s' END FROM movies)"""


@query(f"WITH {TOKENS} SELECT rel, entity, count(*) AS degree FROM tokens GROUP BY 1, 2")
def a36_relation_degrees(c: Catalog) -> DataFrame:
    return G.degrees(tokens(c))


@query(f"WITH {TOKENS} SELECT mid, list_sort(list(DISTINCT rel || ':' || entity)) AS tokens FROM tokens WHERE rel <> 'actor' GROUP BY mid")
def g10_item_entities(c: Catalog) -> DataFrame:
    named = tokens(c).filter("rel <> 'actor'").select("mid", X.relation_token(F.col("rel"), F.col("entity")).alias("t"))
    return named.groupBy("mid").agg(F.array_sort(F.collect_set("t")).alias("tokens"))


@query(
    "WITH f AS (SELECT 'person_' || pid AS h, 'DIRECTED' AS r, 'movie_' || mid AS t FROM directed UNION SELECT 'person_' || pid, 'ACTED_IN', 'movie_' || mid FROM acted UNION SELECT 'movie_' || mid, 'HAS_GENRE', 'genre_' || genre FROM genre_edges "
    "UNION SELECT 'user_' || uid, 'RATED_POSITIVE', 'movie_' || mid FROM ratings WHERE h >= 7) SELECT h, r, t FROM f UNION ALL SELECT t, r || '_REV', h FROM f"
)
def g8_triples(c: Catalog) -> DataFrame:
    return G.triples(
        {
            "DIRECTED": (c.directed, "pid", "person", "mid", "movie"),
            "ACTED_IN": (c.acted, "pid", "person", "mid", "movie"),
            "HAS_GENRE": (c.genre_edges, "mid", "movie", "genre", "genre"),
            "RATED_POSITIVE": (c.ratings.filter("h >= 7"), "uid", "user", "mid", "movie"),
        }
    )


@query("SELECT m.mid, m.name, d.directors, a.actors, g.genres FROM movies m LEFT JOIN (SELECT mid, string_agg(pid, ',' ORDER BY pid) AS directors FROM directed GROUP BY mid) d USING (mid) LEFT JOIN (SELECT mid, string_agg(pid || '@' || ord, ',' ORDER BY ord, pid) AS actors FROM acted GROUP BY mid) a USING (mid) LEFT JOIN (SELECT mid, string_agg(genre, ',' ORDER BY genre) AS genres FROM genre_edges GROUP BY mid) g USING (mid)")
def j7_item_detail(c: Catalog) -> DataFrame:
    directors = c.directed.groupBy("mid").agg(F.array_join(F.array_sort(F.collect_set("pid")), ",").alias("directors"))
    actors = c.acted.groupBy("mid").agg(F.array_sort(F.collect_list(F.struct("ord", "pid"))).alias("a")).select("mid", F.array_join(F.transform("a", lambda x: F.concat_ws("@", x["pid"], x["ord"])), ",").alias("actors"))
    genres = c.genre_edges.groupBy("mid").agg(F.array_join(F.array_sort(F.collect_set("genre")), ",").alias("genres"))
    return c.movie_keys.select("mid", "name").join(directors, "mid", "left").join(actors, "mid", "left").join(genres, "mid", "left")


@query("SELECT p.pid, count(DISTINCT d.mid) AS n_directed, count(DISTINCT a.mid) AS n_acted, count(DISTINCT d.mid) + count(DISTINCT a.mid) AS movie_count FROM persons p LEFT JOIN (SELECT pid, mid, 1 AS k FROM directed UNION ALL SELECT pid, mid, 2 FROM acted) e ON e.pid = p.pid LEFT JOIN directed d ON d.pid = p.pid AND d.mid = e.mid AND e.k = 1 LEFT JOIN acted a ON a.pid = p.pid AND a.mid = e.mid AND e.k = 2 GROUP BY p.pid")
def a32_person_detail(c: Catalog) -> DataFrame:
    counts = lambda df, name: df.groupBy("pid").agg(F.count_distinct("mid").alias(name))
    joined = c.persons.select("pid").join(counts(c.directed, "n_directed"), "pid", "left").join(counts(c.acted, "n_acted"), "pid", "left").na.fill(0)
    return joined.withColumn("movie_count", F.col("n_directed") + F.col("n_acted"))


@query("WITH e AS (SELECT mid, 'director' AS role FROM directed WHERE pid = '7' UNION ALL SELECT mid, 'actor' FROM acted WHERE pid = '7'), g AS (SELECT mid, string_agg(role, ',' ORDER BY role DESC) AS roles, count(*) AS n FROM e GROUP BY mid) SELECT g.mid, m.name, m.year, roles, CASE WHEN n = 1 THEN roles END AS role FROM g JOIN movies m USING (mid)")
def a43_person_items(c: Catalog) -> DataFrame:
    roles = c.directed.filter("pid = '7'").select("mid", F.lit("director").alias("role")).union(c.acted.filter("pid = '7'").select("mid", F.lit("actor")))
    merged = roles.groupBy("mid").agg(F.reverse(F.array_sort(F.collect_set("role"))).alias("r"))
    merged = merged.select("mid", F.array_join("r", ",").alias("roles"), F.when(F.size("r") == 1, F.col("r")[0]).alias("role"))
    return merged.join(c.movie_keys.select("mid", "name", "year"), "mid")


ROLES = "e AS (SELECT pid, mid, 'director' AS role FROM directed UNION ALL SELECT pid, mid, 'actor' FROM acted)"


def person_roles(c: Catalog) -> DataFrame:
    """(pid, mid, roles): the sorted roles of persons in films."""
    roles = c.directed.select("pid", "mid", F.lit("director").alias("role")).union(c.acted.select("pid", "mid", F.lit("actor")))
    return roles.groupBy("pid", "mid").agg(F.array_sort(F.collect_set("role")).alias("roles"))


@query(f"WITH {ROLES}, g AS (SELECT pid, mid, count(*) FILTER (role = 'director') AS d, count(*) FILTER (role = 'actor') AS a FROM e GROUP BY 1, 2) SELECT pid, count(*) AS n_items, count(*) FILTER (d > 0) AS n_director, count(*) FILTER (a > 0) AS n_actor, count(*) FILTER (d > 0 AND a > 0) AS n_both FROM g GROUP BY pid")
def a43_role_counts(c: Catalog) -> DataFrame:
    has = lambda r: F.array_contains("roles", r)
    return person_roles(c).groupBy("pid").agg(F.count("*").alias("n_items"), F.count_if(has("director")).alias("n_director"), F.count_if(has("actor")).alias("n_actor"), F.count_if(has("director") & has("actor")).alias("n_both"))


@query(f"WITH {ROLES} SELECT pid, mid, year, k FROM (SELECT e.pid, e.mid, m.year, row_number() OVER (PARTITION BY e.pid ORDER BY m.year DESC, e.mid) AS k FROM e JOIN movies m USING (mid) WHERE role = 'director') WHERE k <= 20")
def a43_role_filter(c: Catalog) -> DataFrame:
    """The 20 latest films that each person directed."""
    own = person_roles(c).filter(F.array_contains("roles", "director")).join(c.movie_keys.select("mid", "year"), "mid")
    return own.withColumn("k", F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("year"), "mid"))).filter("k <= 20").select("pid", "mid", "year", "k")


@query("SELECT b.pid, count(DISTINCT b.mid) AS n FROM acted a JOIN acted b ON a.mid = b.mid WHERE a.pid = '3' AND b.pid <> '3' GROUP BY 1 ORDER BY n DESC, pid LIMIT 20")
def j10_collaborators(c: Catalog) -> DataFrame:
    return G.collaborators(c.acted, "3", 20)


@query("SELECT m.mid, m.year FROM movies m WHERE mid IN (SELECT mid FROM acted WHERE pid = '3') AND mid IN (SELECT mid FROM acted WHERE pid = '5')")
def j11_common_items(c: Catalog) -> DataFrame:
    return G.common(c.acted, "3", "5").join(c.movie_keys.select("mid", "year"), "mid")


@query("WITH s AS (SELECT mid FROM movies ORDER BY CAST(mid AS BIGINT) LIMIT 20), e AS (SELECT * FROM acted WHERE mid IN (SELECT mid FROM s)) SELECT x.pid AS a, y.pid AS b, count(*) AS n FROM e x JOIN e y ON x.mid = y.mid AND x.pid < y.pid GROUP BY 1, 2")
def j12_person_pairs(c: Catalog) -> DataFrame:
    sample = c.movie_keys.orderBy(F.col("mid").cast("long")).limit(20).select("mid")
    return G.pairs(c.acted, "mid", "pid", sample)


@query("SELECT x.genre AS a, y.genre AS b, count(*) AS n FROM genre_edges x JOIN genre_edges y ON x.mid = y.mid AND x.genre < y.genre GROUP BY 1, 2")
def j13_genre_pairs(c: Catalog) -> DataFrame:
    return G.pairs(c.genre_edges, "mid", "genre")


def edges(c: Catalog) -> DataFrame:
    """Undirected (src, dst, label) between typed nodes."""
    person = c.directed.select(F.concat(F.lit("person_"), "pid").alias("src"), F.concat(F.lit("movie_"), "mid").alias("dst"), F.lit("DIRECTED").alias("label"))
    actor = c.acted.select(F.concat(F.lit("person_"), "pid"), F.concat(F.lit("movie_"), "mid"), F.lit("ACTED_IN"))
    genre = c.genre_edges.select(F.concat(F.lit("movie_"), "mid"), F.concat(F.lit("genre_"), "genre"), F.lit("HAS_GENRE"))
    return person.union(actor).union(genre)


EDGES = "edges AS (SELECT 'person_' || pid AS src, 'movie_' || mid AS dst, 'DIRECTED' AS label FROM directed UNION ALL SELECT 'person_' || pid, 'movie_' || mid, 'ACTED_IN' FROM acted UNION ALL SELECT 'movie_' || mid, 'genre_' || genre, 'HAS_GENRE' FROM genre_edges), und AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"
NEAR = "WITH {e}, n AS (SELECT src, dst FROM und WHERE src = '{x}' ORDER BY dst LIMIT 50) SELECT 1 AS hop, src, dst FROM n UNION ALL SELECT 2, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM und WHERE src IN (SELECT dst FROM n) AND dst <> '{x}') WHERE k <= 10"


@query(NEAR.format(e=EDGES, x="movie_10"))
def g1_item_graph(c: Catalog) -> DataFrame:
    return G.neighbourhood(edges(c), "movie_10", 50, 10)


@query(NEAR.format(e=EDGES, x="person_5"))
def g2_person_graph(c: Catalog) -> DataFrame:
    return G.neighbourhood(edges(c), "person_5", 50, 10)


def path_sql(edges: str, start: str, goal: str, most: int = 6) -> str:
    """SQL (from the view und of ``edges``) of a shortest path: a level per hop, the smallest parent of each new node."""
    levels = [edges, f"l0 AS MATERIALIZED (SELECT '{start}' AS node, CAST(NULL AS VARCHAR) AS parent)"]
    for k in range(1, most + 1):
        known = " UNION ALL ".join(f"SELECT node FROM l{j}" for j in range(k))
        levels.append(f"l{k} AS MATERIALIZED (SELECT dst AS node, min(src) AS parent FROM und JOIN l{k - 1} ON src = node WHERE dst NOT IN ({known}) GROUP BY dst)")
    hits = []
    for k in range(most + 1):
        joins = " ".join(f"JOIN l{j} ON l{j}.node = l{j + 1}.parent" for j in range(k - 1, -1, -1))
        hits.append(f"SELECT {k} AS hops, [{', '.join(f'l{j}.node' for j in range(k + 1))}] AS path FROM l{k} {joins} WHERE l{k}.node = '{goal}'")
    return f"WITH {', '.join(levels)}, found AS ({' UNION ALL '.join(hits)})"


PEOPLE_EDGES = EDGES.replace(" UNION ALL SELECT 'movie_' || mid, 'genre_' || genre, 'HAS_GENRE' FROM genre_edges", "")


@query(path_sql(PEOPLE_EDGES, "movie_1", "movie_2") + " SELECT hops, path FROM found")
def g3_shortest_path(c: Catalog) -> DataFrame:
    return G.shortest_path(edges(c).filter("label <> 'HAS_GENRE'"), "movie_1", "movie_2")


def paths_sql(edges: str, asked: str, most: int = 4) -> str:
    """SQL of shortest paths for many pairs (the view asked), a level per hop for all starts, the smallest parent of each new node."""
    levels = [edges, asked, "l0 AS MATERIALIZED (SELECT DISTINCT start, start AS node, CAST(NULL AS VARCHAR) AS parent FROM asked)"]
    for k in range(1, most + 1):
        known = " UNION ALL ".join(f"SELECT start, node FROM l{j}" for j in range(k))
        levels.append(f"l{k} AS MATERIALIZED (SELECT start, dst AS node, min(src) AS parent FROM und JOIN l{k - 1} ON src = node WHERE NOT EXISTS (SELECT 1 FROM ({known}) s WHERE s.start = l{k - 1}.start AND s.node = dst) GROUP BY 1, 2)")
    hits = []
    for k in range(most + 1):
        joins = " ".join(f"JOIN l{j} ON l{j}.start = a.start AND l{j}.node = l{j + 1}.parent" for j in range(k - 1, -1, -1))
        hits.append(f"SELECT a.start, a.goal, {k} AS hops, [{', '.join(f'l{j}.node' for j in range(k + 1))}] AS path FROM asked a JOIN l{k} ON l{k}.start = a.start AND l{k}.node = a.goal {joins}")
    return f"WITH {', '.join(levels)} {' UNION ALL '.join(hits)}"


ASKED = "asked AS (SELECT 'movie_' || a.mid AS start, CASE WHEN CAST(a.mid AS BIGINT) % 3 = 0 THEN 'person_' ELSE 'movie_' END || CAST(CAST(a.mid AS BIGINT) * 7 % 89 + 1 AS VARCHAR) AS goal FROM movies a WHERE CAST(a.mid AS BIGINT) <= 100)"


@query(paths_sql(EDGES, ASKED))
def g3_path_pairs(c: Catalog) -> DataFrame:
    """Shortest paths between a hundred pairs of nodes, all in one search over the whole graph."""
    n = F.col("mid").cast("long")
    goal = F.concat(F.when(n % 3 == 0, "person_").otherwise("movie_"), (n * 7 % 89 + 1).cast("string"))
    asked = c.movie_keys.filter(n <= 100).select(F.concat(F.lit("movie_"), "mid").alias("start"), goal.alias("goal"))
    return G.shortest_paths(edges(c), asked, 4)


@query(path_sql(EDGES, "person_1", "genre_red") + " SELECT CAST(p - 1 AS INTEGER) AS pos, path[p] AS src, path[p + 1] AS dst FROM (SELECT path, unnest(generate_series(1, len(path) - 1)) AS p FROM found WHERE len(list_filter(path, lambda n: split_part(n, '_', 1) NOT IN ('movie', 'person', 'genre'))) = 0)")
def g5_path_edges(c: Catalog) -> DataFrame:
    path = G.shortest_path(edges(c), "person_1", "genre_red")
    return G.path_parts(G.public_path(path, ["movie", "person", "genre"])).select("pos", "src", "dst")


@query(f"WITH {EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node")
def a42_visible_degrees(c: Catalog) -> DataFrame:
    return G.visible_degrees(edges(c))


@query(f"WITH {EDGES} SELECT least(src, dst) AS a, greatest(src, dst) AS b, list_sort(list(DISTINCT label)) AS labels FROM edges GROUP BY 1, 2")
def a42_merged_edges(c: Catalog) -> DataFrame:
    return G.merged_edges(edges(c))


@query(f"WITH {EDGES} SELECT src, dst FROM edges WHERE split_part(src, '_', 1) <> 'genre' AND split_part(dst, '_', 1) <> 'genre'")
def pf18_hide_kinds(c: Catalog) -> DataFrame:
    e = edges(c).select("src", "dst")
    ends = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return G.drop_hidden(ends.withColumn("kind", F.split("id", "_")[0]), e, ["genre"]).select("src", "dst")


@query(
    "WITH best AS (SELECT mid FROM movies WHERE score IS NOT NULL ORDER BY score DESC, mid LIMIT 20), hashed AS (SELECT mid FROM movies ORDER BY md5('7:' || mid), mid LIMIT 10), "
    "per AS (SELECT mid FROM (SELECT mid, row_number() OVER (PARTITION BY genre ORDER BY mid) AS k FROM genre_edges) WHERE k <= 2), s AS (SELECT mid FROM best UNION SELECT mid FROM hashed UNION SELECT mid FROM per) "
    "SELECT s.mid, p.pid FROM s JOIN (SELECT *, row_number() OVER (PARTITION BY mid ORDER BY ord, pid) AS k FROM acted) p ON p.mid = s.mid AND p.k <= 3"
)
def g4_overview_graph(c: Catalog) -> DataFrame:
    best = c.movies.filter("score IS NOT NULL").orderBy(F.desc("score"), "mid").limit(20).select("mid")
    hashed = c.movie_keys.select("mid").orderBy(F.md5(F.concat(F.lit("7:"), "mid")), "mid").limit(10)
    per = c.genre_edges.withColumn("k", F.row_number().over(Window.partitionBy("genre").orderBy("mid"))).filter("k <= 2").select("mid")
    seeds = best.union(hashed).union(per).distinct()
    cast = c.acted.withColumn("k", F.row_number().over(Window.partitionBy("mid").orderBy("ord", "pid"))).filter("k <= 3")
    return seeds.join(cast, "mid").select("mid", "pid")


@query("WITH r AS (SELECT uid, mid FROM ratings), m AS (SELECT uid, mid, 'rating' AS kind FROM ratings UNION ALL SELECT uid, mid, pref_type FROM prefs) SELECT u.uid, count(*) FILTER (kind = 'rating') AS n_ratings, count(*) FILTER (kind = 'like') AS n_likes, count(*) FILTER (kind = 'want_to_watch') AS n_wishes, count(DISTINCT mid) AS effective, count(DISTINCT mid) < 3 AS cold FROM users u LEFT JOIN m ON m.uid = u.uid GROUP BY u.uid")
def a28_activity(c: Catalog) -> DataFrame:
    return S.activity(c.users, c.ratings, c.prefs)


SIGNALS = """signals AS (SELECT uid, mid, 'rating' AS kind, CAST(h * 10 AS BIGINT) AS weight100, rated_at AS at_ FROM ratings WHERE h >= 7
  UNION ALL SELECT uid, mid, pref_type, CAST(CASE WHEN pref_type = 'like' THEN 70 ELSE 25 END AS BIGINT), created_at FROM prefs p WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.uid = p.uid AND r.mid = p.mid))"""


@query(f"WITH {SIGNALS} SELECT uid, mid, kind, weight100 FROM signals")
def r2_positive_signals(c: Catalog) -> DataFrame:
    return S.positive_signals(c.ratings, c.prefs).select("uid", "mid", "kind", "weight100")


@query(f"WITH {SIGNALS} SELECT uid, mid, kind, weight100 FROM (SELECT *, row_number() OVER (PARTITION BY uid, kind ORDER BY weight100 DESC, at_ DESC, mid) AS k FROM signals) WHERE k <= CASE kind WHEN 'rating' THEN 30 WHEN 'like' THEN 10 ELSE 0 END")
def r3_capped_signals(c: Catalog) -> DataFrame:
    return S.capped_signals(S.positive_signals(c.ratings, c.prefs), {"rating": 30, "like": 10, "want_to_watch": 0}).select("uid", "mid", "kind", "weight100")


@query("SELECT coalesce(r.uid, p.uid) AS uid, coalesce(r.mid, p.mid) AS mid, coalesce(signal, r.h / 2.0, 0) AS content_weight, coalesce(signal, r.h / 2.0 / 5, 0) AS weight FROM ratings r FULL JOIN (SELECT uid, mid, max(CASE WHEN pref_type = 'like' THEN 0.7 ELSE 0.25 END) AS signal FROM prefs GROUP BY 1, 2) p ON p.uid = r.uid AND p.mid = r.mid")
def x33_signal_weights(c: Catalog) -> DataFrame:
    """What a mark or rating weighs for content ranking and for the others."""
    marks = c.prefs.groupBy("uid", "mid").agg(F.max(F.when(F.col("pref_type") == "like", S.LIKE).otherwise(S.WISH)).alias("signal"))
    both = c.ratings.select("uid", "mid", (F.col("h") / 2).alias("rating")).join(marks, ["uid", "mid"], "full")
    return both.select("uid", "mid", S.signal_weight(F.col("signal"), F.col("rating"), raw=True).alias("content_weight"), S.signal_weight(F.col("signal"), F.col("rating")).alias("weight"))


@query("SELECT uid, mid FROM ratings UNION SELECT uid, mid FROM prefs")
def r4_seen_items(c: Catalog) -> DataFrame:
    return S.seen_items(c.ratings, c.prefs)


INDEX = "index_ AS (SELECT uid, mid, max(w) AS weight100, count(*) OVER (PARTITION BY uid) AS degree FROM (SELECT uid, mid, CAST(h * 10 AS BIGINT) AS w FROM ratings WHERE h >= 7 UNION ALL SELECT uid, mid, 70 FROM prefs WHERE pref_type = 'like') GROUP BY uid, mid)"


@query(f"WITH {INDEX} SELECT * FROM index_")
def a35_weight_index(c: Catalog) -> DataFrame:
    return S.weight_index(c.ratings, c.prefs)


TASTE = "WITH {s}, l AS (SELECT DISTINCT uid, mid FROM signals), g AS (SELECT l.uid, {e} AS entity, count(*) AS n, floor(avg(r.h) * 100 + 0.5) / 100 AS avg_h FROM l JOIN {t} t ON t.mid = l.mid LEFT JOIN ratings r ON r.uid = l.uid AND r.mid = l.mid GROUP BY 1, 2) SELECT uid, entity, n, avg_h FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, entity) AS k FROM g) WHERE k <= 10"


@query(TASTE.format(s=SIGNALS, e="t.genre", t="genre_edges"))
def a29_genre_profile(c: Catalog) -> DataFrame:
    ratings = settled(c.ratings, "ratings")
    return S.taste(S.positive_signals(ratings, c.prefs), c.genre_edges.withColumnRenamed("genre", "entity"), ratings, 10)


PEOPLE_TASTE = "SELECT 'director' AS role, * FROM ({d}) UNION ALL SELECT 'actor', * FROM ({a})"


@query(PEOPLE_TASTE.format(d=TASTE.format(s=SIGNALS, e="t.pid", t="directed").replace("WITH ", "WITH ", 1), a=TASTE.format(s=SIGNALS, e="t.pid", t="acted")), prelude=True)
def a30_people_profile(c: Catalog) -> DataFrame:
    """Each user's ten directors and ten actors of most liked items."""
    ratings = settled(c.ratings, "ratings")
    likes = settled(S.positive_signals(ratings, c.prefs).select("uid", "mid").distinct().join(ratings.select("uid", "mid", "h"), ["uid", "mid"], "left"), "likes")
    one = lambda role, df: S.liked_entities(likes, df.select("mid", F.col("pid").alias("entity")), 10).select(F.lit(role).alias("role"), "*")
    return one("director", c.directed).union(one("actor", c.acted))


TAGS = f"""WITH {SIGNALS}, l AS (SELECT DISTINCT uid, mid FROM signals),
g AS (SELECT uid, 'genre' AS kind, genre AS tag, count(*) * 3 AS weight, 0 AS k FROM l JOIN genre_edges USING (mid) GROUP BY 1, 2, 3
  UNION ALL SELECT uid, 'director', pid, count(*) * 2, row_number() OVER (PARTITION BY uid ORDER BY count(*) DESC, pid) FROM l JOIN directed USING (mid) GROUP BY 1, 2, 3
  UNION ALL SELECT uid, 'actor', pid, count(*), row_number() OVER (PARTITION BY uid ORDER BY count(*) DESC, pid) + 1000 FROM l JOIN acted USING (mid) GROUP BY 1, 2, 3)
SELECT uid, kind, tag, weight, row_number() OVER (PARTITION BY uid ORDER BY weight DESC, kind, tag) AS place FROM g WHERE k <= 15 OR k BETWEEN 1001 AND 1020"""


@query(TAGS)
def a31_tag_cloud(c: Catalog) -> DataFrame:
    """Genres three times, the first 15 directors twice and the first 20 actors once, the heaviest first."""
    likes = settled(S.positive_signals(settled(c.ratings, "ratings"), c.prefs).select("uid", "mid").distinct(), "likes").withColumn("h", F.lit(None).cast("int"))

    def tags(df: DataFrame, kind: str, times: int, most: int | None) -> DataFrame:
        return S.liked_entities(likes, df, most).select("uid", F.lit(kind).alias("kind"), F.col("entity").alias("tag"), (F.col("n") * times).alias("weight"))

    people = lambda df: df.select("mid", F.col("pid").alias("entity"))
    rows = stacked([tags(c.genre_edges.withColumnRenamed("genre", "entity"), "genre", 3, None), tags(people(c.directed), "director", 2, 15), tags(people(c.acted), "actor", 1, 20)])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("weight"), "kind", "tag")))


@query(
    "WITH m AS (SELECT uid, mid, 1 AS pri, 'RATED' AS rel FROM ratings UNION ALL SELECT uid, mid, CASE WHEN pref_type = 'like' THEN 2 ELSE 3 END, CASE WHEN pref_type = 'like' THEN 'LIKED' ELSE 'WANT' END FROM prefs), "
    "b AS (SELECT uid, mid, min(pri) AS pri, arg_min(rel, pri) AS rel FROM m GROUP BY 1, 2) SELECT uid, mid, rel FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY pri, mid) AS k FROM b) WHERE k <= 20"
)
def g7_profile_graph(c: Catalog) -> DataFrame:
    kind = F.when(F.col("pref_type") == "like", F.struct(F.lit(2).alias("pri"), F.lit("LIKED").alias("rel"))).otherwise(F.struct(F.lit(3).alias("pri"), F.lit("WANT").alias("rel")))
    marks = c.ratings.select("uid", "mid", F.struct(F.lit(1).alias("pri"), F.lit("RATED").alias("rel")).alias("m")).union(c.prefs.select("uid", "mid", kind))
    best = marks.groupBy("uid", "mid").agg(F.min("m").alias("m"))
    order = Window.partitionBy("uid").orderBy("m.pri", "mid")
    return best.withColumn("k", F.row_number().over(order)).filter("k <= 20").select("uid", "mid", "m.rel")


@query(f"SELECT uid FROM ratings GROUP BY uid HAVING count(*) >= 3 AND count(*) FILTER (h >= 7) >= 2")
def a26_eligible_users(c: Catalog) -> DataFrame:
    from graphloom.operators.evaluate import eligible

    return eligible(c.ratings)


MOCK = "(SELECT count(*) FROM {t} WHERE uid % 50 = 0) AS mock_{t}"


@query(f"SELECT count(*) AS n_users, count(*) FILTER (is_mock) AS n_mock, count(*) FILTER (NOT is_mock) AS n_real, {MOCK.format(t='ratings')}, {MOCK.format(t='prefs')}, (SELECT count(*) FROM ratings) AS n_ratings, (SELECT count(*) FROM prefs) AS n_prefs FROM users")
def a27_cohort_summary(c: Catalog) -> DataFrame:
    mock = c.users.select("uid", "is_mock")
    rows = lambda df, k: df.join(mock, "uid", "left").select(F.lit(k).alias("k"), F.coalesce("is_mock", F.lit(False)).alias("mock"))
    kinds = c.users.select(F.lit("u").alias("k"), F.col("is_mock").alias("mock")).union(rows(c.ratings, "r")).union(rows(c.prefs, "p"))
    n = lambda k, only=None: F.count_if((F.col("k") == k) & (F.lit(True) if only is None else F.col("mock") == only))
    return kinds.agg(n("u").alias("n_users"), n("u", True).alias("n_mock"), n("u", False).alias("n_real"), n("r", True).alias("mock_ratings"), n("p", True).alias("mock_prefs"), n("r").alias("n_ratings"), n("p").alias("n_prefs"))
