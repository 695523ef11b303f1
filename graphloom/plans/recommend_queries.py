"""Recommendation and evaluation over all users."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as X
from graphloom.operators import evaluate as E
from graphloom.operators import recommend as R
from graphloom.operators import signals as S
from graphloom.operators.exact_rank import embed_top
from graphloom.operators.graph import triples
from graphloom.operators.transe import train
from graphloom.plans.graph_queries import INDEX, SIGNALS, TOKENS, tokens
from graphloom.plans.registry import query
from graphloom.sources import embedding_store
from graphloom.sources.catalog import Catalog
from graphloom.sources.scratch import settled, shared_dir

SEEDS = f"{SIGNALS}, seeds AS (SELECT uid, mid, weight100 FROM (SELECT *, row_number() OVER (PARTITION BY uid, kind ORDER BY weight100 DESC, at_ DESC, mid) AS k FROM signals) WHERE k <= CASE kind WHEN 'rating' THEN 30 WHEN 'like' THEN 10 ELSE 0 END)"
SEEN = "seen AS (SELECT uid, mid FROM ratings UNION SELECT uid, mid FROM prefs)"
SIM = """norms AS (SELECT mid, CAST(sum(h * h) AS BIGINT) AS n FROM ratings GROUP BY mid),
half AS (SELECT x.mid AS a, y.mid AS b, CAST(sum(x.h * y.h) AS BIGINT) AS dot FROM ratings x JOIN ratings y ON x.uid = y.uid AND x.mid < y.mid GROUP BY 1, 2 HAVING count(*) >= 2),
sims AS (SELECT a, b, CAST(floor(dot / sqrt(na.n * nb.n) * 1000000.0 + 0.5) AS BIGINT) AS sim6 FROM half JOIN norms na ON na.mid = a JOIN norms nb ON nb.mid = b),
similarity AS (SELECT a, b, sim6 FROM sims UNION ALL SELECT b, a, sim6 FROM sims)"""
TOP = """, fresh AS (SELECT s.* FROM scores s WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.uid = s.uid AND seen.mid = s.mid)),
scaled AS (SELECT uid, mid, floor(raw / max(raw) OVER (PARTITION BY uid) * 10000 + 0.5) / 10000 AS score FROM fresh)
SELECT uid, mid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, mid) AS rank FROM scaled WHERE score > 0) WHERE rank <= 10"""


def with_ratings(c: Catalog) -> Catalog:
    """The catalogue with ratings that are made once."""
    if not getattr(c, "rated", False):
        c.ratings, c.rated = settled(c.ratings, "ratings"), True
    return c


def seeds(c: Catalog) -> DataFrame:
    """(uid, mid, weight100): the signals that recommenders start from."""
    return S.capped_signals(S.positive_signals(c.ratings, c.prefs), {"rating": 30, "like": 10, "want_to_watch": 0}).select("uid", "mid", "weight100")


def seen(c: Catalog) -> DataFrame:
    return S.seen_items(c.ratings, c.prefs)


@query(f"WITH {SIM} SELECT a, b, sim6 FROM similarity")
def j14_item_similarity(c: Catalog) -> DataFrame:
    return R.item_similarity(c.ratings)


def item_cf_top(c: Catalog, n: int) -> DataFrame:
    """item_cf_top over ratings that are made once."""
    c = with_ratings(c)
    return R.item_cf_top(seeds(c), c.ratings, n, seen(c))


CF_SCORES = "scores AS (SELECT s.uid, b AS mid, CAST(sum(weight100 * sim6) AS BIGINT) AS raw FROM seeds s JOIN similarity ON a = s.mid GROUP BY 1, 2)"


@query(f"WITH {SEEDS}, {SEEN}, {SIM}, {CF_SCORES} {TOP}")
def r7_item_cf(c: Catalog) -> DataFrame:
    return item_cf_top(c, 10).drop("best_seed")


@query(f"WITH {SEEDS}, {SEEN}, {SIM}, per AS (SELECT s.uid, b AS mid, sim6, weight100, s.mid AS seed FROM seeds s JOIN similarity ON a = s.mid), scores AS (SELECT uid, mid, CAST(sum(weight100 * sim6) AS BIGINT) AS raw FROM per GROUP BY 1, 2), ranked AS (SELECT * FROM (SELECT uid, mid, score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, mid) AS rank FROM (SELECT uid, mid, floor(raw / max(raw) OVER (PARTITION BY uid) * 10000 + 0.5) / 10000 AS score FROM scores s WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.uid = s.uid AND seen.mid = s.mid)) WHERE score > 0) WHERE rank <= 5) SELECT uid, mid, rank, seed AS best_seed FROM (SELECT r.uid, r.mid, r.rank, p.seed, row_number() OVER (PARTITION BY r.uid, r.mid ORDER BY sim6 DESC, weight100 DESC, seed) AS k FROM ranked r JOIN per p ON p.uid = r.uid AND p.mid = r.mid) WHERE k = 1")
def w8_best_seed(c: Catalog) -> DataFrame:
    """Each user's five best items by co-rating, with the seed that is most similar: the reason to show."""
    return item_cf_top(c, 5).select("uid", "mid", "rank", "best_seed")


CONTENT = f"""units AS (SELECT mid, token, CAST(floor(10000 / sqrt(CAST(count(*) OVER (PARTITION BY mid) AS DOUBLE)) + 0.5) AS BIGINT) AS u4 FROM (SELECT DISTINCT mid, rel || ':' || entity AS token FROM tokens WHERE rel IN ('genre', 'region', 'year_bucket'))),
taste AS (SELECT uid, token, CAST(sum(weight100 * u4) AS BIGINT) AS t FROM seeds JOIN units USING (mid) GROUP BY 1, 2),
norm AS (SELECT uid, CAST(sum(t * t) AS BIGINT) AS n2 FROM taste GROUP BY 1),
dots AS (SELECT t.uid, u.mid, CAST(sum(t * u4) AS BIGINT) AS dot FROM taste t JOIN units u USING (token) GROUP BY 1, 2),
cosine AS (SELECT uid, mid, floor(dot / sqrt(n2) / 10000.0 * 10000.0 + 0.5) / 10000.0 AS score FROM dots JOIN norm USING (uid))"""


def content_tokens(c: Catalog) -> DataFrame:
    chosen = tokens(c).filter(F.col("rel").isin("genre", "region", "year_bucket"))
    return chosen.select("mid", X.relation_token(F.col("rel"), F.col("entity")).alias("token")).distinct()


@query(f"WITH {SEEDS}, {SEEN}, {TOKENS}, {CONTENT}, fresh AS (SELECT s.* FROM cosine s WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.uid = s.uid AND seen.mid = s.mid)) SELECT uid, mid, score FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, mid) AS k FROM fresh) WHERE k <= 10")
def r6_content(c: Catalog) -> DataFrame:
    return R.content_top(seeds(c), content_tokens(c), 10, seen(c)).select("uid", "mid", "score")


IDF = "idfs AS (SELECT rel, entity, CAST(floor(1 / ln(2.0 + greatest(count(*), 1)) * 1000000.0 + 0.5) AS BIGINT) AS idf6 FROM tokens GROUP BY 1, 2)"
HOPS = f"""{TOKENS}, {IDF},
seedtok AS (SELECT mid, rel, entity FROM tokens WHERE rel <> 'genre' UNION ALL SELECT mid, rel, entity FROM (SELECT t.*, row_number() OVER (PARTITION BY t.mid ORDER BY d > 15000, d, t.entity) AS k FROM tokens t JOIN (SELECT entity, count(*) AS d FROM tokens WHERE rel = 'genre' GROUP BY 1) USING (entity) WHERE rel = 'genre') WHERE k = 1),
shared AS (SELECT x.mid AS seed, x.rel, y.mid, x.entity, i.idf6, row_number() OVER (PARTITION BY x.mid, x.rel, y.mid ORDER BY x.entity) AS e FROM seedtok x JOIN tokens y ON x.rel = y.rel AND x.entity = y.entity AND x.mid <> y.mid JOIN idfs i ON i.rel = x.rel AND i.entity = x.entity),
grouped AS (SELECT seed, rel, mid, count(*) AS hits, CAST(floor(CAST(sum(idf6) FILTER (e <= 5) AS DOUBLE) / count(*) FILTER (e <= 5)) AS BIGINT) AS penalty6 FROM shared GROUP BY 1, 2, 3),
hops AS (SELECT seed, rel, mid, hits, penalty6 FROM (SELECT *, row_number() OVER (PARTITION BY seed, rel ORDER BY hits DESC, mid DESC) AS k FROM grouped) WHERE k <= CASE rel WHEN 'director' THEN 30 WHEN 'actor' THEN 50 WHEN 'genre' THEN 50 WHEN 'region' THEN 15 WHEN 'language' THEN 15 WHEN 'content_type' THEN 5 ELSE 10 END)"""


@query(f"WITH {HOPS} SELECT * FROM hops")
def r9_one_hop(c: Catalog) -> DataFrame:
    return R.one_hop(tokens(c))


TWO = """billed AS (SELECT mid, pid, ord FROM acted WHERE ord <= 5), deg AS (SELECT pid, count(*) AS d FROM billed GROUP BY 1),
kept AS (SELECT mid, pid FROM (SELECT a.mid, a.pid, row_number() OVER (PARTITION BY a.mid ORDER BY d, a.ord, a.pid) AS k FROM billed a JOIN deg USING (pid)) WHERE k <= 3),
reach AS MATERIALIZED (SELECT s.mid AS seed, z.pid AS b, min(y.mid) AS low, max(y.mid) AS high FROM kept s JOIN billed y ON y.pid = s.pid AND y.mid <> s.mid JOIN kept z ON z.mid = y.mid AND z.pid <> s.pid GROUP BY 1, 2),
far AS (SELECT seed, mid, count(*) AS hits FROM reach JOIN billed k ON k.pid = b WHERE k.mid <> seed AND (low <> high OR k.mid <> low) GROUP BY 1, 2),
best AS MATERIALIZED (SELECT seed, mid, hits FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hits DESC, mid DESC) AS k FROM far) WHERE k <= 30),
named AS (SELECT t.seed, t.mid, t.hits, CAST(floor(1 / ln(2.0 + greatest(d, 1)) * 1000000.0 + 0.5) AS BIGINT) AS idf6, row_number() OVER (PARTITION BY t.seed, t.mid ORDER BY k.ord, k.pid) AS p FROM best t JOIN billed k ON k.mid = t.mid JOIN reach r ON r.seed = t.seed AND r.b = k.pid JOIN deg ON deg.pid = k.pid WHERE low <> high OR t.mid <> low),
twohop AS (SELECT seed, mid, hits, CAST(floor(CAST(sum(idf6) AS DOUBLE) / count(*)) AS BIGINT) AS penalty6 FROM named WHERE p <= 3 GROUP BY 1, 2, 3)"""


def first_billed(c: Catalog) -> DataFrame:
    """(mid, pid, ord) of the actors that two-hop paths use: the first five."""
    return c.acted.filter("ord <= 5").select("mid", "pid", "ord")


@query(f"WITH {TWO} SELECT * FROM twohop")
def r10_two_hop(c: Catalog) -> DataFrame:
    return R.two_hop(first_billed(c))


AUDIENCE = f"""{INDEX}, each_ AS (SELECT *, CAST(floor(1 / ln(2.0 + greatest(degree, 1)) * 1000000.0 + 0.5) AS BIGINT) AS pen6 FROM index_),
lead_ AS (SELECT uid, mid AS seed, weight100 AS w, pen6 FROM (SELECT *, row_number() OVER (PARTITION BY mid ORDER BY weight100 * pen6 DESC, CAST(uid AS VARCHAR) DESC) AS k FROM each_) WHERE k <= 200),
aud AS (SELECT seed, e.mid, CAST(sum(w * e.weight100 * l.pen6) AS BIGINT) AS strength, count(*) AS hits FROM lead_ l JOIN each_ e ON e.uid = l.uid WHERE e.mid <> seed GROUP BY 1, 2),
audience AS (SELECT seed, mid, strength, hits FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY strength DESC, hits DESC, mid DESC) AS k FROM aud) WHERE k <= 120)"""


@query(f"WITH {AUDIENCE} SELECT * FROM audience")
def r11_shared_audience(c: Catalog) -> DataFrame:
    return R.shared_audience(S.weight_index(c.ratings, c.prefs))


WEIGHT = "CASE rel WHEN 'director' THEN 40 WHEN 'actor' THEN 40 WHEN 'genre' THEN 20 WHEN 'region' THEN 10 WHEN 'language' THEN 10 WHEN 'content_type' THEN 5 WHEN 'year_bucket' THEN 5 ELSE 0 END"
EVIDENCE = f"""{HOPS}, {TWO}, {AUDIENCE}, evidence AS (
  SELECT seed, rel, mid, hits, CAST(floor((CASE WHEN rel = 'genre' THEN least(hits * 100, 300) / 3 ELSE hits * 100 END) * {WEIGHT} * penalty6 / 10000) AS BIGINT) AS worth FROM hops
  UNION ALL SELECT seed, 'actor_actor', mid, hits, CAST(floor(CAST(hits * 100 AS DOUBLE) * 10 * penalty6 / 10000) AS BIGINT) FROM twohop
  UNION ALL SELECT seed, 'shared_audience', mid, hits, CAST(floor(strength * 60 / 1000000) AS BIGINT) FROM audience)"""
PATH_TOP = """pathraw AS (SELECT s.uid, e.mid, CAST(sum(weight100 * worth) AS BIGINT) AS raw, CAST(sum(hits) AS BIGINT) AS paths FROM seeds s JOIN evidence e ON e.seed = s.mid WHERE worth > 0 GROUP BY 1, 2),
pathfresh AS (SELECT s.* FROM pathraw s WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.uid = s.uid AND seen.mid = s.mid)),
pathtop AS (SELECT uid, mid, floor(raw / max(raw) OVER (PARTITION BY uid) * 10000 + 0.5) / 10000 AS score, row_number() OVER (PARTITION BY uid ORDER BY raw DESC, paths DESC, mid DESC) AS rank FROM pathfresh)"""


def path_inputs(c: Catalog, caps: dict[str, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds, seen items and weights of likes, over ratings that are made once."""
    c = with_ratings(c)
    own = S.capped_signals(S.positive_signals(c.ratings, c.prefs), caps).select("uid", "mid", "weight100")
    return own, seen(c), S.weight_index(c.ratings, c.prefs)


@query(f"WITH {SEEDS}, {SEEN}, {EVIDENCE}, {PATH_TOP} SELECT uid, mid, score, rank FROM pathtop WHERE rank <= 10")
def r12_kg_path(c: Catalog) -> DataFrame:
    own, known, index = path_inputs(c, R.KG_SIGNALS)
    return R.best_paths(own, *R.film_evidence(tokens(c), first_billed(c), index), 10, known)


OVER = """valued AS (SELECT t.mid, t.rel, t.entity, CASE t.rel WHEN 'director' THEN 100 WHEN 'actor' THEN 60 WHEN 'genre' THEN 40 WHEN 'region' THEN 20 WHEN 'language' THEN 20 ELSE 10 END * idf6 AS v FROM tokens t JOIN idfs i ON i.rel = t.rel AND i.entity = t.entity),
liking AS (SELECT uid, rel, entity, CAST(sum(weight100 * v) AS BIGINT) AS t FROM seeds JOIN valued USING (mid) GROUP BY 1, 2, 3),
recalled AS MATERIALIZED (SELECT u.uid, v.mid FROM (SELECT DISTINCT s.uid FROM seeds s JOIN vecs USING (mid)) u CROSS JOIN vecs v WHERE NOT EXISTS (SELECT 1 FROM seen n WHERE n.uid = u.uid AND n.mid = v.mid)),
overlap_ AS MATERIALIZED (SELECT l.uid, k.mid, CAST(sum(l.t) AS BIGINT) AS overlap FROM liking l JOIN tokens k ON l.rel = k.rel AND l.entity = k.entity WHERE k.mid IN (SELECT mid FROM vecs) GROUP BY 1, 2)"""


def vectors(c: Catalog) -> DataFrame:
    """(mid, vec): vectors of the catalogue's items, of length R.PARTS in whole numbers."""
    return R.whole_vectors(c.table("embeddings").join(c.table("part"), F.col("vec_id") == F.col("p_partkey"), "left_semi").select(F.col("vec_id").cast("string").alias("mid"), F.col("embedding").alias("vec")))


VECS = """raws AS (SELECT CAST(vec_id AS VARCHAR) AS mid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part)),
lens AS (SELECT mid, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM raws),
vecs AS MATERIALIZED (SELECT mid, list_transform(v, lambda x: floor(x / greatest(n, 1e-12) * 10000 + 0.5)) AS v FROM lens)"""
EMBED = """own AS (SELECT s.uid, s.weight100 AS w, v.v, sqrt(list_dot_product(v.v, v.v)) AS n FROM seeds s JOIN vecs v USING (mid)),
dims AS (SELECT uid, i, sum(w * v[i]) AS x FROM own, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY 1, 2),
centre AS (SELECT uid, list(x ORDER BY i) AS v FROM dims GROUP BY 1),
cands AS (SELECT r.uid, r.mid, v.v, sqrt(list_dot_product(v.v, v.v)) AS n FROM recalled r JOIN vecs v USING (mid)),
cent AS (SELECT k.uid, k.mid, CAST(greatest(floor(list_dot_product(k.v, c.v) / greatest(k.n * sqrt(list_dot_product(c.v, c.v)), 1e-9) * 1000000 + 0.5), 0) AS BIGINT) AS centroid6 FROM cands k JOIN centre c ON c.uid = k.uid),
most AS (SELECT k.uid, k.mid, max(CAST(greatest(floor(list_dot_product(k.v, o.v) / greatest(k.n * o.n, 1e-9) * 1000000 + 0.5), 0) AS BIGINT) * o.w) AS most_seed6 FROM cands k JOIN own o ON o.uid = k.uid GROUP BY 1, 2),
parts AS MATERIALIZED (SELECT uid, mid, centroid6, CAST(most_seed6 AS BIGINT) AS most_seed6 FROM cent JOIN most USING (uid, mid))"""


def _scaled(column: str) -> str:
    w = "OVER (PARTITION BY uid)"
    return f"CASE WHEN max({column}) {w} > min({column}) {w} THEN CAST({column} - min({column}) {w} AS DOUBLE) / (max({column}) {w} - min({column}) {w}) WHEN {column} > 0 THEN 1.0 ELSE 0.0 END"


KG = f"""gathered AS (SELECT r.uid, r.mid, coalesce(centroid6, 0) AS centroid6, coalesce(most_seed6, 0) AS most_seed6, coalesce(overlap, 0) AS overlap FROM recalled r LEFT JOIN parts p ON p.uid = r.uid AND p.mid = r.mid LEFT JOIN overlap_ o ON o.uid = r.uid AND o.mid = r.mid),
kgraw AS (SELECT *, floor((0.0 + {_scaled('centroid6')} * 0.4 + {_scaled('most_seed6')} * 0.2 + {_scaled('overlap')} * 0.4) * 10000.0 + 0.5) / 10000.0 AS score FROM gathered),
kg AS (SELECT uid, mid, score, centroid6, most_seed6, overlap, row_number() OVER (PARTITION BY uid ORDER BY score DESC, mid) AS rank FROM kgraw WHERE score > 0)"""


def kg_embed(c: Catalog, n: int, users: DataFrame | None = None, v: DataFrame | None = None, weights: dict[str, float] = R.EMBED_WEIGHTS, s: DataFrame | None = None) -> DataFrame:
    """(uid, mid, components, score, rank): each user's best films of all that have a vector."""
    own, known, _ = path_inputs(c, R.KG_SIGNALS)
    s, t, v = settled(own if s is None else s, "seeds"), settled(tokens(c), "tokens"), vectors(c) if v is None else v
    return embed_top(s, R.listed_taste(s, t, v), t, v, n, known, users, weights)


@query(f"WITH {SEEDS}, {SEEN}, {TOKENS}, {IDF}, {VECS}, {OVER}, {EMBED}, {KG} SELECT uid, mid, score, rank FROM kg WHERE rank <= 10")
def r18_kg_embed(c: Catalog) -> DataFrame:
    return kg_embed(c, 10).select("uid", "mid", "score", "rank")


@query(f"WITH {SEEDS}, {SEEN}, {TOKENS}, {IDF}, {VECS}, {OVER}, {EMBED}, {KG} SELECT uid, mid, centroid6, most_seed6, rank FROM kg WHERE rank <= 20")
def r16_embedding_components(c: Catalog) -> DataFrame:
    """What each user's 20 best films owe to the vectors."""
    return kg_embed(c, 20).select("uid", "mid", "centroid6", "most_seed6", "rank")


@query(f"WITH {SEEDS}, {SEEN}, {TOKENS}, {IDF}, {VECS}, {OVER}, sized AS (SELECT r.uid, r.mid, coalesce(overlap, 0) AS overlap FROM recalled r LEFT JOIN overlap_ o ON o.uid = r.uid AND o.mid = r.mid), scored AS (SELECT *, floor((0.0 + {_scaled('overlap')} * 1.0) * 10000.0 + 0.5) / 10000.0 AS score FROM sized) SELECT uid, mid, overlap, rank FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, mid) AS rank FROM scored WHERE score > 0) WHERE rank <= 20")
def r19_entity_overlap(c: Catalog) -> DataFrame:
    """Each user's 20 best films by the entities that they share with the seeds."""
    return kg_embed(c, 20, weights={"overlap": 1.0}).select("uid", "mid", "overlap", "rank")


CF_BRANCH = "cfall AS (SELECT uid, mid, floor(raw / max(raw) OVER (PARTITION BY uid) * 10000 + 0.5) / 10000 AS score FROM (SELECT s.* FROM scores s WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.uid = s.uid AND seen.mid = s.mid))), cf AS (SELECT uid, mid, score AS c FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, mid) AS k FROM cfall WHERE score > 0) WHERE k <= 400)"
FUSE = """j AS (SELECT coalesce(kgb.uid, cf.uid) AS uid, coalesce(kgb.mid, cf.mid) AS mid, coalesce(k, 0) AS k, coalesce(c, 0) AS c FROM kgb FULL JOIN cf ON kgb.uid = cf.uid AND kgb.mid = cf.mid),
f AS (SELECT uid, mid, floor(CASE WHEN k > 0 AND c > 0 THEN k + c * (0.3 / 0.7) + least(k, c) * 0 + 0.02 WHEN k > 0 THEN k ELSE c * 0.3 END * 1000000.0 + 0.5) / 1000000.0 AS raw,
  CASE WHEN k > 0 AND c > 0 THEN CASE WHEN k >= c * (0.3 / 0.7) THEN 'kg_embed,item_cf' ELSE 'item_cf,kg_embed' END WHEN k > 0 THEN 'kg_embed' ELSE 'item_cf' END AS sources, CASE WHEN k > 0 AND c > 0 THEN 2 ELSE 1 END AS n FROM j),
fused AS (SELECT uid, mid, floor(raw / max(raw) OVER (PARTITION BY uid) * 10000 + 0.5) / 10000 AS score, sources, row_number() OVER (PARTITION BY uid ORDER BY raw DESC, n DESC, mid DESC) AS rank FROM f WHERE raw > 0)"""


@query(f"WITH {SEEDS}, {SEEN}, {SIM}, {CF_SCORES}, {TOKENS}, {CONTENT}, {CF_BRANCH}, kgb AS (SELECT uid, mid, score AS k FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, mid) AS k FROM cosine s WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.uid = s.uid AND seen.mid = s.mid)) WHERE k <= 300), {FUSE} SELECT uid, mid, score, sources, rank FROM fused WHERE rank <= 10")
def r23_fused_ranking(c: Catalog) -> DataFrame:
    """The fusion formulas over the content and co-rating branches."""
    cf = item_cf_top(c, R.RECALL["item_cf"])
    kg = R.content_top(seeds(c), content_tokens(c), R.RECALL["kg_embed"], seen(c))
    return R.fused_top(R.fuse_branches(kg, cf), 10).withColumn("sources", F.array_join("sources", ","))


def main_ranking(c: Catalog, n: int) -> DataFrame:
    cf = item_cf_top(c, R.RECALL["item_cf"])
    return R.fused_top(R.fuse_branches(kg_embed(c, R.RECALL["kg_embed"]), cf), n, R.content_top(seeds(c), content_tokens(c), n, seen(c)))


MAIN = f"""{SEEDS}, {SEEN}, {SIM}, {CF_SCORES}, {CF_BRANCH}, {TOKENS}, {IDF}, {VECS}, {OVER}, {EMBED}, {KG}, kgb AS (SELECT uid, mid, score AS k FROM kg WHERE rank <= 300), {FUSE}, {CONTENT},
conall AS (SELECT s.uid, s.mid, s.score, row_number() OVER (PARTITION BY s.uid ORDER BY score DESC, mid) AS rank FROM cosine s WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.uid = s.uid AND seen.mid = s.mid)),
contop AS (SELECT uid, mid, floor(score / max(score) OVER (PARTITION BY uid) * 10000 + 0.5) / 10000 AS score, 'content' AS sources, rank FROM conall WHERE rank <= 10 AND uid NOT IN (SELECT uid FROM fused)),
main AS (SELECT * FROM fused WHERE rank <= 10 UNION ALL SELECT * FROM contop)"""


@query(f"WITH {MAIN} SELECT uid, mid, score, sources, rank FROM main")
def r22_main_ranker(c: Catalog) -> DataFrame:
    return main_ranking(c, 10).withColumn("sources", F.array_join("sources", ","))


@query(
    f"WITH {SEEDS}, {SEEN}, {SIM}, {CF_SCORES}, {TOKENS}, {IDF}, top AS (SELECT uid, mid FROM (WITH one AS (SELECT 1) SELECT * FROM (SELECT uid, mid, score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, mid) AS rank FROM (SELECT uid, mid, floor(raw / max(raw) OVER (PARTITION BY uid) * 10000 + 0.5) / 10000 AS score FROM (SELECT s.* FROM scores s WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.uid = s.uid AND seen.mid = s.mid))) WHERE score > 0) WHERE rank <= 3)), "
    "sh AS (SELECT t.uid, t.mid AS target, o.mid AS seed, g.rel, g.entity, o.weight100 * CASE g.rel WHEN 'director' THEN 100 WHEN 'actor' THEN 60 ELSE 40 END * i.idf6 AS value FROM top t JOIN tokens g ON g.mid = t.mid AND g.rel IN ('director', 'actor', 'genre') JOIN idfs i ON i.rel = g.rel AND i.entity = g.entity JOIN seeds o ON o.uid = t.uid JOIN tokens q ON q.mid = o.mid AND q.rel = g.rel AND q.entity = g.entity) "
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid, target ORDER BY value DESC, seed, rel, entity) AS k FROM sh) WHERE k <= 6"
)
def r27_explanations(c: Catalog) -> DataFrame:
    top = item_cf_top(c, 3)
    return R.explain(seeds(c), top, tokens(c))


TESTS = "el AS (SELECT uid FROM ratings GROUP BY uid HAVING count(*) >= 3 AND count(*) FILTER (h >= 7) >= 2), tests AS (SELECT uid, mid AS test_mid FROM (SELECT r.*, row_number() OVER (PARTITION BY uid ORDER BY rated_at DESC, mid) AS k FROM ratings r WHERE h >= 7 AND uid IN (SELECT uid FROM el)) WHERE k = 1)"
NEGATIVES = 99
NEG = """places AS (SELECT mid, row_number() OVER (ORDER BY md5(mid), mid) - 1 AS place FROM movies),
tries AS (SELECT uid, test_mid, unnest(generate_series(0, {most} * {n} - 1)) AS t FROM tests),
drawn AS (SELECT t.uid, p.mid, min(t) AS t FROM (SELECT *, CAST('0x' || substr(md5('{seed}:' || uid || ':' || t), 1, 8) AS BIGINT) % (SELECT count(*) FROM movies) AS place FROM tries) t JOIN places p USING (place) WHERE p.mid <> t.test_mid GROUP BY 1, 2),
free AS MATERIALIZED (SELECT uid, mid, t FROM drawn d WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.uid = d.uid AND r.mid = d.mid)),
enough AS (SELECT uid FROM free GROUP BY uid HAVING count(*) >= {n}),
short AS (SELECT t.uid, m.mid, md5('{seed}:' || t.uid || ':' || m.mid) AS d FROM tests t, movies m WHERE t.uid NOT IN (SELECT uid FROM enough) AND m.mid <> t.test_mid AND NOT EXISTS (SELECT 1 FROM ratings r WHERE r.uid = t.uid AND r.mid = m.mid)),
negs AS MATERIALIZED (SELECT uid, mid FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY t) AS k FROM free WHERE uid IN (SELECT uid FROM enough)) WHERE k <= {n}
  UNION ALL SELECT uid, mid FROM (SELECT *, count(*) OVER (PARTITION BY uid) AS n FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY d, mid) AS k FROM short) WHERE k <= {n}) WHERE n = {n})""".replace("{n}", str(NEGATIVES)).replace("{seed}", "42").replace("{most}", "32")


def tests(c: Catalog) -> DataFrame:
    return E.holdout(c.ratings, E.eligible(c.ratings))


@query(f"WITH {TESTS} SELECT * FROM tests")
def w2_holdout(c: Catalog) -> DataFrame:
    return tests(c)


@query(f"WITH {TESTS} SELECT uid, CASE WHEN CAST('0x' || substr(md5('42:' || uid), 1, 8) AS BIGINT) < CAST(0.2 * 4294967296 - 0.5 AS BIGINT) THEN 'validation' ELSE 'test' END AS part FROM tests")
def e2_user_split(c: Catalog) -> DataFrame:
    return E.split_users(tests(c))


@query(f"WITH {TESTS}, {NEG} SELECT * FROM negs")
def l10_negatives(c: Catalog) -> DataFrame:
    return E.negatives(tests(c), c.movie_keys, c.ratings, NEGATIVES, 42).select("uid", "mid")


CUT = "CAST(count(*) FILTER (rank <= {k}) AS DOUBLE) / count(*)"
METRICS = ", ".join(f"floor({CUT.format(k=k)} * 10000 + 0.5) / 10000 AS hr_{k}, floor({CUT.format(k=k)} / {k} * 10000 + 0.5) / 10000 AS precision_{k}, floor({CUT.format(k=k)} * 10000 + 0.5) / 10000 AS recall_{k}, floor(sum(CASE WHEN rank <= {k} THEN CAST(floor(1e9 / log2(rank + 1.0) + 0.5) AS BIGINT) ELSE 0 END) / (count(*) * 1e9) * 10000 + 0.5) / 10000 AS ndcg_{k}" for k in (5, 10, 20))


def visible_ratings(c: Catalog, t: DataFrame) -> DataFrame:
    """Ratings without the users' test items."""
    return c.ratings.join(t.select("uid", F.col("test_mid").alias("mid")), ["uid", "mid"], "left_anti")


def known_seeds(c: Catalog, visible: DataFrame) -> DataFrame:
    """The signals that recommenders start from when test items are hidden."""
    return S.capped_signals(S.positive_signals(visible, c.prefs), R.KG_SIGNALS).select("uid", "mid", "weight100")


def content_metrics(c: Catalog) -> DataFrame:
    c = with_ratings(c)
    t = settled(tests(c), "tests")
    sampled = settled(E.negatives(t, c.movie_keys, c.ratings, NEGATIVES, 42), "sampled")
    scores = R.content_scores(known_seeds(c, visible_ratings(c, t)), content_tokens(c), E.shortlists(t, sampled))
    return E.metrics(E.ranks(t, sampled, scores))


VISIBLE = SEEDS.replace("ratings", "visible")


@query(f"WITH {TESTS}, {NEG}, visible AS (SELECT r.* FROM ratings r WHERE NOT EXISTS (SELECT 1 FROM tests t WHERE t.uid = r.uid AND t.test_mid = r.mid)), {VISIBLE}, {TOKENS}, {CONTENT}, cand AS (SELECT uid, mid FROM negs UNION ALL SELECT uid, test_mid FROM tests WHERE uid IN (SELECT uid FROM negs)), ranked AS (SELECT c.uid, c.mid, row_number() OVER (PARTITION BY c.uid ORDER BY coalesce(CASE WHEN s.score > 0 THEN s.score END, 0) DESC, c.mid) AS rank FROM cand c LEFT JOIN cosine s ON s.uid = c.uid AND s.mid = c.mid), r AS (SELECT ranked.* FROM ranked JOIN tests t ON t.uid = ranked.uid AND t.test_mid = ranked.mid) SELECT count(*) AS n_users, {METRICS} FROM r")
def e4_content_metrics(c: Catalog) -> DataFrame:
    return content_metrics(c)


@query(f"WITH {SEEDS}, {SEEN}, {SIM}, {CF_SCORES}, t AS (SELECT uid, mid FROM (SELECT uid, mid, row_number() OVER (PARTITION BY uid ORDER BY score DESC, mid) AS k FROM (SELECT uid, mid, floor(raw / max(raw) OVER (PARTITION BY uid) * 10000 + 0.5) / 10000 AS score FROM (SELECT s.* FROM scores s WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.uid = s.uid AND seen.mid = s.mid))) WHERE score > 0) WHERE k <= 20) SELECT floor(CAST(count(DISTINCT mid) AS DOUBLE) / (SELECT count(*) FROM movies) * 10000 + 0.5) / 10000 AS coverage FROM t")
def e4_coverage(c: Catalog) -> DataFrame:
    return E.coverage(item_cf_top(c, 20), c.movie_keys)


def graph_facts(c: Catalog, ratings: DataFrame) -> DataFrame:
    """Triples of all relations of items, and of users' positive ratings."""
    m = c.movie_keys.withColumn("bucket", X.year_bucket(F.col("year")))
    relations = {
        "DIRECTED": (c.directed, "pid", "person", "mid", "movie"),
        "ACTED_IN": (c.acted.filter("ord <= 5"), "pid", "person", "mid", "movie"),
        "HAS_GENRE": (c.genre_edges, "mid", "movie", "genre", "genre"),
        "IN_REGION": (m, "mid", "movie", "region", "region"),
        "IN_LANGUAGE": (m, "mid", "movie", "language", "language"),
        "HAS_TYPE": (m, "mid", "movie", "content_type", "type"),
        "IN_PERIOD": (m, "mid", "movie", "bucket", "period"),
        "RATED_POSITIVE": (ratings.filter("h >= 7"), "uid", "user", "mid", "movie"),
    }
    return triples(relations, inverse=False)


#: Settings of training that a stored version is named by.
TRAINING = {"size": 64, "rounds": 5, "epochs": 5, "block": 8192}


def stored_vectors(c: Catalog, ratings: DataFrame, holdout: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vectors, held-out pairs) of the version for these ratings, trained at most once in the shared folder."""
    root = f"{shared_dir(c.spark)}/embedding-store"
    facts = settled(graph_facts(c, ratings), "facts")
    name = embedding_store.ensure(root, "expanded", facts, lambda t: train(t, **TRAINING)[0], holdout, TRAINING)
    return embedding_store.load(c.spark, root, name)


def trained_parts(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mid, vec) of items and (uid, vec) of where each user's relation to items leads, in whole numbers."""
    items = stored.filter(F.startswith("name", F.lit("movie_"))).select(F.substring("name", 7, 100).alias("mid"), "vec")
    rated = stored.filter("name = 'RATED_POSITIVE'").select(F.lit("user").alias("kind"), F.col("vec").alias("r"))
    users = stored.filter(F.startswith("name", F.lit("user_"))).select(F.lit("user").alias("kind"), F.substring("name", 6, 100).cast("long").alias("uid"), "vec")
    moved = users.join(F.broadcast(rated), "kind").select("uid", F.zip_with("vec", "r", lambda u, r: u + r).alias("vec"))  # one row
    return R.whole_vectors(items), R.whole_vectors(moved)


@query()
def r14_transe(c: Catalog) -> DataFrame:
    """Vectors of all entities and relations, trained until the validation tenth gets no better."""
    return stored_vectors(c, c.ratings)[0].select("name", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query()
def r18_trained_embed(c: Catalog) -> DataFrame:
    """The embedding ranking on trained vectors, with the users' own relation to items."""
    items, users = trained_parts(stored_vectors(c, c.ratings)[0])
    return kg_embed(c, 10, users, items, R.ABLATIONS["kg_embed"]["full"]).select("uid", "mid", "score", "rank")


@query(f"WITH {TOKENS}, deg AS (SELECT entity, count(*) AS d FROM tokens WHERE rel = 'genre' GROUP BY 1) SELECT mid, entity FROM (SELECT t.mid, t.entity, row_number() OVER (PARTITION BY t.mid ORDER BY d > 25, d, t.entity) AS k FROM tokens t JOIN deg USING (entity) WHERE rel = 'genre') WHERE k <= 1")
def w7_rare_genres(c: Catalog) -> DataFrame:
    return R.rare_entities(tokens(c), "genre", 25, 1)


@query(f"WITH {SEEDS}, {SEEN}, {EVIDENCE}, {PATH_TOP}, w AS (SELECT s.uid, e.mid, e.rel, e.seed, s.weight100 * e.worth AS worth FROM seeds s JOIN evidence e ON e.seed = s.mid JOIN (SELECT uid, mid FROM pathtop WHERE rank <= 20) t ON t.uid = s.uid AND t.mid = e.mid WHERE e.worth > 0), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid, mid, rel ORDER BY worth DESC, seed) AS j FROM w) WHERE j = 1) SELECT uid, mid, rel, seed, CAST(worth AS BIGINT) AS worth, k FROM (SELECT *, row_number() OVER (PARTITION BY uid, mid ORDER BY worth DESC, rel) AS k FROM b) WHERE k <= 3")
def a37_path_reasons(c: Catalog) -> DataFrame:
    """The reasons of each user's 20 best candidates by paths."""
    own, known, index = path_inputs(c, R.KG_SIGNALS)
    return R.best_path_reasons(own, *R.film_evidence(tokens(c), first_billed(c), index), 20, known)


CF_TOP = "ranked AS (SELECT uid, mid, score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, mid) AS rank FROM (SELECT uid, mid, floor(raw / max(raw) OVER (PARTITION BY uid) * 10000 + 0.5) / 10000 AS score FROM (SELECT s.* FROM scores s WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.uid = s.uid AND seen.mid = s.mid))) WHERE score > 0)"


@query(f"WITH {SEEDS}, {SEEN}, {SIM}, {CF_SCORES}, {CF_TOP} SELECT r.uid, r.rank, r.mid, m.name, m.year, m.score AS rating, r.score FROM ranked r JOIN movies m ON m.mid = r.mid WHERE rank <= 5")
def j22_enriched_recommendations(c: Catalog) -> DataFrame:
    details = c.movies.select("mid", "name", "year", F.col("score").alias("rating"))
    return item_cf_top(c, 5).join(details, "mid").select("uid", "rank", "mid", "name", "year", "rating", "score")


@query(f"WITH {SEEDS}, {SEEN}, {SIM}, {CF_SCORES}, {CF_TOP}, eff AS (SELECT u.uid, count(DISTINCT s.mid) < 3 AS cold FROM users u LEFT JOIN seen s ON s.uid = u.uid GROUP BY 1), own AS (SELECT r.uid, r.mid, r.rank FROM ranked r JOIN eff e ON e.uid = r.uid WHERE NOT e.cold AND rank <= 5), pop AS (SELECT mid, row_number() OVER (ORDER BY v DESC, mid) AS rank FROM (SELECT mid, floor(((50000 * 7 + coalesce(votes, 0) * score) / (50000 + coalesce(votes, 0))) * 1e6 + 0.5) / 1e6 AS v FROM movies WHERE score IS NOT NULL) ORDER BY rank LIMIT 5) SELECT uid, mid, rank, 'personal' AS how FROM own UNION ALL SELECT e.uid, p.mid, p.rank, 'popular' FROM eff e JOIN pop p ON true WHERE e.uid NOT IN (SELECT uid FROM own)")
def pf22_cold_routing(c: Catalog) -> DataFrame:
    v, s = F.coalesce("votes", F.lit(0)), F.col("score")
    best = c.movies.filter("score IS NOT NULL").select("mid", X.rounded((50000 * 7 + v * s) / (50000 + v), 6).alias("v")).orderBy(F.desc("v"), "mid").limit(5)
    popular = best.select("mid", F.row_number().over(Window.orderBy(F.desc("v"), "mid")).alias("rank"))  # five rows
    users = S.activity(c.users, c.ratings, c.prefs).select("uid", "cold")
    return R.cold_routing(users, item_cf_top(c, 5), popular, 5)


@query(f"WITH {TOKENS} SELECT mid, rel, entity FROM (SELECT *, row_number() OVER (PARTITION BY mid, rel ORDER BY entity) AS k FROM tokens WHERE mid IN (SELECT mid FROM movies WHERE year = 1985)) WHERE k <= CASE rel WHEN 'director' THEN 2 WHEN 'actor' THEN 3 WHEN 'genre' THEN 3 ELSE 0 END")
def r28_fallback_reasons(c: Catalog) -> DataFrame:
    return R.fallback_reasons(c.movie_keys.filter("year = 1985"), tokens(c))


ALLOWED_HOPS = HOPS.replace("AND x.entity = y.entity AND x.mid <> y.mid", "AND x.entity = y.entity AND x.mid <> y.mid AND y.mid IN (SELECT mid FROM movies WHERE year > 2000)")


@query(f"WITH {ALLOWED_HOPS} SELECT * FROM hops")
def r13_shortlist_evidence(c: Catalog) -> DataFrame:
    return R.one_hop(tokens(c), allowed=c.movie_keys.filter("year > 2000").select("mid"))


#: The draws of negatives.
SEED_DRAWS = (42, 52, 62, 72, 82)


def part_users(t: DataFrame, part: str) -> DataFrame:
    """All users of a part of the split."""
    return t.join(E.split_users(t).filter(F.col("part") == part).select("uid"), "uid", "left_semi")


#: A user of a draw is a user of its own: the id times this, and the number of the draw.
DRAWS = 100
PATHS, EMBEDS = tuple(R.PATH_WEIGHTS), tuple(R.EMBED_WEIGHTS)


def path_score(weights: dict[str, int], penalties: bool = True) -> Column:
    """The path score from R.shortlist_parts."""
    return sum((F.coalesce(F.col(f"{'p' if penalties else 'q'}_{rel}"), F.lit(0)) * w for rel, w in weights.items()), F.lit(0)).cast("double")


def embed_score(weights: dict[str, float]) -> Column:
    """The embedding score from components that are scaled to each user's candidates."""
    return X.rounded(sum((F.col(f"n_{name}") * w for name, w in weights.items()), F.lit(0.0)))


def fused_score(kg: Column, kg_weight: float = 0.7, cf_weight: float = 0.3, bonus: float = 0.02, consensus: float = 0.0) -> Column:
    """The main ranking's score of a candidate from the embedding score and the column ``cf``."""
    c = F.col("cf")
    share = F.when(kg > 0, c * (cf_weight / kg_weight)).otherwise(c * cf_weight)
    return X.rounded(F.when((kg > 0) & (c > 0), kg + share + F.least(kg, c) * consensus + bonus).when(kg > 0, kg).otherwise(share), 6)


def suite_candidates(c: Catalog, t: DataFrame, negatives: int, draws: tuple[int, ...], trained: bool = True) -> tuple[DataFrame, DataFrame]:
    """(candidates with every component, tests) of the test users (uid, test_mid), whose ids are those of DRAWS.

    What the algorithms add up is made once for each candidate; configurations are only
    other sums of it. All test items are hidden, those of other users, too, and from
    the training of the vectors (``trained``; else the given ones) as well.
    """
    hidden = settled(tests(c), "all-tests")
    t = settled(t, "tests")
    every = lambda df: df.withColumn("uid", F.explode(F.array(*(F.col("uid") * DRAWS + d for d in range(len(draws))))))
    sampled = None
    for d, seed in enumerate(draws):
        one = E.negatives(t, c.movie_keys, c.ratings, negatives, seed).select((F.col("uid") * DRAWS + d).alias("uid"), "mid")
        sampled = one if sampled is None else sampled.union(one)
    sampled, tests_ = settled(sampled, "sampled"), settled(every(t), "tests")
    visible = settled(visible_ratings(c, hidden), "visible")
    s = settled(every(known_seeds(c, visible).join(t.select("uid"), "uid", "left_semi")), "seeds")
    toks, pairs = settled(tokens(c), "tokens"), settled(E.shortlists(tests_, sampled), "shortlists")
    person = F.expr(f"uid div {DRAWS}")
    items, users = vectors(c), None
    if trained:
        items, users = trained_parts(stored_vectors(c, visible, hidden.select("uid", F.col("test_mid").alias("mid")))[0])
        users = every(users.join(t.select("uid"), "uid", "left_semi"))
    cf = R.item_cf(s, R.item_similarity(visible)).join(pairs, ["uid", "mid"], "left_semi").select("uid", "mid", "raw")
    content = R.content_scores(s, content_tokens(c), pairs).select("uid", "mid", F.col("score").alias("content"))
    embedded = R.embedding_components(pairs, s, items, users)
    overlap = R.overlap_scores(R.overlap_taste(s, toks), toks, pairs)
    paths = R.shortlist_parts(s, toks, pairs, first_billed(c), S.weight_index(visible, c.prefs), person)
    rows = pairs
    for name, part in (("cf", cf), ("content", content), ("embedded", embedded), ("overlap", overlap), ("paths", paths)):
        rows = rows.join(settled(part, name), ["uid", "mid"], "left")
    rows = rows.na.fill(0, ["raw", "content", *EMBEDS])
    of_user = Window.partitionBy("uid")
    scaled = {name: R.min_max(name) for name in EMBEDS}
    best = F.max("raw").over(of_user)
    rows = rows.select("*", F.when(best > 0, X.rounded(F.col("raw") / best)).otherwise(0.0).alias("cf"), *(column.alias(f"n_{name}") for name, column in scaled.items()))
    return settled(rows, "candidates"), tests_


def suite_metrics(candidates: DataFrame, tests_: DataFrame, draws: tuple[int, ...], scores: dict[str, Column]) -> DataFrame:
    """(config, seed, metrics) of every configuration and draw, in one pass over the candidates."""
    ranked = E.config_ranks(candidates, tests_, scores).withColumn("seed", F.get(F.array(*map(F.lit, draws)), (F.col("uid") % DRAWS).cast("int")))
    return E.metrics(ranked, ["config", "seed"])


#: The deliverable settings of the five algorithms.
FULL_EMBED = R.ABLATIONS["kg_embed"]["full"]


def suite_scores() -> dict[str, Column]:
    return {"content": F.col("content"), "item_cf": F.col("cf"), "kg_path": path_score(R.PATH_WEIGHTS), "kg_embed": embed_score(R.EMBED_WEIGHTS), "cfkg": fused_score(embed_score(FULL_EMBED))}


@query()
def e7_suite(c: Catalog) -> DataFrame:
    """The five algorithms on all test users with five draws of 99 negatives: mean and deviation of each metric."""
    c = with_ratings(c)
    found = suite_candidates(c, part_users(tests(c), "test"), NEGATIVES, SEED_DRAWS)
    return E.summary(suite_metrics(*found, SEED_DRAWS, suite_scores()).withColumnRenamed("config", "algorithm"), ["algorithm"])


@query()
def e7_suite_499(c: Catalog) -> DataFrame:
    """The five algorithms on all test users with one draw of 499 negatives; users with fewer unrated films are left out."""
    c = with_ratings(c)
    found = suite_candidates(c, part_users(tests(c), "test"), 499, SEED_DRAWS[:1])
    return suite_metrics(*found, SEED_DRAWS[:1], suite_scores()).withColumnRenamed("config", "algorithm")


def grids() -> dict[str, Column]:
    """The score of every configuration that tuning tries, of three algorithms."""
    paths = {f"kg_path:{json.dumps({k: w[k] for k in ('shared_audience', 'director', 'actor')})}": path_score(w) for w in R.path_grid()}
    embeds = {f"kg_embed:{json.dumps(w)}": embed_score(w) for w in R.embed_grid()}
    return paths | embeds | {f"cfkg:{json.dumps(R.FUSED)}": fused_score(embed_score(FULL_EMBED), **R.FUSED)}


@query()
def e6_tuned(c: Catalog) -> DataFrame:
    """(algorithm, config): the best configuration of each algorithm's grid on all validation users, by NDCG and hit rate, means of all draws."""
    c = with_ratings(c)
    found = suite_candidates(c, part_users(tests(c), "validation"), NEGATIVES, SEED_DRAWS)
    rows = suite_metrics(*found, SEED_DRAWS, grids())
    means = rows.groupBy("config").agg(*(F.avg(m).alias(m) for m in ("ndcg_10", "hr_10", "ndcg_5")))
    return E.best_config(means.withColumn("algorithm", F.split("config", ":")[0]), ["algorithm"])


@query()
def e7_ablation(c: Catalog) -> DataFrame:
    """Each ablation of the graph algorithms on all test users, with all draws."""
    scores = {f"kg_path:{label}": path_score(w, penalties) for label, (w, penalties) in R.ABLATIONS["kg_path"].items()}
    scores |= {f"kg_embed:{label}": embed_score(w) for label, w in R.ABLATIONS["kg_embed"].items()}
    scores |= {f"cfkg:{label}": fused_score(embed_score(FULL_EMBED), **w) for label, w in R.ABLATIONS["cfkg"].items()}
    c = with_ratings(c)
    found = suite_candidates(c, part_users(tests(c), "test"), NEGATIVES, SEED_DRAWS)
    return E.summary(suite_metrics(*found, SEED_DRAWS, scores).withColumnRenamed("config", "algorithm"), ["algorithm"]).select("algorithm", "seeds", "hr_10_mean", "hr_10_std", "ndcg_10_mean", "ndcg_10_std")


RANKED = """cand AS MATERIALIZED (SELECT uid, mid FROM negs UNION ALL SELECT uid, test_mid FROM tests WHERE uid IN (SELECT uid FROM negs)),
recalled AS (SELECT cand.uid, cand.mid FROM cand),
overlap_ AS MATERIALIZED (SELECT l.uid, k.mid, CAST(sum(l.t) AS BIGINT) AS overlap FROM cand JOIN liking l ON l.uid = cand.uid JOIN tokens k ON k.mid = cand.mid AND l.rel = k.rel AND l.entity = k.entity GROUP BY 1, 2)"""
LIKING = OVER[: OVER.index("recalled AS")].rstrip().rstrip(",")


@query(
    f"WITH {TESTS}, {NEG}, visible AS (SELECT r.* FROM ratings r WHERE NOT EXISTS (SELECT 1 FROM tests t WHERE t.uid = r.uid AND t.test_mid = r.mid)), {VISIBLE}, {TOKENS}, {IDF}, {VECS}, {LIKING}, {RANKED}, {EMBED}, "
    f"gathered AS (SELECT r.uid, r.mid, coalesce(centroid6, 0) AS centroid6, coalesce(most_seed6, 0) AS most_seed6, coalesce(overlap, 0) AS overlap FROM cand r LEFT JOIN parts p ON p.uid = r.uid AND p.mid = r.mid LEFT JOIN overlap_ o ON o.uid = r.uid AND o.mid = r.mid), "
    f"sc AS (SELECT uid, mid, floor(({_scaled('centroid6')} * 0.4 + {_scaled('most_seed6')} * 0.2 + {_scaled('overlap')} * 0.4) * 10000.0 + 0.5) / 10000.0 AS fused, floor({_scaled('centroid6')} * 10000.0 + 0.5) / 10000.0 AS centroid FROM gathered) "
    "SELECT x.uid, config, rank FROM (SELECT uid, mid, 'fused' AS config, row_number() OVER (PARTITION BY uid ORDER BY fused DESC, mid) AS rank FROM sc UNION ALL SELECT uid, mid, 'centroid', row_number() OVER (PARTITION BY uid ORDER BY centroid DESC, mid) FROM sc) x JOIN tests t ON t.uid = x.uid AND t.test_mid = x.mid"
)
def e6_config_ranks(c: Catalog) -> DataFrame:
    """Every user's test item ranked under two configurations of the embedding ranking, on the given vectors."""
    c = with_ratings(c)
    t = settled(tests(c), "tests")
    sampled = settled(E.negatives(t, c.movie_keys, c.ratings, NEGATIVES, 42).select("uid", "mid"), "sampled")
    s, toks, pairs = settled(known_seeds(c, visible_ratings(c, t)), "seeds"), tokens(c), settled(E.shortlists(t, sampled), "shortlists")
    rows = pairs.join(R.embedding_components(pairs, s, vectors(c)), ["uid", "mid"], "left").join(R.overlap_scores(R.overlap_taste(s, toks), toks, pairs), ["uid", "mid"], "left").na.fill(0, list(EMBEDS))
    scaled = settled(rows.select("uid", "mid", *(R.min_max(name).alias(f"n_{name}") for name in EMBEDS)), "scaled")
    return E.config_ranks(scaled, t, {"fused": embed_score(R.EMBED_WEIGHTS), "centroid": embed_score({"centroid6": 1.0})})


@query(f"WITH {SEEDS}, {SEEN}, {TOKENS}, {CONTENT}, top AS (SELECT uid, mid FROM (SELECT uid, mid, row_number() OVER (PARTITION BY uid ORDER BY score DESC, mid) AS k FROM cosine s WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.uid = s.uid AND seen.mid = s.mid)) WHERE k <= 10), bag AS (SELECT mid, list(token) AS b FROM units GROUP BY 1) SELECT x.uid, floor(avg(1 - CAST(len(list_intersect(bx.b, by_.b)) AS DOUBLE) / len(list_distinct(list_concat(bx.b, by_.b)))) * 10000.0 + 0.5) / 10000.0 AS diversity FROM top x JOIN top y ON y.uid = x.uid AND x.mid < y.mid JOIN bag bx ON bx.mid = x.mid JOIN bag by_ ON by_.mid = y.mid GROUP BY 1")
def e4_diversity(c: Catalog) -> DataFrame:
    """One minus the mean Jaccard of the tokens of each user's ten items by content."""
    top = R.content_top(seeds(c), content_tokens(c), 10, seen(c)).select("uid", "mid")
    return E.diversity(top, content_tokens(c))


ONLINE_HOPS = HOPS.replace("'director' THEN 30 WHEN 'actor' THEN 50 WHEN 'genre' THEN 50 WHEN 'region' THEN 15 WHEN 'language' THEN 15 WHEN 'content_type' THEN 5 ELSE 10 END", "'director' THEN 12 WHEN 'actor' THEN 16 WHEN 'genre' THEN 12 ELSE 0 END")
ONLINE_AUDIENCE = AUDIENCE.replace("k <= 200", "k <= 60").replace("k <= 120", "k <= 40")
ONLINE_EVIDENCE = f"""{ONLINE_HOPS}, {ONLINE_AUDIENCE}, evidence AS (
  SELECT seed, rel, mid, hits, CAST(floor((CASE WHEN rel = 'genre' THEN least(hits * 100, 300) / 3 ELSE hits * 100 END) * CASE rel WHEN 'director' THEN 20 ELSE 10 END * penalty6 / 10000) AS BIGINT) AS worth FROM hops
  UNION ALL SELECT seed, 'shared_audience', mid, hits, CAST(floor(strength * 80 / 1000000) AS BIGINT) FROM audience)"""


@query(f"WITH {SEEDS.replace('THEN 30', 'THEN 8').replace('THEN 10', 'THEN 4')}, {SEEN}, {ONLINE_EVIDENCE}, {PATH_TOP} SELECT uid, mid, score, rank FROM pathtop WHERE rank <= 10")
def r29_online_paths(c: Catalog) -> DataFrame:
    """The path ranking with the smaller settings of single requests."""
    own, known, index = path_inputs(c, R.ONLINE_SIGNALS["kg_path"])
    found = R.film_evidence(tokens(c), None, index, R.ONLINE_PATH_LIMITS, R.ONLINE_PATH_WEIGHTS, R.ONLINE_BRIDGES)
    return R.best_paths(own, *found, 10, known)


TEXTS = " ".join(f"WHEN '{rel}' THEN replace('{form}', '%s', replace(replace(entity, '/', '-'), ' ', '-'))" for rel, (form, _) in X.REASONS.items())


@query(f"WITH {TOKENS} SELECT DISTINCT rel, entity, CASE rel {TEXTS} END AS sentence FROM tokens")
def x37_reason_texts(c: Catalog) -> DataFrame:
    """The sentence of every entity that can be a reason, its name as a token of the graph."""
    pairs = tokens(c).select("rel", "entity").distinct()
    return pairs.select("rel", "entity", X.reason(F.col("rel"), X.graph_token(F.col("entity"))).alias("sentence"))


@query(f"WITH {SEEDS}, {SEEN}, {AUDIENCE} SELECT DISTINCT s.uid, a.mid, CASE WHEN max(a.hits) >= 2 THEN '{X.AUDIENCE_REASONS[0]}' ELSE '{X.AUDIENCE_REASONS[1]}' END AS sentence FROM seeds s JOIN audience a ON a.seed = s.mid WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.uid = s.uid AND seen.mid = a.mid) GROUP BY 1, 2")
def x37_audience_texts(c: Catalog) -> DataFrame:
    """The sentences of shared audiences."""
    own, known, index = path_inputs(c, R.KG_SIGNALS)
    index = settled(index, "likes")
    films = R.film_numbers(index)
    hits = R.audience_hits(own, R.shared_audience(R.as_numbers(index, films), numbers=True), known, films)
    return hits.select("uid", "mid", X.reason(F.lit("shared_audience"), F.lit(None).cast("string"), F.col("hits")).alias("sentence"))
