"""Changes to tables, queues, cohorts and landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as X
from graphloom.operators import cohort as K
from graphloom.operators import upserts as U
from graphloom.operators.profiling import incomplete_films, incomplete_persons
from graphloom.plans.base_queries import LANDED, landed_films, landed_persons
from graphloom.plans.registry import query
from graphloom.sources import readers, writers
from graphloom.sources.catalog import Catalog
from graphloom.sources.scratch import fresh_path
from graphloom.streaming import expiry


@query("SELECT uid, mid, h FROM ratings WHERE NOT EXISTS (SELECT 1 FROM prefs p WHERE p.uid = ratings.uid AND p.mid = ratings.mid AND p.pref_type = 'like') UNION ALL SELECT uid, mid, 10 FROM prefs WHERE pref_type = 'like'")
def sk10_upsert_ratings(c: Catalog) -> DataFrame:
    new = c.prefs.filter("pref_type = 'like'").select("uid", "mid", F.lit(10).alias("h"), F.col("created_at").alias("rated_at"))
    return U.upsert(c.ratings, new, ["uid", "mid"], "rated_at").select("uid", "mid", "h")


@query("SELECT uid, mid, pref_type FROM prefs WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.uid = prefs.uid AND r.mid = prefs.mid)")
def sk11_delete_by_key(c: Catalog) -> DataFrame:
    return U.delete(c.prefs, c.ratings.select("uid", "mid")).select("uid", "mid", "pref_type")


@query("WITH inc AS (SELECT uid, mid, pref_type FROM prefs WHERE uid % 3 = 0 AND pref_type = 'like') SELECT uid, mid, pref_type FROM prefs WHERE uid NOT IN (SELECT uid FROM inc) UNION ALL SELECT * FROM inc")
def sk12_full_sync(c: Catalog) -> DataFrame:
    incoming = c.prefs.filter("uid % 3 = 0 AND pref_type = 'like'")
    return U.sync(c.prefs, incoming, "uid", ["uid", "mid"]).select("uid", "mid", "pref_type")


@query("SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS mid FROM lineitem WHERE CAST(l_partkey AS VARCHAR) NOT IN (SELECT mid FROM movies WHERE year < 2000)")
def sk13_insert_ignore(c: Catalog) -> DataFrame:
    new = c.table("lineitem").select(F.col("l_partkey").cast("string").alias("mid"))
    return U.insert_missing(c.movie_keys.filter("year < 2000"), new, "mid")


@query("WITH o AS (SELECT mid FROM movies WHERE year < 2005), n AS (SELECT mid FROM movies WHERE year > 1990) SELECT coalesce(o.mid, n.mid) AS mid, CASE WHEN o.mid IS NULL THEN 'inserted' WHEN n.mid IS NULL THEN 'kept' ELSE 'updated' END AS action FROM o FULL JOIN n ON n.mid = o.mid")
def sk14_save_actions(c: Catalog) -> DataFrame:
    return U.save_actions(c.movie_keys.filter("year < 2005"), c.movie_keys.filter("year > 1990"), "mid", True)


@query("WITH p AS (SELECT CAST(l_suppkey AS VARCHAR) AS pid, arg_max('S' || l_linenumber, l_linenumber) AS name FROM lineitem GROUP BY 1) SELECT * FROM p WHERE pid NOT IN (SELECT pid FROM persons WHERE CAST(pid AS BIGINT) % 2 = 0)")
def sk15_person_ids(c: Catalog) -> DataFrame:
    item = F.concat_ws(":", F.concat(F.lit("S"), "l_linenumber"), "l_suppkey")
    ids = c.table("lineitem").select(X.digit_id(item).alias("pid"), F.concat(F.lit("S"), "l_linenumber").alias("name"), "l_linenumber").filter("pid IS NOT NULL")
    last = ids.groupBy("pid").agg(F.max_by("name", "l_linenumber").alias("name"))
    return last.join(c.persons.filter("cast(pid AS bigint) % 2 = 0").select("pid"), "pid", "left_anti")


TASKS = "tasks AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS status, o_orderdate AS locked_at FROM orders)"


def tasks(c: Catalog) -> DataFrame:
    """Orders as a queue: open 0, claimed 1, done 2."""
    status = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return c.table("orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("locked_at"))


@query(f"WITH {TASKS} SELECT id, 1 AS status FROM tasks WHERE status = 0 ORDER BY id DESC LIMIT 100")
def sk17_bulk_claim(c: Catalog) -> DataFrame:
    return U.claim(tasks(c), 100).select("id", "status")


@query(f"WITH {TASKS} SELECT id, CASE WHEN status = 1 AND locked_at < TIMESTAMP '1998-01-01 00:30:00' - INTERVAL 30 MINUTE THEN 0 ELSE status END AS status FROM tasks")
def sk18_stale_locks(c: Catalog) -> DataFrame:
    return U.release_stale(tasks(c), F.lit("1998-01-01 00:30:00").cast("timestamp")).select("id", "status")


@query(f"WITH {TASKS} SELECT id, CASE WHEN status = 1 AND id % 3 = 0 THEN 3 WHEN status = 1 AND id % 2 = 0 THEN 2 ELSE status END AS status FROM tasks")
def sk19_transitions(c: Catalog) -> DataFrame:
    t = tasks(c)
    return U.finish(t, t.filter("id % 2 = 0"), t.filter("id % 3 = 0")).select("id", "status")


@query(f"WITH {TASKS} SELECT id, CASE WHEN status = 1 THEN 0 ELSE status END AS status FROM tasks")
def sk21_reset_locks(c: Catalog) -> DataFrame:
    return tasks(c).select("id", F.when(F.col("status") == 1, 0).otherwise(F.col("status")).alias("status"))


@query(f"WITH {LANDED} SELECT mid, name FROM landed WHERE NOT coalesce(score IS NOT NULL AND votes >= 20 AND (cover = '' OR storyline IS NULL), false)")
def sk20_drop_incomplete(c: Catalog) -> DataFrame:
    films = landed_films(c)
    return U.delete(films, incomplete_films(films, 20).select("mid")).select("mid", "name")


@query(f"WITH {TASKS}, {LANDED} SELECT id, CASE WHEN id IN (SELECT CAST(mid AS BIGINT) FROM landed WHERE score IS NOT NULL AND votes >= 20 AND (cover = '' OR storyline IS NULL)) THEN 0 ELSE status END AS status FROM tasks")
def sk20_reset_queue(c: Catalog) -> DataFrame:
    """The queue with the tasks of incomplete films open again, as before these are deleted."""
    again = incomplete_films(landed_films(c), 20).select(F.col("mid").cast("long").alias("id"))
    return U.reopen(tasks(c), again).select("id", "status")


@query("SELECT pid, name FROM persons WHERE NOT (CAST(pid AS BIGINT) % 3 = 0 AND starts_with(profession, 'A') AND contains(birthplace, 'I'))")
def sk20_drop_persons(c: Catalog) -> DataFrame:
    people = landed_persons(c)
    return U.delete(people, incomplete_persons(people).select("pid")).select("pid", "name")


@query(f"WITH {TASKS}, c AS (SELECT max(id) AS id FROM tasks WHERE status = 0 AND id % 7 = 3) SELECT t.id, CASE WHEN t.id = c.id THEN 1 ELSE t.status END AS status, t.id = c.id AS claimed FROM tasks t, c")
def sk16_conditional_claim(c: Catalog) -> DataFrame:
    """One task claimed on condition that it is still open."""
    t = tasks(c)
    wanted = t.filter("status = 0 AND id % 7 = 3").agg(F.max("id").alias("id")).scalar()
    return U.claim_one(t, wanted).select("id", "status", "claimed")


@query("SELECT DISTINCT mid, genre AS name, 'genres' AS rel FROM genre_edges")
def sk6_lookup_edges(c: Catalog) -> DataFrame:
    from graphloom.operators.graph import lookup_edges

    return lookup_edges(c.movies.select("mid", "genres"), "mid", "genres")


@query("SELECT count(*) AS seeds, (SELECT count(DISTINCT uid) FROM ratings) AS discovered, (SELECT count(*) FROM (SELECT uid FROM ratings GROUP BY uid HAVING count(*) >= 20)) AS screened, (SELECT count(*) FROM (SELECT uid FROM ratings GROUP BY uid HAVING count(*) >= 40)) AS selected, (SELECT count(DISTINCT uid) FROM prefs WHERE pref_type = 'like') AS imported FROM users WHERE is_mock")
def sk28_growth_summary(c: Catalog) -> DataFrame:
    n = c.ratings.groupBy("uid").agg(F.count("*").alias("n"))
    return K.growth_summary(c.users.filter("is_mock"), n, n.filter("n >= 20"), n.filter("n >= 40"), c.prefs.filter("pref_type = 'like'").select("uid").distinct())


@query("SELECT r.uid, count(*) AS n FROM ratings r WHERE r.uid NOT IN (SELECT uid FROM users WHERE starts_with(username, 'building_')) GROUP BY 1")
def sk22_delete_by_prefix(c: Catalog) -> DataFrame:
    gone = c.users.filter(F.startswith("username", F.lit("building_"))).select("uid")
    return U.delete(c.ratings, gone).groupBy("uid").agg(F.count("*").alias("n"))


@query("SELECT uid, CASE WHEN is_mock THEN false ELSE is_mock END AS is_mock, is_mock AS changed FROM users")
def sk23_conditional_update(c: Catalog) -> DataFrame:
    return c.users.select("uid", F.when(F.col("is_mock"), False).otherwise(F.col("is_mock")).alias("is_mock"), F.col("is_mock").alias("changed"))


@query("SELECT user_id, max(ts) AS last_seen, count(*) AS n FROM (SELECT * FROM events e WHERE event_type <> 'error' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = e.user_id AND c_acctbal > 0)) GROUP BY 1", prelude=False)
def j23_valid_sessions(c: Catalog) -> DataFrame:
    valid = c.table("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return c.table("events").filter("event_type <> 'error'").join(valid, "user_id").groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count("*").alias("n"))


COHORT = "totals AS (SELECT u.uid, (SELECT count(*) FROM ratings r WHERE r.uid = u.uid) AS c, (SELECT count(*) FROM prefs p WHERE p.uid = u.uid) AS w FROM users u), classed AS (SELECT uid, c, w, CASE WHEN c < 20 AND c + w < 80 THEN 'too_light' WHEN (c BETWEEN 20 AND 300 AND w <= 200) OR (c < 20 AND w BETWEEN 5 AND 200) THEN 'light_native' WHEN c <= 800 AND w <= 400 THEN 'medium_native' ELSE 'heavy_capped' END AS category FROM totals)"


def totals(c: Catalog) -> DataFrame:
    n = lambda df, name: df.groupBy("uid").agg(F.count("*").alias(name))
    return c.users.select("uid").join(n(c.ratings, "c"), "uid", "left").join(n(c.prefs, "w"), "uid", "left").na.fill(0)


@query(f"WITH {COHORT} SELECT uid, c, w, category, CASE WHEN category <> 'too_light' THEN nullif(least(c, 300), 0) END AS max_collect, CASE WHEN category <> 'too_light' THEN nullif(least(w, 200), 0) END AS max_wish FROM classed")
def x28_cohort_classes(c: Catalog) -> DataFrame:
    return K.classify(totals(c), F.col("c"), F.col("w"))


@query(f"WITH {COHORT} SELECT uid, category, CASE WHEN category <> 'too_light' THEN nullif(least(least(c, 300), 25), 0) END AS cap FROM classed WHERE category IN ('light_native', 'medium_native') ORDER BY c DESC, w DESC, uid LIMIT 100")
def pf13_selected_candidates(c: Catalog) -> DataFrame:
    chosen = K.classify(totals(c), F.col("c"), F.col("w")).filter(F.col("category").isin("light_native", "medium_native"))
    return chosen.orderBy(F.desc("c"), F.desc("w"), "uid").limit(100).select("uid", "category", K.tighter(F.col("max_collect"), 25).alias("cap"))


LISTED = "listed AS (SELECT 'u' || uid AS slug, mid, 'collect' AS action, h * 5 AS rating10 FROM ratings UNION ALL SELECT 'u' || uid, mid, 'wish', NULL FROM prefs WHERE pref_type = 'want_to_watch')"


def listed(c: Catalog) -> DataFrame:
    """(slug, mid, action, rating10) of users' lists."""
    slug = F.concat(F.lit("u"), "uid").alias("slug")
    seen = c.ratings.select(slug, "mid", F.lit("collect").alias("action"), (F.col("h") * 5).alias("rating10"))
    return seen.union(c.prefs.filter("pref_type = 'want_to_watch'").select(slug, "mid", F.lit("wish"), F.lit(None).cast("int")))


ROWS = "rows_ AS (SELECT slug, mid, 'rating' AS \"table\", 'rating' AS kind, rating10 FROM listed WHERE action = 'collect' UNION ALL SELECT slug, mid, 'pref', 'like', NULL FROM listed WHERE action = 'collect' AND rating10 >= 45 UNION ALL SELECT slug, mid, 'pref', 'want_to_watch', NULL FROM listed WHERE action = 'wish')"


@query(f"WITH {LISTED}, {ROWS} SELECT * FROM rows_")
def x27_import_preview(c: Catalog) -> DataFrame:
    return K.import_rows(listed(c))


@query(f"WITH {LISTED}, {ROWS}, known AS MATERIALIZED (SELECT * FROM rows_ WHERE mid IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 10)) SELECT * FROM known WHERE kind <> 'want_to_watch' UNION ALL SELECT * FROM known k WHERE kind = 'want_to_watch' AND NOT EXISTS (SELECT 1 FROM known q WHERE q.kind = 'rating' AND q.slug = k.slug AND q.mid = k.mid)")
def pf12_known_items(c: Catalog) -> DataFrame:
    return K.known_only(K.import_rows(listed(c)), c.movie_keys.filter("year > 1980"))


@query(f"WITH {LISTED} SELECT l.slug, l.mid, l.action, coalesce(l.rating10, f.r) AS rating10, coalesce(f.t, 'day') AS happened FROM listed l LEFT JOIN (SELECT 'u' || uid AS slug, mid, 'wish' AS action, 5 AS r, 'feed' AS t FROM prefs WHERE pref_type = 'want_to_watch' AND uid % 2 = 0) f ON f.slug = l.slug AND f.mid = l.mid AND f.action = l.action")
def j21_feed_enrichment(c: Catalog) -> DataFrame:
    feed = c.prefs.filter("pref_type = 'want_to_watch' AND uid % 2 = 0").select(F.concat(F.lit("u"), "uid").alias("slug"), "mid", F.lit("wish").alias("action"), F.lit(5).alias("rating10"), F.lit("feed").alias("happened"))
    return K.enrich(listed(c).withColumn("happened", F.lit("day")), feed)


FEED_ITEMS = "SELECT 'u' || uid AS slug, mid, CASE WHEN pref_type = 'like' THEN 'collect' ELSE 'wish' END AS action, CASE WHEN pref_type = 'like' THEN '看过' ELSE '想看' END || mid AS title, CASE WHEN pref_type = 'like' THEN 5.0 END AS rating, CASE WHEN pref_type = 'like' THEN 'c' || mid END AS comment, strftime(created_at + INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S') AS happened FROM prefs"


@query(FEED_ITEMS)
def sc9_feed_items(c: Catalog) -> DataFrame:
    """The items of users' feeds, from feeds that the preferences are written into."""
    like = F.col("pref_type") == "like"
    about = F.when(like, F.concat(F.lit("<p>推荐: 力荐</p><p>备注: c"), "mid", F.lit("</p>"))).otherwise("")
    item = F.concat(F.lit("<item><title>"), F.when(like, "看过").otherwise("想看"), "mid", F.lit("</title><link>https://e.org/subject/"), "mid", F.lit("/</link><description><![CDATA["), about, F.lit("]]></description><pubDate>"), F.date_format("created_at", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><guid>g</guid></item>"))
    feeds = c.prefs.select(F.concat(F.lit("u"), "uid").alias("slug"), item.alias("i")).groupBy("slug").agg(F.array_join(F.collect_list("i"), "\n").alias("body"))
    found = K.feed_items(feeds.select("slug", F.concat(F.lit("<rss><channel>"), "body", F.lit("</channel></rss>")).alias("xml")))
    return found.select("slug", "mid", "action", "title", "rating", "comment", "happened")


@query("SELECT page_id AS owner, unnest(list_distinct(regexp_extract_all(html, 'href=\"/([^\"/]+)\"', 1))) AS slug FROM pages", prelude=False)
def x30_page_contacts(c: Catalog) -> DataFrame:
    people = c.table("pages").withColumn("html", F.regexp_replace("html", 'href="/', 'href="https://example.org/people/'))
    found = K.contacts(people, F.col("page_id").cast("string"))
    return found.select(F.col("owner").cast("bigint").alias("owner"), "slug")


@query("SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS h, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST('0x' || substr(sha256('s:' || o_orderkey || ':wish:' || strftime(o_orderdate, '%Y-%m-%d')), 1, 8) AS BIGINT) % 5 + 18 AS hour FROM orders", prelude=False)
def x26_inferred_hours(c: Catalog) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    at = X.local_time(F.lit("s"), F.col("o_orderkey").cast("string"), "wish", day)
    return c.table("orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("h"), day.alias("day"), F.substring(at, 12, 2).cast("bigint").alias("hour"))


@query("WITH g AS (SELECT l_suppkey AS k, 1 AS g, min(l_shipdate) AS d FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1 UNION ALL SELECT l_suppkey, 2, max(l_shipdate) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT k, d FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY g) AS r FROM g) WHERE r = 1", prelude=False)
def u9_merge_groups(c: Catalog) -> DataFrame:
    one = lambda flag, f: c.table("lineitem").filter(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("k")).agg(f("l_shipdate").alias("d"))
    return K.merge_groups([one("A", F.min), one("R", F.max)], "k")


@query("WITH f AS (SELECT user_id, event_type AS item, max(ts) AS ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1, 2) SELECT user_id, item, ts, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item) AS k FROM f) WHERE k <= 120", prelude=False)
def w15_recent_history(c: Catalog) -> DataFrame:
    """Each user's recent items, the newest entry of each, the latest 120."""
    events = c.table("events")
    fresh = events.filter(F.col("ts") > events.agg(F.max("ts").alias("now")).scalar() - F.expr("INTERVAL 2 DAYS"))
    newest = fresh.groupBy("user_id", F.col("event_type").alias("item")).agg(F.max("ts").alias("ts"))
    return newest.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "item"))).filter("k <= 120")


@query("SELECT conv_id, string_agg(role, '>' ORDER BY p) AS roles FROM (SELECT conv_id, role, min(turn) AS p FROM conversations GROUP BY 1, 2) GROUP BY conv_id", prelude=False)
def w13_ordered_dedupe(c: Catalog) -> DataFrame:
    first = c.table("conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("p"))
    ordered = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("p", "role"))).alias("r"))
    return ordered.select("conv_id", F.array_join(F.transform("r", lambda x: x["role"]), ">").alias("roles"))


@query("SELECT doc_id, (SELECT count(*) FROM benchmark) AS n_items, length(text) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)", prelude=False)
def j22_enriched_rows(c: Catalog) -> DataFrame:
    good = c.table("labels").filter("quality = 1").select("doc_id")
    n = c.table("benchmark").agg(F.count("*").alias("n_items"))
    return c.table("documents").join(good, "doc_id", "left_semi").select("doc_id", n.scalar().alias("n_items"), F.length("text").alias("n"))


@query("SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents GROUP BY source, lang", prelude=False)
def sc3_document_scan(c: Catalog) -> DataFrame:
    return c.table("documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query("SELECT uid, mid, h, k FROM (SELECT uid, mid, h, row_number() OVER (PARTITION BY uid ORDER BY rated_at DESC, mid) AS k FROM ratings) WHERE k BETWEEN 11 AND 20")
def pf14_paged_ratings(c: Catalog) -> DataFrame:
    order = Window.partitionBy("uid").orderBy(F.desc("rated_at"), "mid")
    return c.ratings.withColumn("k", F.row_number().over(order)).filter("k BETWEEN 11 AND 20").select("uid", "mid", "h", "k")


@query("SELECT mid FROM movies EXCEPT SELECT mid FROM ratings WHERE h >= 7")
def u3_difference(c: Catalog) -> DataFrame:
    return c.movie_keys.select("mid").subtract(c.ratings.filter("h >= 7").select("mid"))


@query("WITH s AS (SELECT mid, list(DISTINCT genre) AS g FROM genre_edges GROUP BY mid) SELECT x.mid AS a, y.mid AS b, floor(CAST(len(list_intersect(x.g, y.g)) AS DOUBLE) / len(list_distinct(list_concat(x.g, y.g))) * 10000 + 0.5) / 10000 AS jaccard FROM s x JOIN s y ON CAST(y.mid AS BIGINT) = CAST(x.mid AS BIGINT) + 1")
def u6_jaccard(c: Catalog) -> DataFrame:
    sets = c.genre_edges.groupBy("mid").agg(F.collect_set("genre").alias("g"))
    one = sets.select(F.col("mid").alias("a"), F.col("g").alias("ga"), (F.col("mid").cast("bigint") + 1).alias("k"))
    two = sets.select(F.col("mid").alias("b"), F.col("g").alias("gb"), F.col("mid").cast("bigint").alias("k"))
    return one.join(two, "k").select("a", "b", X.rounded(F.size(F.array_intersect("ga", "gb")) / F.size(F.array_union("ga", "gb"))).alias("jaccard"))


@query("SELECT mid, name, score, votes FROM movies WHERE mid = '17'")
def pf15_point_lookup(c: Catalog) -> DataFrame:
    return c.movies.filter("mid = '17'").select("mid", "name", "score", "votes")


@query("SELECT 'movie_' || mid AS id, 'movie' AS kind, name AS label, CAST(year AS VARCHAR) AS year, (score IS NOT NULL) AS has_score, false AS has_votes FROM movies")
def pf17_node_payload(c: Catalog) -> DataFrame:
    from graphloom.operators.graph import node_payload

    properties = F.create_map(F.lit("name"), F.col("name"), F.lit("year"), F.col("year").cast("string"), F.lit("score"), F.col("score").cast("string"), F.lit("votes"), F.col("votes").cast("string"))
    shown = node_payload(c.movies.select(F.lit("movie").alias("kind"), F.col("mid").alias("key"), properties.alias("properties")))
    p = F.col("properties")
    return shown.select("id", "kind", "label", F.try_element_at(p, F.lit("year")).alias("year"), F.map_contains_key(p, "score").alias("has_score"), F.map_contains_key(p, "votes").alias("has_votes"))


@query("SELECT count(*) AS n, count(*) FILTER (k IN (SELECT mid FROM movies)) AS matched, floor(count(*) FILTER (k IN (SELECT mid FROM movies)) * 10000.0 / count(*) + 0.5) / 10000 AS rate FROM (SELECT DISTINCT mid AS k FROM prefs)")
def j25_match_rate(c: Catalog) -> DataFrame:
    ids = c.prefs.select("mid").distinct()
    marked = ids.join(c.movie_keys.select("mid", F.lit(1).alias("hit")), "mid", "left")
    return marked.agg(F.count("*").alias("n"), F.count("hit").alias("matched"), X.rounded(F.count("hit") / F.count("*")).alias("rate"))


@query("WITH e AS (SELECT pid, mid FROM directed), c AS (SELECT count(*) AS n FROM e) SELECT pid, mid, n, n > 100 AS truncated FROM (SELECT * FROM e ORDER BY pid, mid LIMIT 100), c")
def l8_truncation(c: Catalog) -> DataFrame:
    from graphloom.operators.graph import truncated

    first, about = truncated(c.directed.select("pid", "mid"), 100, "pid", "mid")
    return first.select("pid", "mid", about.select("n").scalar().alias("n"), about.select("truncated").scalar().alias("truncated"))


@query(
    "WITH e AS (SELECT 'ACTED_IN' AS rel, l_suppkey AS s, l_partkey AS d FROM lineitem UNION ALL SELECT 'DIRECTED', l_suppkey, l_partkey FROM lineitem WHERE l_linenumber = 1), g AS (SELECT rel, s, d, count(*) AS n FROM e GROUP BY ALL), "
    "f AS (SELECT *, s NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey > 2) AS ms, d NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) AS md FROM g) "
    "SELECT 'Movie' AS name, (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) - count(DISTINCT l_partkey) FROM lineitem) AS n_duplicates, NULL AS missing_pid, NULL AS missing_mid, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_written "
    "UNION ALL SELECT rel, CAST(sum(n) AS BIGINT), CAST(sum(n - 1) AS BIGINT), count(*) FILTER (ms), count(*) FILTER (md), count(*) FILTER (NOT ms AND NOT md) FROM f GROUP BY rel",
    prelude=False,
)
def sk9_write_checks(c: Catalog) -> DataFrame:
    """Nodes and edges written with their checks: rows, duplicates, missing ends and rows that were written."""
    lines = c.table("lineitem").select(F.col("l_suppkey").alias("pid"), F.col("l_partkey").alias("mid"), "l_linenumber")
    nodes = writers.write_nodes(lines.select("mid", "l_linenumber"), "mid", fresh_path(c.spark, "nodes"))
    edges = lines.select("pid", "mid", F.lit("ACTED_IN").alias("rel")).unionByName(lines.filter("l_linenumber = 1").select("pid", "mid", F.lit("DIRECTED").alias("rel")))
    ends = {"pid": c.table("supplier").filter("s_nationkey > 2").select(F.col("s_suppkey").alias("pid")), "mid": c.table("part").filter("p_size > 10").select(F.col("p_partkey").alias("mid"))}
    found = writers.write_edges(edges, ["rel", "pid", "mid"], fresh_path(c.spark, "edges"), ends, ["ACTED_IN", "DIRECTED"])
    rows = [("Movie", nodes["rows"], nodes["duplicates"], None, None, nodes["written"]), *((r, n["rows"], n["duplicates"], n["missing_pid"], n["missing_mid"], n["written"]) for r, n in found.items())]
    return c.spark.createDataFrame(rows, "name string, n_rows bigint, n_duplicates bigint, missing_pid bigint, missing_mid bigint, n_written bigint")


@query(
    "WITH e AS (SELECT user_id AS id, ts, event_type IN ('error', 'purchase') AS finished FROM events), "
    "f AS (SELECT *, lead(ts) OVER w AS next_ts, lead(finished) OVER w AS next_finished FROM e WINDOW w AS (PARTITION BY id ORDER BY ts, finished)) "
    "SELECT id, ts AS claimed_at, ts + INTERVAL 30 MINUTE AS ended_at, 'expired' AS reason FROM f WHERE NOT finished AND (next_ts > ts + INTERVAL 30 MINUTE OR next_ts IS NULL AND epoch_us(ts) // 1000 + 1800001 <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events)) "
    "UNION ALL SELECT id, ts, next_ts, 'finished' FROM f WHERE NOT finished AND next_finished AND next_ts <= ts + INTERVAL 30 MINUTE",
    prelude=False,
)
def sk18_lock_expiry(c: Catalog) -> DataFrame:
    """Locks that end, from users' events as a stream: errors and purchases end a lock, other events claim or renew it."""
    raw = c.spark.readStream.schema(c.table("events").schema).parquet(f"{c.folder}/{{events}}.parquet")  # a stream takes a folder or a pattern
    events = raw.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").isin("error", "purchase").alias("finished"))
    return expiry.run_available(expiry.lock_ends(events), "locks").withColumns({k: F.col(k).cast("timestamp_ntz") for k in ("claimed_at", "ended_at")})


@query(FEED_ITEMS)
def sc9_landed_feeds(c: Catalog) -> DataFrame:
    """The items of users' feeds from landed files, which the reader takes item by item; the guid tells the user."""
    like = F.col("pref_type") == "like"
    item = {
        "title": F.concat(F.when(like, "看过").otherwise("想看"), "mid"),
        "link": F.concat(F.lit("https://e.org/subject/"), "mid", F.lit("/")),
        "description": F.when(like, F.concat(F.lit("<p>推荐: 力荐</p><p>备注: c"), "mid", F.lit("</p>"))).otherwise(""),
        "pubDate": F.concat(F.date_format("created_at", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT")),
        "guid": F.concat(F.lit("u"), "uid"),
    }
    path = fresh_path(c.spark, "feeds")
    c.prefs.select(*(v.alias(k) for k, v in item.items())).write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    found = K.landed_feed_items(readers.feed_rows(c.spark, path).withColumn("slug", F.col("guid")))
    return found.select("slug", "mid", "action", "title", "rating", "comment", "happened")
