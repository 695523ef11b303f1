"""The domain's tables, derived from the input tables.

Items are films, suppliers are persons, customers are users, order lines are
credits and ratings, and events are preferences. Ids of the graph are strings.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Order lines of a task of joins and sums over all lines.
LINES = 500_000


class Catalog:
    """Lazy views over the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def parts(self) -> int:
        """Tasks for all order lines; 0 where there are no more than cores."""
        n = self.table("lineitem").count() // LINES  # from the files' footers
        return n if n > self.spark.sparkContext.defaultParallelism else 0

    def spread(self, df: DataFrame, *keys: str) -> DataFrame:
        """Rows of the order lines by key, in as many tasks as the lines need: adaptive execution would make tasks grow with the table."""
        return df.repartition(self.parts, *keys) if self.parts else df

    @cached_property
    def movies(self) -> DataFrame:
        lines = self.table("lineitem").groupBy(F.col("l_partkey").cast("string").alias("mid"))
        scored = lines.agg(F.count("*").alias("votes"), (F.floor(F.sum("l_quantity") * 2 / F.count("*") + 0.5) / 10).alias("score"))
        part = self.table("part").select(
            F.col("p_partkey").cast("string").alias("mid"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("content_type"),
            (F.col("p_size") + 1970).alias("year"),
            F.replace("p_name", F.lit(" "), F.lit("/")).alias("genres"),
            F.col("p_brand").alias("region"),
            F.concat(F.lit("l"), F.col("p_partkey") % 8).alias("language"),
        )
        return part.join(scored, "mid", "left")

    @cached_property
    def movie_keys(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").cast("string").alias("mid"), F.col("p_name").alias("name"), (F.col("p_size") + 1970).alias("year"), F.col("p_type").alias("content_type"), F.col("p_brand").alias("region"), F.concat(F.lit("l"), F.col("p_partkey") % 8).alias("language"))

    @cached_property
    def genre_edges(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").cast("string").alias("mid"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("genre"))

    @cached_property
    def persons(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        s = self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        return s.select(F.col("s_suppkey").cast("string").alias("pid"), F.col("s_name").alias("name"), F.col("n_name").alias("birthplace"), F.col("r_name").alias("profession"))

    @cached_property
    def acted(self) -> DataFrame:
        """Credits with distinct billing positions in each film, by the largest line number, then the person's id."""
        keys = [F.col("l_suppkey").cast("string").alias("pid"), F.col("l_partkey").cast("string").alias("mid")]
        credits = self.table("lineitem").groupBy(*keys).agg(F.max("l_linenumber").alias("line"))
        return credits.select("pid", "mid", F.row_number().over(Window.partitionBy("mid").orderBy("line", "pid")).alias("ord"))

    @cached_property
    def directed(self) -> DataFrame:
        lines = self.table("lineitem").filter("l_linenumber = 1")
        return lines.select(F.col("l_suppkey").cast("string").alias("pid"), F.col("l_partkey").cast("string").alias("mid")).distinct()

    @cached_property
    def users(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("uid"), F.concat_ws("_", F.lower("c_mktsegment"), "c_custkey").alias("username"), (F.col("c_custkey") % 50 == 0).alias("is_mock"))

    @cached_property
    def ratings(self) -> DataFrame:
        """Half-stars h of 1..10 per user and film."""
        lines = self.spread(self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity"), "l_orderkey")
        orders = self.spread(self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
        of_users = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("uid"), F.col("l_partkey").cast("string").alias("mid"), "l_quantity", "o_orderdate")
        keyed = self.spread(of_users, "uid", "mid").groupBy("uid", "mid")
        return keyed.agg(F.floor((F.max("l_quantity") + 4) / 5).cast("int").alias("h"), F.max("o_orderdate").alias("rated_at"))

    @cached_property
    def prefs(self) -> DataFrame:
        events = self.table("events").filter(F.col("event_type").isin("purchase", "view"))
        kind = F.when(F.col("event_type") == "purchase", "like").otherwise("want_to_watch")
        item = F.from_json("props", "k int")["k"].cast("string")
        return events.groupBy(F.col("user_id").alias("uid"), item.alias("mid"), kind.alias("pref_type")).agg(F.max("ts").alias("created_at"))


#: The same views as SQL; DuckDB leaves out those that a query does not use.
PRELUDE = """
WITH movies AS (
  SELECT CAST(p_partkey AS VARCHAR) AS mid, p_name AS name, p_type AS content_type, p_size + 1970 AS year,
         replace(p_name, ' ', '/') AS genres, p_brand AS region, 'l' || (p_partkey % 8) AS language, votes, score
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS votes, floor(sum(l_quantity) * 2 / count(*) + 0.5) / 10 AS score
                       FROM lineitem GROUP BY l_partkey) s ON s.l_partkey = p_partkey),
genre_edges AS (SELECT DISTINCT mid, unnest(string_split(genres, '/')) AS genre FROM movies),
persons AS (SELECT CAST(s_suppkey AS VARCHAR) AS pid, s_name AS name, n_name AS birthplace, r_name AS profession
            FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
acted AS (SELECT pid, mid, row_number() OVER (PARTITION BY mid ORDER BY line, pid) AS ord FROM (SELECT CAST(l_suppkey AS VARCHAR) AS pid, CAST(l_partkey AS VARCHAR) AS mid, max(l_linenumber) AS line FROM lineitem GROUP BY 1, 2)),
directed AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS pid, CAST(l_partkey AS VARCHAR) AS mid FROM lineitem WHERE l_linenumber = 1),
users AS (SELECT c_custkey AS uid, lower(c_mktsegment) || '_' || c_custkey AS username, c_custkey % 50 = 0 AS is_mock FROM customer),
ratings AS (SELECT o_custkey AS uid, CAST(l_partkey AS VARCHAR) AS mid, CAST(floor((max(l_quantity) + 4) / 5) AS INTEGER) AS h, max(o_orderdate) AS rated_at
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
prefs AS (SELECT user_id AS uid, regexp_extract(props, '([0-9]+)', 1) AS mid,
                 CASE WHEN event_type = 'purchase' THEN 'like' ELSE 'want_to_watch' END AS pref_type, max(ts) AS created_at
          FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1, 2, 3)
"""
