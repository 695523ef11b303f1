"""What users like: signals, activity, profiles, and the weights used for them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.lists import first_of_each, in_lists, list_sums, numbered
from graphloom.sources.scratch import settled

#: Weights of likes and wishes; ratings weigh their share of five stars.
LIKE, WISH = 0.7, 0.25
#: Half-stars from which a rating is positive.
POSITIVE = 7


def positive_signals(ratings: DataFrame, prefs: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(uid, mid, kind, weight10, at): positive ratings, and likes and wishes of films without any rating.

    weight10 is the weight times 100, as an integer. ``excluded`` has (uid, mid).
    """
    if excluded is not None:
        ratings, prefs = (df.join(excluded, ["uid", "mid"], "left_anti") for df in (ratings, prefs))
    rated = ratings.filter(F.col("h") >= POSITIVE).select("uid", "mid", F.lit("rating").alias("kind"), (F.col("h") * 10).cast("long").alias("weight100"), F.col("rated_at").alias("at"))
    free = prefs.join(ratings, ["uid", "mid"], "left_anti")
    weight = F.when(F.col("pref_type") == "like", round(LIKE * 100)).otherwise(round(WISH * 100)).cast("long")
    return rated.unionByName(free.select("uid", "mid", F.col("pref_type").alias("kind"), weight.alias("weight100"), F.col("created_at").alias("at")))


def signal_weight(signal: Column, rating: Column, raw: bool = False) -> Column:
    """A signal's weight, at least 0; without one the rating's share of five stars, or (``raw``, as content ranking has it) the stars."""
    stars = rating.cast("double") / (1.0 if raw else 5.0)
    return F.greatest(F.coalesce(signal.cast("double"), stars, F.lit(0.0)), F.lit(0.0))


def capped_signals(signals: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The strongest and latest signals of each kind, at most ``caps[kind]`` per user."""
    order = Window.partitionBy("uid", "kind").orderBy(F.desc("weight100"), F.desc("at"), "mid")
    cap = F.lit(0)
    for kind, n in caps.items():
        cap = F.when(F.col("kind") == kind, n).otherwise(cap)
    return signals.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= cap)


def seen_items(ratings: DataFrame, prefs: DataFrame) -> DataFrame:
    """(uid, mid) that a user has rated or marked."""
    return ratings.select("uid", "mid").union(prefs.select("uid", "mid")).distinct()


def activity(users: DataFrame, ratings: DataFrame, prefs: DataFrame, cold_below: int = 3) -> DataFrame:
    """Counts per user and whether the user is cold (fewer distinct items than ``cold_below``)."""
    marks = ratings.select("uid", "mid", F.lit("rating").alias("kind")).union(prefs.select("uid", "mid", "pref_type"))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    counted = marks.groupBy("uid").agg(n("rating").alias("n_ratings"), n("like").alias("n_likes"), n("want_to_watch").alias("n_wishes"), F.count_distinct("mid").alias("effective"))
    joined = users.select("uid").join(counted, "uid", "left").na.fill(0, ["n_ratings", "n_likes", "n_wishes", "effective"])
    return joined.withColumn("cold", F.col("effective") < cold_below)


def weight_index(ratings: DataFrame, prefs: DataFrame, holdout: DataFrame | None = None) -> DataFrame:
    """(uid, mid, weight100, degree): the best of a positive rating and a like, and the number of such items of the user."""
    rated = ratings.filter(F.col("h") >= POSITIVE).select("uid", "mid", (F.col("h") * 10).cast("long").alias("w"))
    liked = prefs.filter("pref_type = 'like'").select("uid", "mid", F.lit(round(LIKE * 100)).cast("long").alias("w"))
    both = rated.union(liked)
    if holdout is not None:
        both = both.join(holdout, ["uid", "mid"], "left_anti")
    best = both.groupBy("uid", "mid").agg(F.max("w").alias("weight100"))
    return best.withColumn("degree", F.count("*").over(Window.partitionBy("uid")))


def _most_liked(top: int | None):
    """The function that keeps each user's entities of most items."""

    def finish(users: np.ndarray, place: np.ndarray, entity: np.ndarray, total: np.ndarray, n: np.ndarray, _: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((entity, -n, place))
        if top is not None:
            order = order[first_of_each(place[order], top)]
        columns = [pa.array(users[place[order]]), pa.array(entity[order].astype(np.int32)), pa.array(n[order]), pa.array(total[order] >> 32), pa.array(total[order] & 0xFFFFFFFF)]
        return pa.RecordBatch.from_arrays(columns, ["uid", "id", "n", "rated", "total"])

    return finish


def liked_entities(likes: DataFrame, tokens: DataFrame, top: int | None) -> DataFrame:
    """(uid, entity, n, avg_h): each user's ``top`` entities (all if None) by number of items, from (uid, mid, h) with h null where unrated, and (mid, entity).

    An item and its entity are no row: an item carries the numbers of its entities, in
    the order of their names, as a list to its users.
    """
    names = settled(numbered(tokens.select("entity").distinct().orderBy("entity")), "entities")
    lists = in_lists(tokens.join(names, "entity").select("mid", "id"), "mid", ["id"])
    rated = F.coalesce(F.col("h").cast("long") + F.lit(1 << 32), F.lit(0)).alias("w")
    rows = likes.select("uid", "mid", rated).join(lists, "mid").select(F.col("uid").cast("long").alias("key"), "w", F.lit(0).alias("of"), F.col("id").alias("ids"))
    best = list_sums(rows, _most_liked(top), "uid long, id int, n long, rated long, total long")
    mean = F.when(F.col("rated") > 0, F.floor(F.col("total") / F.col("rated") * 100 + 0.5) / 100).alias("avg_h")
    return best.join(names, "id").select("uid", "entity", "n", mean)


def taste(signals: DataFrame, tokens: DataFrame, ratings: DataFrame, top: int) -> DataFrame:
    """(uid, entity, n, avg_h): each user's ``top`` entities by number of liked items, with the mean half-stars of rated ones."""
    likes = signals.select("uid", "mid").distinct().join(ratings.select("uid", "mid", "h"), ["uid", "mid"], "left")
    return liked_entities(likes, tokens, top)
