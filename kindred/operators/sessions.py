"""Recommendation from recent sessions and searches, for all users at once.

Times are epoch microseconds (LONG), so results do not depend on the session time zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import scalar as fx
from kindred.operators.items import search_items_vector
from kindred.operators.recommend import predict_ratings, recommend_top_n
from kindred.session import store


def sessionize(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Add session_id and created_at: a session ends when a user idles for `gap_seconds`.

    Events are cut into slots as wide as the gap. Within a slot no two events can be a gap apart,
    so the slot's first and last time are all that decides, and the window runs over slots
    instead of events. A user with a third of all events costs one row per slot there.
    """
    gap = gap_seconds * 1_000_000
    slotted = events.withColumn("slot", F.floor(F.col("ts") / F.lit(gap)))
    slots = slotted.groupBy("user_id", "slot").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    by_user = Window.partitionBy("user_id").orderBy("slot")
    idle = F.col("first") - F.lag("last").over(by_user)
    starts = slots.withColumn("start", F.when(idle.isNull() | (idle >= gap), F.col("first")))
    running = by_user.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sessions = starts.select("user_id", "slot", F.max("start").over(running).alias("created_at"))
    return (slotted.join(sessions, ["user_id", "slot"]).drop("slot")
            .withColumn("session_id", session_key(F.col("user_id"), F.col("created_at"))))


def session_key(user, created_at):
    return F.concat_ws("-", user.cast("string"), created_at.cast("string"))


def newest_sessions(sessions: DataFrame, n: int) -> DataFrame:
    """The sessions at the n newest session rows per user; ties at the border are all kept."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"))
    return sessions.withColumn("rank", F.rank().over(order)).where(F.col("rank") <= n)


def recent_session_items(sessions: DataFrame, activity: DataFrame, n_sessions: int = 4) -> DataFrame:
    """One row per weighted action in the newest sessions of each user."""
    weight = fx.action_weight(F.col("action"))
    return (activity.withColumn("weight", weight).where(F.col("weight").isNotNull())
            .join(newest_sessions(sessions, n_sessions).drop("rank"), "session_id")
            .select("user_id", "session_id", "created_at", "item_id", "action", "weight"))


def latest_searches(sessions: DataFrame, searches: DataFrame, n: int = 10) -> DataFrame:
    """The newest searches of each user's latest session."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("searched_at"), "content")
    return (searches.join(newest_sessions(sessions, 1).drop("rank"), "session_id")
            .select("user_id", "session_id", "created_at", "content", "searched_at",
                    F.row_number().over(order).alias("rank"))
            .where(F.col("rank") <= n))


def rank_candidates(session_items: DataFrame, candidates: DataFrame, items: DataFrame, n: int = 10,
                    order: str = "desc") -> DataFrame:
    """Per user the n best candidates by cosine(candidate, session item) x action weight.

    A candidate counts once, with its best score (its worst one for order='asc'). Equal actions on
    an item and equal candidates are merged first, and each pair of items is compared once,
    however many users need it.
    """
    acted = session_items.select("user_id", F.col("item_id").alias("seen"), "weight").distinct()
    wanted = candidates.select("user_id", "item_id").distinct()
    pairs = wanted.join(acted, "user_id")
    vectors = items.select("item_id", fx.unit(F.col("embedding")).alias("vector")).where("vector is not null")
    compared = (pairs.select("item_id", "seen").distinct()
                .join(vectors, "item_id")
                .join(vectors.select(F.col("item_id").alias("seen"), F.col("vector").alias("seen_vector")), "seen")
                .select("item_id", "seen", fx.round_to(fx.dot(F.col("vector"), F.col("seen_vector")), 10).alias("cosine")))
    best, sort = (F.max, F.desc) if order == "desc" else (F.min, F.asc)
    scored = (pairs.join(compared, ["item_id", "seen"]).groupBy("user_id", "item_id")
              .agg(best(F.col("cosine") * F.col("weight")).alias("score")))
    by_user = Window.partitionBy("user_id").orderBy(sort("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(by_user)).where(F.col("rank") <= n)


def exclude_rated(candidates: DataFrame, ratings: DataFrame) -> DataFrame:
    return candidates.join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def split_rated(candidates: DataFrame, ratings: DataFrame) -> DataFrame:
    """Candidates with a flag telling whether the user has rated them."""
    rated = ratings.select("user_id", "item_id").distinct().withColumn("rated", F.lit(True))
    return (candidates.join(rated, ["user_id", "item_id"], "left")
            .withColumn("rated", F.coalesce("rated", F.lit(False))))


def recommend_from_sessions(sessions: DataFrame, activity: DataFrame, searches: DataFrame, items: DataFrame,
                            query_vectors: Callable[[DataFrame], DataFrame], ratings: DataFrame,
                            similarity: DataFrame | Callable[[DataFrame], DataFrame], hits: int = 20, n: int = 10,
                            n_sessions: int = 4) -> DataFrame:
    """Recent items x latest searches -> candidates -> unrated ones -> predicted top n.

    `similarity` may be a function of the users (user_id) that have candidates, so that only theirs are scored.

    `query_vectors` turns distinct search contents (content) into (content, vector); users with
    the same search share one lookup.
    """
    seen = recent_session_items(sessions, activity, n_sessions)
    asked = store(latest_searches(sessions, searches).select("user_id", "content"), "asked")
    queries = store(query_vectors(asked.select("content").distinct()).withColumnRenamed("content", "query_id"), "queries")
    found = search_items_vector(queries, items, hits).select(F.col("query_id").alias("content"), "item_id")
    ranked = rank_candidates(seen, asked.join(found, "content"), items, n)
    wanted = store(exclude_rated(ranked.select("user_id", "item_id"), ratings), "wanted")
    if callable(similarity):
        similarity = similarity(wanted.select("user_id").distinct())
    return recommend_top_n(predict_ratings(wanted, ratings, similarity), n)


def recommendation_payload(recommended: DataFrame) -> DataFrame:
    """One JSON document per user: customer id and the ranked list."""
    entry = F.struct("rank", F.col("item_id").cast("string").alias("product_id"),
                     F.col("prediction").cast("string").alias("predict_rating"))
    listed = recommended.groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("list"))
    plain = F.transform("list", lambda e: e.dropFields("rank"))
    return listed.select("user_id", F.to_json(F.struct(F.col("user_id").cast("string").alias("customer_id"),
                                                       plain.alias("list"))).alias("payload"))
