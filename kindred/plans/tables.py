"""How the driver's tables stand for ratings, items, sessions and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import scalar as fx
from kindred.operators.ratings import dedupe_ratings
from kindred.operators.sessions import sessionize
from kindred.session import store

SESSION_GAP_SECONDS = 6 * 3600
# Ratings up to this day are the stored training data, later ones are new reviews / the test set.
MARK_EPOCH = 975628800  # 2000-12-01
# Event types that stand for a session action, and the one that stands for a search.
ACTIONS = {"click": 0, "purchase": 1, "view": 2}
SEARCH_EVENT = "signup"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating, ts), duplicates included."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
                    (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("double").alias("rating"),
                    fx.epoch_seconds(F.col("o_orderdate")).alias("ts")))


def ratings_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (user, item), stored once per query since several steps read it."""
    return store(dedupe_ratings(ratings(spark, sf_dir)), "ratings")


def train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ratings up to the mark, and those after it that the training data does not hold yet."""
    everything = ratings_dedup(spark, sf_dir)
    return (everything.where(F.col("ts") <= MARK_EPOCH), everything.where(F.col("ts") > MARK_EPOCH))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")


def named_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"))


def described_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with two text fields: the name, and the brand and kind as a summary."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"),
                                               F.concat_ws(" ", "p_brand", "p_type").alias("summary"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("name"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(table(spark, sf_dir, "events"))


def shape_events(raw: DataFrame) -> DataFrame:
    """(user_id, ts in microseconds, event_type, item_id); the item is the number in `props`."""
    return raw.select("user_id", fx.epoch_micros(F.col("ts")).alias("ts"), "event_type",
                      F.get_json_object("props", "$.k").cast("bigint").alias("item_id"))


def action_code(event_type):
    """Action of an event type, null for types that are no action."""
    code = F.lit(None).cast("int")
    for name, value in ACTIONS.items():
        code = F.when(event_type == name, value).otherwise(code)
    return code


def activity_of(events: DataFrame) -> DataFrame:
    return events.withColumn("action", action_code(F.col("event_type"))).where("action is not null")


def session_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, session activity and searches, from events cut at six idle hours."""
    events = store(sessionize(_events(spark, sf_dir), SESSION_GAP_SECONDS), "session-events")
    sessions = events.select("session_id", "user_id", "created_at").distinct()
    activity = activity_of(events).select("session_id", "action", "item_id")
    searches = (events.where(F.col("event_type") == SEARCH_EVENT)
                .select("session_id", F.col("item_id").cast("string").alias("content"),
                        F.col("ts").alias("searched_at")))
    return sessions, activity, searches
