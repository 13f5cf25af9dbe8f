"""Ratings preparation: lists, means, importance, duplicates, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Item ids a dense matrix may broadcast as its blocks' lists (8 bytes each): 32 MB.
BROADCAST_ITEMS = 4_000_000
# Cells of a dense matrix that one task makes, about.
TASK_CELLS = 20_000_000


def dedupe_ratings(ratings: DataFrame) -> DataFrame:
    """One row per (user, item): the latest, and the highest rating among equally late ones.

    A max over (ts, rating) merges copies before the shuffle, so a pair repeated in a large part
    of the input still reaches its reducer as one row per task. A window would not do that.
    """
    return (ratings.groupBy("user_id", "item_id")
            .agg(F.max(F.struct("ts", "rating")).alias("kept"))
            .select("user_id", "item_id", "kept.rating", "kept.ts"))


def user_list(ratings: DataFrame) -> DataFrame:
    return ratings.select("user_id").distinct()


def item_list(ratings: DataFrame) -> DataFrame:
    return ratings.select("item_id").distinct()


def avg_rating(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("user_id").agg(F.avg("rating").alias("avg_rating"))


def avg_rating_by_label(ratings: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean rating per (user, label). Ratings are averaged per user first, so only one row per
    user meets the labels."""
    return (avg_rating(ratings).join(labels.select("user_id", "label"), "user_id")
            .select("user_id", "label", "avg_rating"))


def importance(ratings: DataFrame) -> DataFrame:
    """F = number of ratings + number of different rating values."""
    by_value = ratings.groupBy("user_id", "rating").agg(F.count("*").alias("n"))
    return by_value.groupBy("user_id").agg((F.sum("n") + F.count("*")).alias("importance"))


def items_per_user(ratings: DataFrame) -> DataFrame:
    """Rated items per user; expects one row per (user, item)."""
    return ratings.groupBy("user_id").agg(F.count("*").alias("n_items"))


def user_stats(ratings: DataFrame) -> DataFrame:
    """Mean and item count per user in one aggregate; expects one row per (user, item)."""
    return ratings.groupBy("user_id").agg(F.avg("rating").alias("avg_rating"), F.count("*").alias("n_items"))


def top_user(values: DataFrame, value: str) -> DataFrame:
    """The user with the largest value (numerically); the smallest id wins a tie."""
    return values.select("user_id", value).orderBy(F.desc(value), "user_id").limit(1)


def max_scale(values: DataFrame, value: str, scaled: str = "scaled") -> DataFrame:
    """Each value divided by the largest one."""
    largest = values.agg(F.max(value)).scalar()
    return values.withColumn(scaled, F.try_divide(F.col(value).cast("double"), largest))


def rating_total(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.sum("rating").alias("total"), F.count("*").alias("n_ratings"))


def high_water_mark(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.max("ts").alias("ts"))


def user_profile(ratings: DataFrame, averages: DataFrame | None = None) -> DataFrame:
    """Mean-filled profile kept sparse: value `base` everywhere, `base + dev` on rated items."""
    averages = avg_rating(ratings) if averages is None else averages
    return (ratings.join(averages.withColumnRenamed("avg_rating", "base"), "user_id")
            .select("user_id", "base", "item_id", (F.col("rating") - F.col("base")).alias("dev")))


def dense_matrix(ratings: DataFrame, block_width: int = 1024, task_cells: int = TASK_CELLS) -> DataFrame:
    """The mean-filled matrix, cut into item blocks: (user_id, block, cells array<item_id, value>).

    A block covers `block_width` consecutive ids, so no row grows with the catalogue. Only this
    export is as large as users x items; every other operator works on the sparse profile. The item lists are broadcast if
    they are small by a count and join last: only sparse rows are shuffled, dealt by user (few users: and by block) to a task
    for `task_cells` cells, as the size of what is shuffled says nothing; an aggregate per (user, block) needs no shuffle.
    """
    block = F.floor(F.col("item_id") / F.lit(block_width)).cast("bigint")
    by_block = ratings.withColumn("block", block)
    blocks = (by_block.select("block", "item_id").distinct()
              .groupBy("block").agg(F.array_sort(F.collect_list("item_id")).alias("items")))
    span = blocks.agg(F.collect_list("block")).scalar()  # blocks that hold items, however far apart the ids lie
    n_items, n_users = (ratings.select(c).distinct().count() for c in ("item_id", "user_id"))
    tasks = max(1, -(-n_items * n_users // task_cells))
    dealt = ["user_id"] if n_users >= 4 * tasks else ["user_id", "block"]
    rated = (by_block.repartition(tasks, *dealt).groupBy("user_id", "block")
             .agg(F.map_from_entries(F.collect_list(F.struct("item_id", "rating"))).alias("rated")))
    averages = avg_rating(ratings)
    averages = averages.repartition(tasks, "user_id") if dealt == ["user_id"] else averages
    grid = averages.withColumn("block", F.explode(span))
    grid = grid if dealt == ["user_id"] else grid.repartition(tasks, *dealt)
    # Most blocks of a user hold no rating: their values need no look at each item.
    value = lambda i: F.coalesce(F.try_element_at("rated", i), F.col("avg_rating"))
    values = F.when(F.col("rated").isNull(), F.array_repeat("avg_rating", F.size("items"))).otherwise(F.transform("items", value))
    return (grid.join(rated, ["user_id", "block"], "left").join(F.broadcast(blocks) if n_items <= BROADCAST_ITEMS else blocks, "block")
            .select("user_id", "block", F.arrays_zip(F.col("items").alias("item_id"), values.alias("value")).alias("cells")))


def rated_cells(ratings: DataFrame, block_width: int = 1024) -> DataFrame:
    """Only the rated cells of the matrix, in the same blocks; expects one row per (user, item)."""
    block = F.floor(F.col("item_id") / F.lit(block_width)).cast("bigint").alias("block")
    return ratings.groupBy("user_id", block).agg(
        F.array_sort(F.collect_list(F.struct("item_id", F.col("rating").alias("value")))).alias("cells"))


def rating_side(rating, average):
    """-1, 0 or 1: below, at or above the user's mean."""
    return F.signum(rating - average).cast("int")


