"""Item documents, text embedding, nearest items by vector and search by words."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions import scalar as fx
from kindred.functions import text as tx
from kindred.session import store

# Bytes of vectors a task holds per side of a block, and scores it holds at once.
BLOCK_BYTES = 32 << 20
SCORES_AT_ONCE = 4 << 20
# Scores of which only the largest counts when a query's k-th score is bounded from below.
GROUP = 64


def extract_item_id(keys: DataFrame, key: str = "key") -> DataFrame:
    """Ids of the item documents among stored keys."""
    return keys.select(fx.item_id_from_key(F.col(key)).alias("item_id")).where("item_id is not null")


def item_embeddings(wanted: DataFrame, items: DataFrame) -> DataFrame:
    """Vectors of the wanted items."""
    return wanted.select("item_id").join(items.select("item_id", "embedding"), "item_id")


def text_weights(items: DataFrame, dims: int = 64, corpus: DataFrame | None = None) -> DataFrame:
    """Hashed TF-IDF weights (item_id, slot, weight), scaled to length 1 per item.

    The whole text counts. `corpus` gives the documents the frequencies come from (default: the
    items themselves); at most `dims` frequency rows are broadcast.
    """
    def counts(df):
        return (df.select("item_id", F.explode(tx.terms(F.col("name"))).alias("term"))
                .groupBy("item_id", tx.term_slot(F.col("term"), dims).alias("slot")).agg(F.count("*").alias("tf")))

    own = store(counts(items), "term-counts")  # texts are split once; frequencies read the counts
    total = (items if corpus is None else corpus).agg(F.count("*")).scalar()
    idf = ((own if corpus is None else counts(corpus)).groupBy("slot").agg(F.count("*").alias("df"))
           .select("slot", F.log((total + F.lit(1.0)) / (F.col("df") + F.lit(1.0))).alias("idf")))
    raw = own.join(F.broadcast(idf), "slot").select("item_id", "slot", (F.col("tf") * F.col("idf")).alias("weight"))
    packed = (raw.where("weight <> 0").groupBy("item_id")
              .agg(F.array_sort(F.collect_list(F.struct("slot", "weight"))).alias("parts")))
    length = F.sqrt(F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["weight"] * p["weight"]))
    return (packed.select("item_id", length.alias("length"), F.explode("parts").alias("part"))
            .select("item_id", F.col("part.slot").alias("slot"), (F.col("part.weight") / F.col("length")).alias("weight")))


def embed_text(items: DataFrame, dims: int = 64, corpus: DataFrame | None = None) -> DataFrame:
    """(item_id, name) -> (item_id, embedding): the default embedding, made of built-in functions."""
    weights = (text_weights(items, dims, corpus).groupBy("item_id")
               .agg(F.map_from_entries(F.collect_list(F.struct("slot", "weight"))).alias("w")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("w", i), F.lit(0.0)))
    return weights.select("item_id", dense.alias("embedding"))


def new_items(stored: DataFrame, catalogue: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None,
              dims: int = 64) -> DataFrame:
    """(item_id, embedding) of the catalogue's items that are not stored yet, each once; only these are embedded.

    `embed` maps (item_id, name) to (item_id, embedding); pass your own model here. The default weighs terms
    by their frequency in the whole catalogue, so that one new item is embedded like many. An item without
    an embedding (an empty name, or only terms that every item has) gets the zero vector of `dims`.
    """
    catalogue = catalogue.groupBy("item_id").agg(F.min("name").alias("name"))
    new = catalogue.join(stored.select("item_id"), "item_id", "left_anti")
    made = embed(new) if embed else embed_text(new, dims, corpus=catalogue)
    return new.select("item_id").join(made.select("item_id", F.col("embedding").cast("array<double>")), "item_id", "left").select(
        "item_id", F.coalesce("embedding", F.array_repeat(F.lit(0.0), dims)).alias("embedding"))


def append_items(spark: SparkSession, path: str, catalogue: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None,
                 dims: int = 64) -> None:
    """Append the catalogue's new items to a parquet store of (item_id, embedding)."""
    stored = spark.read.parquet(path)
    fresh = store(new_items(stored, catalogue, embed, dims), "new-items")
    fresh.write.mode("append").parquet(path)


def upsert_items(stored: DataFrame, catalogue: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None,
                 dims: int = 64) -> DataFrame:
    """Stored items plus the catalogue's new ones, embedded as in `new_items`."""
    fresh = new_items(stored, catalogue, embed, dims).withColumn("is_new", F.lit(True))
    old = stored.select("item_id", F.col("embedding").cast("array<double>"), F.lit(False).alias("is_new"))
    return old.unionByName(fresh)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score (to 10 places) of the k largest of each row, the smaller column first among equals.

    The k-th largest of the maxima of groups of columns is reached by k columns, so only what reaches it is rounded and sorted.
    """
    whole = scores.shape[1] // GROUP
    if whole > k and np.isfinite(scores).all():
        tops = scores[:, :whole * GROUP].reshape(len(scores), whole, GROUP).max(axis=2)
        least = np.partition(tops, whole - k, axis=1)[:, whole - k]
        row, column = np.nonzero(scores >= (least - 1e-9)[:, None])  # more than rounding moves a score
        value = np.round(scores[row, column], 10)
        order = np.lexsort((column, -value, row))
        row, column, value = row[order], column[order], value[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[kept], column[kept], value[kept]
    scores = np.round(scores, 10)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(len(best)), best.shape[1]), best.ravel(), np.take_along_axis(scores, best, axis=1).ravel()


def _block_top_k(k: int):
    def run(queries: pa.Table, items: pa.Table) -> pa.Table:
        asked_rows, found, found_scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if queries.num_rows and items.num_rows:
            items = items.sort_by("item_id")
            ids = items["item_id"].to_numpy()
            vectors, asked = _matrix(items["vector"]).T, _matrix(queries["vector"])
            step = max(1, SCORES_AT_ONCE // len(ids))
            for at in range(0, len(asked), step):
                # columns are in id order, so ties end as in the final ranking
                row, column, score = _best(asked[at:at + step] @ vectors, k)
                asked_rows.append(row + at)
                found.append(ids[column])
                found_scores.append(score)
        return pa.table({"query_id": queries["query_id"].take(pa.array(np.concatenate(asked_rows))),
                         "item_id": pa.array(np.concatenate(found)),
                         "score": pa.array(np.concatenate(found_scores))})
    return run


def search_items_vector(queries: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The k items nearest by cosine for each query (query_id, vector): exact, by blocks.

    Queries and items are hashed into blocks; each pair of blocks is one task that multiplies two
    matrices and keeps k per query, so scores are never rows. Block sizes follow from the vector
    length and a byte bound. Ranked by score, then item id; vectors of length 0 match nothing.
    """
    asked = queries.select("query_id", fx.unit(F.col("vector")).alias("vector")).where("vector is not null")
    stock = items.select("item_id", fx.unit(F.col("embedding")).alias("vector")).where("vector is not null")

    n_items, width = items.agg(F.count("*"), F.max(F.size("embedding"))).first()
    n_queries = queries.count()
    per_block = max(1024, BLOCK_BYTES // (8 * max(width or 1, 1)))
    item_blocks = max(1, math.ceil(n_items / per_block))
    spread = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    query_blocks = max(1, math.ceil(n_queries / per_block),
                       min(math.ceil(spread / item_blocks), math.ceil(n_queries / 128)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.withColumn("qb", own("query_id", query_blocks)).withColumn("ib", every(item_blocks))
    right = stock.withColumn("ib", own("item_id", item_blocks)).withColumn("qb", every(query_blocks))
    id_type = queries.schema["query_id"].dataType.simpleString()
    best = (left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib"))
            .applyInArrow(_block_top_k(k), f"query_id {id_type}, item_id bigint, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def item_knn(items: DataFrame, k: int = 21, drop_exact: bool = False) -> DataFrame:
    """Similar items: the k nearest of each item without the item itself, score to 2 places.

    drop_exact leaves out every score of 1.0, true copies included.
    """
    queries = items.select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = (search_items_vector(queries, items, k).where("query_id <> item_id")
            .select(F.col("query_id").alias("item_id"), F.col("item_id").alias("item_rec"),
                    fx.round_to(F.col("score"), 2).alias("score")))
    return near.where(F.col("score") != 1.0) if drop_exact else near


def search_items_text(queries: DataFrame, items: DataFrame, k: int = 3) -> DataFrame:
    """The k items whose name holds every word of the query (content): whole words, no stemming.

    Scored by the share of the name's words that were asked for; the smaller id wins a tie. Equal
    queries and equal names are looked up once. A query is matched through its rarest word only.
    """
    asked = (queries.select("content").distinct()
             .withColumn("asked", F.array_distinct(tx.terms(F.col("content")))).where(F.size("asked") > 0))
    first_ids = Window.partitionBy("name").orderBy("item_id")
    of_name = (items.select("name", "item_id").withColumn("nth", F.row_number().over(first_ids))
               .where(F.col("nth") <= k))
    names = items.select("name").distinct().withColumn("words", tx.terms(F.col("name")))
    postings = names.withColumn("word", F.explode(F.array_distinct("words")))
    frequency = postings.groupBy("word").agg(F.count("*").alias("df"))
    rarest = (asked.withColumn("word", F.explode("asked")).join(frequency, "word")
              .groupBy("content", "asked").agg(F.min_by("word", F.struct("df", "word")).alias("word")))
    share = (F.size(F.filter("words", lambda w: F.array_contains("asked", w))) / F.size("words"))
    found = (rarest.join(postings, "word").where(F.size(F.array_except("asked", "words")) == 0)
             .select("content", "name", F.round(share, 6).alias("score")))
    order = Window.partitionBy("content").orderBy(F.desc("score"), "item_id")
    return (found.join(of_name, "name").withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("content", "item_id", "name", "score", "rank"))
