"""Text search over several fields through a stored inverted index.

The index is a folder of tables that the asked words alone are read from:

    postings/slot=<s>: word, field, part, item_id, times, n_words: a row per different word of a field of an item, sorted by word
    terms/slot=<s>: word, field, df (items that hold it), parts
    layout: the number of slots

A word lies in the slot of its hash. A word that very many items hold is cut by item into parts of about PART_ROWS, so its
postings are several groups wherever they are joined. A query meets the postings of its rarest word in a field; the other
words are looked up for the items found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions import text as tx
from kindred.session import store

PART_ROWS = 100_000


def _slot(slots: int):
    return F.pmod(F.xxhash64("word"), F.lit(slots)).cast("int")


def _part(parts):
    return F.pmod(F.xxhash64("item_id", F.lit(5)), parts)


def build_index(items: DataFrame, path: str, fields: tuple[str, ...] = ("name", "summary"), slots: int = 16, part_rows: int = PART_ROWS) -> None:
    """Write the index of some text columns of `items` (item_id, one row each); null texts hold no words."""
    texts = items.select("item_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tx.terms(F.col(f)).alias("words")) for f in fields])).alias("t"))
    words = texts.select("item_id", "t.field", F.size("t.words").alias("n_words"), F.explode("t.words").alias("word"))
    postings = store(words.groupBy("word", "field", "item_id", "n_words").agg(F.count("*").alias("times")).withColumn("slot", _slot(slots)), "postings")
    terms = postings.groupBy("slot", "word", "field").agg(F.count("*").alias("df")).withColumn("parts", F.ceil(F.col("df") / part_rows))
    terms = store(terms, "terms")
    cut = terms.where("parts > 1").select("word", "field", "parts")
    postings = postings.join(cut, ["word", "field"], "left").withColumn("part", _part(F.coalesce("parts", F.lit(1)))).drop("parts")
    # A slot is written by as many tasks as its rows need; a word's part stays in one file.
    piece = F.pmod(F.xxhash64("word", "part"), F.greatest(F.lit(1), F.ceil(F.lit(postings.count()) / F.lit(slots * 10 * part_rows))))
    (postings.repartition("slot", piece).sortWithinPartitions("slot", "word", "field", "part")
     .write.mode("overwrite").partitionBy("slot").parquet(f"{path}/postings"))
    terms.repartition("slot").sortWithinPartitions("slot", "word").write.mode("overwrite").partitionBy("slot").parquet(f"{path}/terms")
    items.sparkSession.createDataFrame([(slots,)], "slots int").write.mode("overwrite").parquet(f"{path}/layout")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 3) -> DataFrame:
    """content, item_id, field, score, rank: the k items one of whose fields holds every word of a query (content).

    Whole words, no stemming. An item's score is the share of the field's words that were asked for, in its best field (ties:
    the first by name); the smaller id wins a tie of items. Equal queries are looked up once; one without words finds nothing.
    Only the slots of asked words are read; their numbers reach the driver.
    """
    asked = store(queries.select("content").distinct().withColumn("word", F.explode(F.array_distinct(tx.terms(F.col("content"))))), "asked")
    slots = spark.read.parquet(f"{path}/layout").first()["slots"]
    wanted = [r["slot"] for r in asked.select(_slot(slots).alias("slot")).distinct().collect()]
    words = asked.select("word").distinct()
    read = lambda table: spark.read.parquet(f"{path}/{table}").where(F.col("slot").isin(wanted)).drop("slot").join(words, "word", "left_semi")
    terms, postings = read("terms"), read("postings")
    sizes = asked.groupBy("content").agg(F.count("*").alias("n_asked"))
    # Per query and field in which every word occurs at all: the rarest word, met in each of its parts.
    met = asked.join(terms, "word").groupBy("content", "field").agg(
        F.count("*").alias("n"), F.min(F.struct("df", "word", "parts")).alias("rarest")).join(sizes, "content").where("n = n_asked")
    met = store(met.select("content", "field", "n_asked", "rarest.word", "rarest.parts"), "rarest")
    first = (met.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
             .join(postings, ["word", "field", "part"]))
    alone = first.where("n_asked = 1").select("content", "field", "item_id", F.col("times").alias("hits"), "n_words")
    # The other words, looked up for the items found, in the part these lie in.
    others = asked.join(met.select("content", "field", F.col("word").alias("rarest")), "content").where("word != rarest").join(terms.drop("df"), ["word", "field"])
    several = (first.where("n_asked > 1").select("content", "field", "item_id", "n_asked", "n_words", F.col("times").alias("hits"))
               .join(others, ["content", "field"]).withColumn("part", _part(F.col("parts")))
               .join(postings.select("word", "field", "part", "item_id", "times"), ["word", "field", "part", "item_id"])
               .groupBy("content", "field", "item_id", "n_asked", "n_words", "hits").agg(F.count("*").alias("n"), F.sum("times").alias("more"))
               .where("n = n_asked - 1").select("content", "field", "item_id", (F.col("hits") + F.col("more")).alias("hits"), "n_words"))
    score = F.round(F.col("hits") / F.col("n_words"), 6)
    best = (alone.unionByName(several).withColumn("score", score).groupBy("content", "item_id")
            .agg(F.min(F.struct((-F.col("score")).alias("below"), "field")).alias("b")).select("content", "item_id", "b.field", (-F.col("b.below")).alias("score")))
    order = Window.partitionBy("content").orderBy(F.desc("score"), "item_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
