"""The corpus pipeline: language ID, near duplicates by n-gram Jaccard join, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` applies them to `documents`, each
written as Parquet below spark.checkpoint.dir and read again for the next. All stages but the
last return the columns of `documents`, and any others that `docs` has. When a stage begins, the work
folders of the stages before it are removed: write their results first.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import langid, ngram_join, packing, secret_scan
from kindred.llm.session import mark_likely, prepare
from kindred.session import discard, folders_made, store

MASK = "[SECRET]"


STAGES = []
_scratch: dict[str, list[str]] = {}


def stage(function):
    """Register a stage under the function's name; its call removes what the stages before it left in work folders."""
    name, earlier = function.__name__, [n for n, _ in STAGES]

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        there = set(folders_made())
        discard(spark, [f for n in earlier for f in _scratch.pop(n, []) if f in there])
        before = set(folders_made())
        try:
            return function(spark, docs, sf_dir)
        finally:
            _scratch.setdefault(name, []).extend(f for f in folders_made() if f not in before)
    STAGES.append((name, run))
    return run


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that have a language; those it rejects (`und`: null text or no letters) go.

    The machines learn from the labelled documents of `docs` that are not held out. lang becomes the prediction.
    """
    return langid.accepted(docs, langid.fit(docs.where(~langid.held_out())))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with five-word Jaccard 0.8 or more, one row stays: the smallest doc_id, rows without last.

    A doc_id with a text is one document, however many rows repeat it, and so is a text without doc_id; other texts under
    the same doc_id are judged by themselves. Rows without words link with nothing and all stay. Documents are
    told apart by a 64-bit hash of doc_id and text; two share a key with probability 2^-64. Very long texts are compared
    whole. An empty table gives no rows.
    """
    # The document is carried whole in one column, whatever names its columns have.
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("bigint").alias("named"))
    linked = ngram_join.ngram_join(rows.select(F.col("key").alias("doc_id"), F.col("doc.text").alias("text"))).where("n_links > 0")
    linked = store(linked.select(F.col("doc_id").alias("key"), "component_id").distinct(), "linked")
    first = F.min(F.struct(F.col("named").isNull().alias("unnamed"), "named", "key"))
    stay = rows.select("key", "named").join(linked, "key").groupBy("component_id").agg(first.alias("first")).select("first.key", F.lit(True).alias("stays"))
    judged = store(linked.select("key").join(stay, "key", "left").withColumn("stays", F.coalesce("stays", F.lit(False))), "judged")
    # Only rows that may be linked meet the list; of those that stay, repeated ones merge.
    marked = mark_likely(rows.drop("named"), judged, "key", "likely")
    met = marked.where("likely").join(judged, "key", "left")
    alone = marked.where("not likely").select("doc").unionAll(met.where("stays is null").select("doc"))
    kept = met.where("stays").groupBy("key").agg(F.first("doc").alias("doc")).select("doc")
    return alone.unionAll(kept).select("doc.*")


@stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace the secrets found in each text by a mask, private keys whole; n_chars follows. Texts without any are unchanged.

    Every row stays, repeated ones too; null and empty texts hold no secrets and stay as they are; very long texts are
    scanned whole; rows without doc_id are rows like others. An empty table gives no rows.
    """
    _, findings, _ = secret_scan.scan(docs, secret_scan.MASKED)
    found = findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    text = F.coalesce("doc.text", F.lit(""))
    masked = F.aggregate(
        "spans", F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("at")),
        lambda done, s: F.when(s["end"] <= done["at"], done).otherwise(F.struct(
            F.concat(done["text"], F.when(s["start"] >= done["at"], F.concat(F.substr(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")),
                                                                             F.lit(MASK))).otherwise(F.lit(""))).alias("text"),
            s["end"].alias("at"))),
        lambda done: F.concat(done["text"], F.substr(text, (done["at"] + 1).cast("int"), F.length(text))))
    # The document is carried whole in one column, whatever names its columns have.
    rows = docs.select(F.struct("*").alias("doc"), secret_scan.blob_of(F.col("text")).alias("blob")).join(found, "blob", "left")
    new = F.when(F.col("spans").isNotNull(), masked).otherwise(F.col("doc.text"))
    rows = rows.withColumn("new", new)
    changed = {"text": F.col("new"), "n_chars": F.when(F.col("spans").isNotNull(), F.length("new").cast("bigint")).otherwise(F.col("doc.n_chars"))
               if "n_chars" in docs.columns else None}
    return rows.select(*[(changed[c] if c in changed else F.col("doc")[c]).alias(c) for c in docs.columns])


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in sequences of 2048 tokens.

    Null and empty texts are a piece of one id, repeated rows and rows without doc_id are packed like others, very long
    texts are cut into pieces. Other columns are left out. An empty table gives no rows.
    """
    return packing.pack_documents(docs)


# No stage's whole result can be said in SQL: learned machines, a component search, and tokens of a library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = store(function(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
