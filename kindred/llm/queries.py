"""One query per operator over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import byte_bpe, divergence, fingerprints, langid, ngram_join, packing, periodic, pii, secret_scan, token_count, url_filter, vector_index, warc
from kindred.llm.session import prepare

QUERIES = {}


def query(function):
    """Register under the function's name; the session settings are applied before it runs."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepare(spark), sf_dir)
    QUERIES[function.__name__] = run
    return run


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_jaccard_join(spark, d):
    return ngram_join.ngram_join(_table(spark, d, "documents"), size=3, percent=90)


@query
def op2_best_fit_packing(spark, d):
    return packing.pack_documents(_table(spark, d, "documents"))


@query
def op3_language_id(spark, d):
    return langid.language_id(_table(spark, d, "documents"))


@query
def op4_document_fingerprints(spark, d):
    return fingerprints.edited_fingerprints(_table(spark, d, "documents"))


@query
def op5_secret_scan(spark, d):
    return secret_scan.secret_scan(_table(spark, d, "documents"))


@query
def op6_byte_bpe(spark, d):
    return byte_bpe.digests(_table(spark, d, "documents"))


@query
def op7_url_filter(spark, d):
    return url_filter.judge(_table(spark, d, "pages"))


@query
def op8_nearest_vectors(spark, d):
    vectors = _table(spark, d, "embeddings")
    return vector_index.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op9_warc(spark, d):
    return warc.archive(_table(spark, d, "pages"))


@query
def op10_token_counts(spark, d):
    return token_count.token_counts(_table(spark, d, "documents"))


@query
def op11_periodic_runs(spark, d):
    return periodic.run_digests(periodic.periodic_runs(periodic.repeating_tails(_table(spark, d, "documents"))))


@query
def op12_personal_data(spark, d):
    return pii.report(pii.personal_data(_table(spark, d, "documents")))


@query
def op13_source_divergence(spark, d):
    return divergence.divergence(_table(spark, d, "documents"))
