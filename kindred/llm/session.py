"""Settings of this package's jobs, and a filter of bounded size for rows that a join will keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import session

# Texts are large rows: small Arrow batches keep Python workers small.
ARROW_ROWS = "1000"
FILTER_BITS = 1 << 25


def prepare(spark: SparkSession) -> SparkSession:
    """The library's runtime settings, and Arrow batches of few rows; safe to call repeatedly."""
    session.prepare(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def mark_likely(rows: DataFrame, wanted: DataFrame, key: str, mark: str) -> DataFrame:
    """`rows` with a boolean `mark`: true where `key` (long) is in `wanted`, and by chance on some other rows.

    Rows without the mark need no join with `wanted`, so that join shuffles less. Keys are hashed to FILTER_BITS bits, in rows of
    4 KB that are broadcast (4 MB in all, whatever the number of keys). `wanted` is read once more; store it before. No Python: in one
    stage with a Python function it would double the workers of each executor, which stay.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    maps = (wanted.where(F.col(key).isNotNull()).select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias(f"_{mark}_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias(f"_{mark}_bits")))
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col(f"_{mark}_bits"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.col(key).isNotNull() & (F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return (rows.join(F.broadcast(maps), F.bitmap_bucket_number(slot) == F.col(f"_{mark}_bucket"), "left")
            .select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(mark)))


def keep_likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """`rows` without most of those whose `key` (long) is not in `wanted`; all with a wanted key stay (see `mark_likely`)."""
    return mark_likely(rows, wanted, key, "_likely").where("_likely").drop("_likely")
