"""JDBC tables. Address, credentials and driver always come from the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred import schemas


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict, column: str | None = None,
              lower=None, upper=None, partitions: int | None = None) -> DataFrame:
    """A table, read in parallel ranges of `column` when its bounds are given."""
    if column is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties)


def read_ratings_jdbc(spark: SparkSession, url: str, table: str, properties: dict, names: dict | None = None,
                      **ranges) -> DataFrame:
    """Ratings from a table; `names` maps its column names to ours."""
    found = read_jdbc(spark, url, table, properties, **ranges)
    return schemas.conform(found.withColumnsRenamed(names or {"timestamp": "ts"}), schemas.RATINGS)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict, mode: str = "append", truncate: bool = False,
               batch_rows: int = 10_000, connections: int = 32) -> None:
    """Append rows, or replace them (mode='overwrite'; truncate keeps the table's definition).

    The number of writing tasks is limited to what a database takes as connections; what made the rows is not.
    """
    (df.repartition(connections).write.option("batchsize", batch_rows).option("truncate", str(truncate).lower())
     .jdbc(url, table, mode=mode, properties=properties))
