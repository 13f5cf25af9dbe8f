"""Session settings, reliable checkpoints and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a side may have before it is no longer broadcast (a few tens of MB as hashed longs/doubles).
BROADCAST_ROWS = 500_000

RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even if an aggregate on the same key must then be shuffled again.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Lets a join on (tile, item) run on data already partitioned by tile alone.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def get_spark(app: str = "kindred", master: str | None = None, shuffle_partitions: int | None = None,
              driver_memory: str | None = None) -> SparkSession:
    """A session for scripts and tests; on a cluster the submitted configuration decides."""
    builder = (SparkSession.builder.appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on; safe to call repeatedly."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="kindred-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


_made = {"folders": [], "tables": []}


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    _made["folders"].append(f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made["folders"][-1]


def folders_made() -> list[str]:
    """The work folders this process made and did not remove."""
    return list(_made["folders"])


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Remove some of the work folders; results that still read them are lost."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _made["folders"].remove(folder)


def release(spark: SparkSession) -> None:
    """Remove the work folders and tables this process made; results that still read them are lost.

    Call it when a job's results are written.
    """
    for table in _made["tables"]:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    _made["tables"].clear()
    discard(spark, folders_made())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise on the shared folder so loops keep short plans and survive lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a relation that several steps read as a table on the shared folder, and read it back.

    Later plans start at a compressed, column-pruned scan of known size.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, name: str, *columns: str, folders: list[str] | None = None, dealt: bool = False,
                   buckets: int | None = None) -> DataFrame:
    """Store a relation bucketed by columns: later joins and aggregates on them do not shuffle it.

    There are as many buckets as shuffle partitions if `buckets` does not say, one file each (in each folder of the columns `folders`). `dealt`: the rows come
    from a join or an aggregate by these columns and need not be dealt again.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"kindred_{name}_{uuid.uuid4().hex}"
    _made["tables"].append(table)
    writer = (df if dealt else df.repartition(buckets, *columns)).write.bucketBy(buckets, *columns)
    if folders:
        writer = writer.partitionBy(*folders)
    writer.option("path", work_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when a bounded count shows it is small; otherwise Spark joins by shuffle.

    The count reads at most max_rows + 1 rows, so use it on materialised or cheap inputs.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
