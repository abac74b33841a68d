"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this package wants. Sizes that depend on the cluster
#: (shuffle partitions, executor memory) stay with whoever submits the job.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Tables stored by profile are joined by profile and date as they lie (``store_bucketed``).
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}

def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench. Clusters bring their own.

    Its checkpoint folder is temporary unless one is given; nothing else in the package makes one.
    """
    conf.setdefault("spark.checkpoint.dir", tempfile.mkdtemp(prefix="conversion-engine-"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("conversion-engine")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Without this every column expression looks up its line in the caller.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def run_folder(spark: SparkSession) -> str:
    """The application's folder for written intermediates, below the one that ``spark.checkpoint.dir`` names.

    It goes when the application ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = f"{root.rstrip('/')}/conversion_engine/{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For relations that several later branches read. The written table cuts the
    lineage, survives the loss of any executor, and gives the readers column
    pruning and a size the planner can check before it broadcasts.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` once in buckets by ``key`` and read it back, so that later joins and groups by the key move no rows.

    Tables meant for each other need keys of one type and the same number of ``buckets`` (by default the session's
    shuffle partitions). The table's files lie in the application's folder; its name is in the session's catalog.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(count, key).write.option("path", f"{run_folder(spark)}/{table}")
    writer.bucketBy(count, key).sortBy(key).saveAsTable(table)
    return spark.table(table)
