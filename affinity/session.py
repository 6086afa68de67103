"""Session helpers: cutting lineage and telling sizes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one named in ``spark.checkpoint.dir`` or set for the session. Only where neither is and all
    executors are on this machine, as in tests, a temporary folder is made and set.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="affinity-"))
    return context.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it without its lineage.

    A written table is computed once, is stored by column and outlives any executor. It is
    removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/affinity-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession, factor: int = 1) -> int:
    """Number of partitions for an explicit shuffle ahead of a Python stage."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * factor)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it comes in fewer parts than there are cores, as a single small file does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
