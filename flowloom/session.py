"""Session settings and lineage cutting."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "flowloom", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster bring your own and call `prepare`."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on; all of them can be changed at run time.

    Epochs and hours are read in UTC.  Adaptive execution coalesces small shuffle
    partitions, picks broadcast joins from measured sizes and splits skewed ones.  Few rows
    can mean much work here (a walk step, a list of neighbours), so partitions are merged
    only while cores stay busy.  The JVM
    does not compile methods above 8000 bytes of bytecode: a wide projection runs faster
    in split methods than fused into one interpreted loop.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Where none is set, a temporary one, but only in local mode: other machines would not see it.
    """
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="flowloom-")
    return _local_folder


_local_folder: str | None = None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once as a parquet table in the shared folder and continue from that table.

    Later readers prune its columns, and a lost executor costs a re-read, not a re-run.
    """
    path = f"{shared_folder(df.sparkSession)}/flowloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_steps(blocks: int, step: Callable[[int, int], DataFrame], width: int) -> DataFrame:
    """What `step(first block, last block)` gives for all blocks, `width` at a time, written step by step into one table."""
    for low in range(0, blocks, width):
        found = step(low, min(low + width, blocks) - 1)
        if not low:
            path = f"{shared_folder(found.sparkSession)}/flowloom/{uuid.uuid4().hex}"
        found.write.mode("append").parquet(path)
        spark, schema = found.sparkSession, found.schema
        if low + width < blocks:
            found = None
            release_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that are over, which it does once the driver's plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_stored(df: DataFrame) -> None:
    """Delete a table that `cut_lineage` wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        assert re.search("/flowloom/[0-9a-f]{32}$", folder), folder
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def checkpoint_layout(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, which unlike a written table keeps the hash partitioning.

    For the fixed side of a join that is repeated many times.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
