"""Tables that are replaced as a whole: readers see the old rows or the new ones, never a part.

Every write goes to a folder of its own.  Only when all its files are there, a row is added to
the table's manifest; readers take the folder of the newest row.  A write that fails, or
is cut off, leaves a folder that no manifest names.  Nothing is renamed or deleted, so this holds on
stores without an atomic rename, and a reader that has begun keeps its files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "_manifest"
_ROW = "version long, folder string, rows long, schema string"


class NotPublished(LookupError):
    """No complete version of the table is there."""


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """`version`, `folder`, `rows`, `schema` of every complete version; empty where there is none."""
    try:
        return spark.read.schema(_ROW).json(f"{path}/{MANIFEST}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _ROW)


def publish(df: DataFrame, path: str, codec: str = "snappy", partition_by: list[str] | None = None) -> int:
    """Writes the next version of the table and returns its number, from 1 on.

    One writer at a time: of two at once, both write whole tables, and the one whose folder
    sorts last is read.
    """
    spark = df.sparkSession
    latest = manifest(spark, path).agg(F.max("version").alias("v")).first().v or 0
    folder = uuid.uuid4().hex
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/{folder}")
    rows = spark.read.schema(df.schema).parquet(f"{path}/{folder}").count()
    entry = spark.createDataFrame([(latest + 1, folder, rows, df.schema.json())], _ROW)
    entry.coalesce(1).write.mode("append").json(f"{path}/{MANIFEST}")
    return latest + 1


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest complete version, or the one asked for."""
    found = manifest(spark, path)
    if version is not None:
        found = found.filter(F.col("version") == version)
    row = found.orderBy(F.desc("version"), F.desc("folder")).first()
    if row is None:
        raise NotPublished(f"{path} has no complete version{'' if version is None else f' {version}'}")
    return spark.read.schema(StructType.fromJson(json.loads(row.schema))).parquet(f"{path}/{row.folder}")
