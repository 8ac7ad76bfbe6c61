"""Small helpers of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import arrays


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """`f` over every Arrow batch that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)
        arrays.release()

    return df.mapInArrow(run, schema)


def hash_threshold(rows: int, wanted: int) -> int:
    """Rows whose 31-bit hash is below it are about `wanted` of `rows`."""
    return 2**31 if rows <= wanted else int(2**31 * wanted / rows)


def hash31(*columns: Column) -> Column:
    return F.xxhash64(*columns).bitwiseAND(F.lit(2**31 - 1))


def fresh(columns: list[str], name: str) -> str:
    """`name`, with underscores in front until no column has it, upper or lower case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ddl(df: DataFrame, columns: list[str]) -> str:
    """Schema text of some columns of a frame."""
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)
