"""Edge, walk and id-map sources, and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import vectors
from flowloom.sources.flows import ROW_NUMBER, first_rows, with_file_row_number


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Causal edges from a file or a folder of parts; `relation_type=...` folders become a column.

    Parquet wins when a folder holds both kinds.
    """
    parquet = spark.read.option("recursiveFileLookup", False)
    if path.lower().endswith(".csv"):
        return _edges_csv(spark, path)
    try:
        found = parquet.option("pathGlobFilter", "*.parquet").parquet(path)
    except Exception as error:  # no parquet part below the folder
        if "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return _edges_csv(spark, path)
    return found


def _edges_csv(spark: SparkSession, path: str) -> DataFrame:
    edges = spark.read.option("pathGlobFilter", "*.csv").csv(path, header=True)
    return edges.select(
        *[
            F.col(c).cast({"relation_priority": "bigint", "delta_seconds": "bigint", "same_timestamp": "boolean"}.get(c, "string")).alias(c)
            for c in edges.columns
        ]
    )


def read_walks(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """One row per non-blank line, `tokens` split at white space."""
    lines = spark.read.text(path)
    if max_lines is not None:
        lines = first_rows(with_file_row_number(lines), max_lines).drop(ROW_NUMBER)
    return split_walk_lines(lines)


def split_walk_lines(lines: DataFrame) -> DataFrame:
    body = F.trim(F.regexp_replace("value", r"\s+", " "))
    return lines.select(body.alias("line")).filter("line <> ''").select(F.split("line", " ").alias("tokens"))


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """`vid,token` text columns; run `operators.checks.check_id_map` on it."""
    header = spark.read.option("header", True).csv(path).columns
    if header != ["vid", "token"]:
        raise ValueError(f"id map must have the header vid,token and has {header}")
    return spark.read.csv(path, header=True, schema="vid string, token string").na.fill("")


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Fixed column order, a missing value becomes the empty string."""
    text_columns = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")).alias(f) for f in fields]
    df.select(*text_columns).write.mode("overwrite").option("emptyValue", "").option("escape", '"').csv(path, header=True)


def write_parquet(df: DataFrame, path: str, codec: str = "snappy") -> None:
    df.write.mode("overwrite").option("compression", codec).parquet(path)


def write_edges(edges: DataFrame, path: str, chunk_size: int = 1_000_000, fmt: str = "parquet") -> None:
    """Causal edges in one folder per relation, at most `chunk_size` rows a part."""
    writer = edges.write.mode("overwrite").partitionBy("relation_type").option("maxRecordsPerFile", chunk_size)
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.parquet(path)


def expand_array(df: DataFrame, column: str, prefix: str, n: int) -> DataFrame:
    """Replace an array column by n numbered columns, for a wide feature sink."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, *vectors.indexed_columns(column, prefix, n))
