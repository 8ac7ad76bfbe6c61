"""Deterministic keys, splits and draws: the same row gets the same value on any cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRAIN, VALID, TEST = "train", "valid", "test"


def record_id_from_row(row_number: Column) -> Column:
    return F.format_string("rec_%010d", row_number)


def stable_record_id(given: Column, row_number: Column) -> Column:
    return F.coalesce(F.nullif(given, F.lit("")), record_id_from_row(row_number))


def record_ordinal(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"rec_(\d+)", 1).try_cast("bigint")


def edge_hash(*parts: Column) -> Column:
    """sha1 hex of the parts joined by a pipe."""
    return F.sha1(F.concat_ws("|", *parts))


def hex_number(digits: Column) -> Column:
    return F.conv(digits, 16, 10)


def draw_int(*parts: Column) -> Column:
    """BIGINT in [0, 2^32) out of the md5 of the parts."""
    return hex_number(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8)).cast("bigint")


def draw(*parts: Column) -> Column:
    """DOUBLE in [0, 1)."""
    return draw_int(*parts).cast("double") / F.lit(4294967296.0)


def split_position(record_id: Column, target: Column, seed: int) -> Column:
    """First eight sha1 bytes of `seed|target|record_id` as a fraction of 2^64."""
    digest = F.sha1(F.concat_ws("|", F.lit(str(seed)), target, record_id))
    return hex_number(F.substring(digest, 1, 16)).cast("double") / F.lit(18446744073709551616.0)


def split_of(
    record_id: Column, target: Column, seed: int, valid_share: float = 0.1, test_share: float = 0.2
) -> Column:
    position = split_position(record_id, target, seed)
    return (
        F.when(position < test_share, TEST).when(position < test_share + valid_share, VALID).otherwise(TRAIN)
    )


def fold_of(record_id: Column, seed: int, folds: int = 5) -> Column:
    return (draw_int(F.lit(seed), record_id) % folds).cast("int")
