"""Parsing of text fields as they come out of a flow CSV."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's parser takes a type suffix ("1d") and hex floats; flow files do not mean
# numbers by those.  "inf", "nan" and "infinity" have an n before any d, f or x.
_JAVA_ONLY_NUMBER = r"(?i)^[^n]*[dfx]"


def first_present(*columns: Column) -> Column:
    """First value that is neither NULL nor the empty string, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def plain_number(text: Column) -> Column:
    """DOUBLE value of a text, NULL when it is empty or not a number; digits are not grouped."""
    text = text.cast("string")
    return F.when(~text.rlike(_JAVA_ONLY_NUMBER), text.try_cast("double"))


def try_number(text: Column) -> Column:
    """The same, where an underscore between two digits groups them."""
    text = text.cast("string")
    ungrouped = F.regexp_replace(text, "(?<=[0-9])_(?=[0-9])", "")
    return F.coalesce(plain_number(text), F.when(text.contains("_"), plain_number(ungrouped)))


def parse_int(text: Column, default: int = 0) -> Column:
    """BIGINT of a decimal text, truncated towards zero; junk, NaN and infinity give the default."""
    return F.coalesce(try_number(text).try_cast("bigint"), F.lit(default).cast("bigint"))


def parse_float(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(try_number(text), F.lit(float(default)))


def finite_number(text: Column) -> Column:
    """Coerced FLOAT feature: junk, grouped digits, NaN and both infinities become 0."""
    value = plain_number(text)
    # NaN is larger than infinity here.
    return F.when(F.abs(value) < F.lit(float("inf")), value).otherwise(F.lit(0.0)).cast("float")


def parse_timestamp(text: Column) -> tuple[Column, Column]:
    """(ISO text, epoch seconds) of `26/04/201711:11:17` or `26/04/2017 11:11:17`.

    Day, month, hour, minute and second may have one digit.

    A text that fits neither format is passed through with epoch 0.
    """
    spaced = F.regexp_replace(text, r"^(\d{1,2}/\d{1,2}/\d{4})(?=\d)", "$1 ")
    # Two-digit hours without a space are the rule; only other texts are rewritten.
    moment = F.coalesce(F.try_to_timestamp(text, F.lit("d/M/yyyyHH:mm:ss")), F.try_to_timestamp(spaced, F.lit("d/M/yyyy H:m:s")))
    iso = F.coalesce(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), text, F.lit(""))
    return iso, F.coalesce(F.unix_timestamp(moment), F.lit(0).cast("bigint"))


def epoch_text(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss")


def hour_of(epoch: Column) -> Column:
    """UTC hour, 0 for an unknown (0) epoch."""
    return F.when(epoch == 0, F.lit(0)).otherwise(F.hour(F.timestamp_seconds(epoch)))


def weekday_of(epoch: Column) -> Column:
    """Monday = 0, 0 for an unknown (0) epoch."""
    return F.when(epoch == 0, F.lit(0)).otherwise(F.weekday(F.timestamp_seconds(epoch)))


def raw_feature_name(column: str) -> str:
    """`Flow.Bytes.s` -> `raw_flow_bytes_s`."""
    words = "".join(ch.lower() if ch.isalnum() else " " for ch in column).split()
    return "raw_" + "_".join(words)
