"""Data checks.  Each returns rows (`check`, `ok`, `value`); `value` is what was measured."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.hashing import TEST, TRAIN, VALID
from flowloom.operators import features
from flowloom.schema import FEATURE_META, RELATION_PRIORITY

# Expected shares of the splits and how far off they may be.
EXPECTED_SHARES = {TRAIN: 0.7, VALID: 0.1, TEST: 0.2}
SHARE_TOLERANCE = 0.05


def _rows(stats: DataFrame, tests: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One-row statistics to one row per check."""
    items = [
        F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), value.cast("double").alias("value"))
        for name, (ok, value) in tests.items()
    ]
    return stats.select(F.inline(F.array(*items)))


def _zero(column: str) -> tuple[Column, Column]:
    return F.col(column) == 0, F.col(column)


def _known(spark, name: str, ok: bool, value: float) -> DataFrame:
    """A check on column names alone."""
    return spark.range(1).select(F.lit(name).alias("check"), F.lit(ok).alias("ok"), F.lit(float(value)).alias("value"))


def failed(checks: DataFrame) -> DataFrame:
    return checks.filter("NOT ok")


def _duplicates(df: DataFrame, key: str) -> DataFrame:
    """Number of rows beyond the first of each key."""
    return df.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def check_graph(
    flows: DataFrame,
    causes: DataFrame,
    endpoints: DataFrame,
    communicates: DataFrame,
    windows: dict[str, int | None],
) -> DataFrame:
    """Unique ids, no self loop, no dangling end, consistent priority, delay and totals."""
    late = F.lit(False)
    wrong_priority = F.lit(False)
    for relation, priority in RELATION_PRIORITY.items():
        of_type = F.col("relation_type") == relation
        wrong_priority = wrong_priority | (of_type & (F.col("relation_priority") != priority))
        if windows[relation] is not None:
            late = late | (of_type & (F.col("delta_seconds") > windows[relation]))
    edge_stats = causes.agg(
        F.count_if(F.expr("src_record_id = dst_record_id")).alias("self_loops"),
        F.count_if(~F.col("relation_type").isin(list(RELATION_PRIORITY))).alias("unknown_type"),
        F.count_if(wrong_priority).alias("priority"),
        F.count_if(late | (F.col("delta_seconds") < 0)).alias("delay"),
        F.count_if(F.expr("same_timestamp <> (delta_seconds = 0)")).alias("tie_flag"),
    )
    edge_checks = _rows(
        edge_stats,
        {
            "no_self_loop": _zero("self_loops"),
            "relation_type_known": _zero("unknown_type"),
            "priority_matches_type": _zero("priority"),
            "delta_within_window": _zero("delay"),
            "same_timestamp_flag": _zero("tie_flag"),
        },
    )
    totals = communicates.agg(
        F.count_if(F.expr("total_packets <> total_fwd_packets + total_bwd_packets OR total_bytes <> total_fwd_bytes + total_bwd_bytes")).alias("n")
    )
    ends = causes.select(F.explode(F.array("src_record_id", "dst_record_id")).alias("record_id")).distinct()
    hosts = communicates.select(F.explode(F.array("src_endpoint", "dst_endpoint")).alias("endpoint_id")).distinct()
    counted = {
        "record_id_unique": _duplicates(flows, "record_id"),
        "relation_id_unique": _duplicates(causes, "relation_id"),
        "endpoint_id_unique": _duplicates(endpoints, "endpoint_id"),
        "edge_id_unique": _duplicates(communicates, "edge_id"),
        "totals_add_up": totals,
        "no_dangling_flow": ends.join(flows.select("record_id"), "record_id", "left_anti").agg(F.count(F.lit(1)).alias("n")),
        "no_dangling_endpoint": hosts.join(endpoints.select("endpoint_id"), "endpoint_id", "left_anti").agg(
            F.count(F.lit(1)).alias("n")
        ),
    }
    return reduce(DataFrame.unionAll, [edge_checks, *[_rows(df, {name: _zero("n")}) for name, df in counted.items()]])


def _meta_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on either side without a partner, and partners whose target or split differ."""
    other = right.select("record_id", F.col("target").alias("target2"), F.col("split").alias("split2"), F.lit(1).alias("r"))
    both = left.select("record_id", "target", "split", F.lit(1).alias("l")).join(other, "record_id", "full")
    return both.agg(
        F.count_if(F.expr("l IS NULL OR r IS NULL")).alias("ids"),
        F.count_if(F.expr("target IS DISTINCT FROM target2")).alias("targets"),
        F.count_if(F.expr("split IS DISTINCT FROM split2")).alias("splits"),
    )


def _table_stats(df: DataFrame) -> DataFrame:
    nan, inf = features.numeric_quality(df)
    shares = [F.count_if(F.col("split") == s).alias(s) for s in EXPECTED_SHARES]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.expr("coalesce(target, '') = ''")).alias("no_target"),
        F.count_if(F.expr("coalesce(split, '') = ''")).alias("no_split"),
        nan.alias("nan"),
        inf.alias("inf"),
        *shares,
    )


def check_abc(a: DataFrame, b: DataFrame, c: DataFrame, dim: int) -> DataFrame:
    """Feature tables A, B, C describe the same rows; C holds the columns of both."""
    spark = a.sparkSession
    stats = {name: _table_stats(df) for name, df in (("A", a), ("B", b), ("C", c))}
    joined = None
    for name, df in stats.items():
        renamed = df.select(*[F.col(col).alias(f"{name}_{col}") for col in df.columns], F.lit(1).alias("_one"))
        joined = renamed if joined is None else joined.join(renamed, "_one")
    off_share = F.lit(False)
    for split, share in EXPECTED_SHARES.items():
        off_share = off_share | (F.abs(F.col(f"A_{split}") / F.col("A_rows") - share) > SHARE_TOLERANCE)

    def summed(stat: str) -> tuple[Column, Column]:
        total = F.col(f"A_{stat}") + F.col(f"B_{stat}") + F.col(f"C_{stat}")
        return total == 0, total

    table_checks = _rows(
        joined,
        {
            "row_counts_match": (
                (F.col("A_rows") == F.col("B_rows")) & (F.col("A_rows") == F.col("C_rows")) & (F.col("A_rows") > 0),
                F.col("A_rows"),
            ),
            "target_non_empty": _zero("A_no_target"),
            "split_non_empty": _zero("A_no_split"),
            "no_nan": summed("nan"),
            "no_inf": summed("inf"),
            "split_has_all_three": (F.least("A_train", "A_valid", "A_test") > 0, F.least("A_train", "A_valid", "A_test")),
            "split_ratio_close": (~off_share, F.col("A_train") / F.col("A_rows")),
        },
    )
    unique = [_rows(_duplicates(df, "record_id"), {f"record_id_unique_{n}": _zero("n")}) for n, df in (("A", a), ("B", b), ("C", c))]
    agreement = _meta_agreement(a, b).unionAll(_meta_agreement(a, c)).agg(
        *[F.sum(col).alias(col) for col in ("ids", "targets", "splits")]
    )
    same = _rows(
        agreement,
        {"record_id_match": _zero("ids"), "target_match": _zero("targets"), "split_match": _zero("splits")},
    )
    raw_a = [col for col in a.columns if col.startswith("raw_")]
    # The shortest and the longest vector of every row, block by block.
    ends = [f(F.size(block)).alias(f"{f.__name__}_{block}") for block in features.HCG_BLOCKS for f in (F.min, F.max)]
    shortest_longest = b.agg(*ends).first()
    width = list(shortest_longest)[::2]
    same_width = None not in list(shortest_longest) and width == list(shortest_longest)[1::2]
    names = [
        _known(spark, "A_has_raw_features", len(raw_a) > 0, len(raw_a)),
        _known(spark, "B_embedding_dim", same_width and set(width) == {dim}, sum(w or 0 for w in width)),
        _known(spark, "B_has_missing_flags", set(features.HCG_FLAGS) <= set(b.columns), 2),
        _known(
            spark,
            "C_has_A_and_B_columns",
            set(a.columns) | set(b.columns) == set(c.columns),
            len(features.feature_columns(c)),
        ),
    ]
    return reduce(DataFrame.unionAll, [table_checks, *unique, same, *names])


def check_def(tables: dict[str, tuple[DataFrame, DataFrame]], dim: int) -> DataFrame:
    """Tables with flow embeddings against the table each is built on: {name: (table, base)}."""
    parts: list[DataFrame] = []
    for name, (df, base) in tables.items():
        spark = df.sparkSession
        counts = _meta_agreement(base, df)
        size = F.size(features.FLOW_EMB) if features.FLOW_EMB in df.columns else F.lit(0)
        nan, inf = features.numeric_quality(df)
        stats = df.agg(F.count_if(size != dim).alias("dim"), F.count(F.lit(1)).alias("rows"), nan.alias("nan"), inf.alias("inf"))
        base_rows = base.agg(F.count(F.lit(1)).alias("n")).scalar()
        stats = stats.withColumn("off", F.col("rows") - base_rows)
        parts += [
            _rows(
                stats,
                {
                    f"{name}_rows_equal_base": _zero("off"),
                    f"{name}_embedding_dim": _zero("dim"),
                    f"{name}_no_nan": _zero("nan"),
                    f"{name}_no_inf": _zero("inf"),
                },
            ),
            _rows(
                counts,
                {
                    f"{name}_record_id_match": _zero("ids"),
                    f"{name}_target_match": _zero("targets"),
                    f"{name}_split_match": _zero("splits"),
                },
            ),
            _rows(_duplicates(df, "record_id"), {f"{name}_record_id_unique": _zero("n")}),
            _known(spark, f"{name}_contains_base_columns", set(base.columns) <= set(df.columns), len(base.columns)),
            _known(spark, f"{name}_has_missing_flag", features.FLOW_EMB_FLAG in df.columns, 1),
        ]
    return reduce(DataFrame.unionAll, parts)


def check_id_map(id_map: DataFrame) -> DataFrame:
    """Every vid a number, no empty token, no token twice."""
    stats = id_map.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("vid").cast("string").try_cast("bigint").isNull()).alias("bad_vid"),
        F.count_if(F.expr("coalesce(token, '') = ''")).alias("empty"),
    )
    first = _rows(
        stats,
        {
            "id_map_not_empty": (F.col("rows") > 0, F.col("rows")),
            "vid_is_number": _zero("bad_vid"),
            "token_not_empty": _zero("empty"),
        },
    )
    return first.unionAll(_rows(_duplicates(id_map, "token"), {"token_unique": _zero("n")}))


def check_walks(stats: DataFrame, unknown_tokens: DataFrame, min_length: int = 2) -> DataFrame:
    """Over `walks.corpus_stats` and the tokens that the id map lacks."""
    lengths = _rows(
        stats,
        {
            "has_lines": (F.col("lines") > 0, F.col("lines")),
            "no_empty_line": _zero("empty_lines"),
            "min_length": (F.col("min_length") >= min_length, F.col("min_length")),
        },
    )
    unknown = unknown_tokens.agg(F.count(F.lit(1)).alias("n"))
    return lengths.unionAll(_rows(unknown, {"tokens_in_id_map": _zero("n")}))


def check_embeddings(
    table: DataFrame, key: str, dim: int, id_map: DataFrame | None = None, walk_tokens: DataFrame | None = None
) -> DataFrame:
    """Key present and unique, dimension, NaN and infinity, coverage by id map and walks (percent)."""
    size = F.size("emb")
    stats = table.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.expr(f"coalesce({key}, '') = ''")).alias("no_key"),
        F.count_if(size < dim).alias("short"),
        F.count_if(size > dim).alias("long"),
        F.sum(F.size(F.filter("emb", features.is_nan))).alias("nan"),
        F.sum(F.size(F.filter("emb", features.is_infinite))).alias("inf"),
    )
    parts = [
        _rows(
            stats,
            {
                "has_rows": (F.col("rows") > 0, F.col("rows")),
                "key_not_empty": _zero("no_key"),
                "no_missing_column": _zero("short"),
                "no_extra_column": _zero("long"),
                "no_nan": _zero("nan"),
                "no_inf": _zero("inf"),
            },
        ),
        _rows(_duplicates(table, key), {"key_unique": _zero("n")}),
    ]
    own = table.select(F.col(key).alias("token")).distinct()

    def covered(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        flagged = left.join(right.select("token", F.lit(1).alias("hit")), "token", "left")
        stats = flagged.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
        share = F.when(F.col("n") > 0, F.col("hits") * 100.0 / F.col("n")).otherwise(0.0)
        return _rows(stats, {name: (F.col("hits") == F.col("n"), share)})

    if id_map is not None:
        parts.append(covered(own, id_map.select("token").distinct(), "embeddings_in_id_map"))
    if walk_tokens is not None:
        parts.append(covered(walk_tokens.select("token").distinct(), own, "walk_tokens_embedded"))
    return reduce(DataFrame.unionAll, parts)


# The metrics that make a result complete.
REQUIRED_METRICS = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1"]


def check_results(results: DataFrame, groups: list[str], models: list[str]) -> DataFrame:
    """One row per expected (group, model): present, and complete when it was not skipped."""
    spark = results.sparkSession
    grid = spark.createDataFrame([(g, m) for g in groups for m in models], "feature_group string, model_name string")
    present = [F.col(m).isNotNull() if m in results.columns else F.lit(False) for m in REQUIRED_METRICS]
    missing = F.size(F.filter(F.array(*present), lambda ok: ~ok))
    rows = results.select("feature_group", "model_name", "status", missing.alias("missing"))
    best = rows.groupBy("feature_group", "model_name").agg(
        F.min("missing").alias("missing"),
        F.max(F.col("status").isin("failed", "skipped")).alias("excused"),
        F.max(F.col("status") == "completed").alias("completed"),
    )
    ok = F.coalesce(F.col("excused") | (F.col("completed") & (F.col("missing") == 0)), F.lit(False))
    return grid.join(best, ["feature_group", "model_name"], "left").select(
        F.concat_ws("/", "feature_group", "model_name").alias("check"),
        ok.alias("ok"),
        F.coalesce("missing", F.lit(len(REQUIRED_METRICS))).cast("double").alias("value"),
    )


__all__ = [
    "check_abc",
    "check_def",
    "check_embeddings",
    "check_graph",
    "check_id_map",
    "check_results",
    "check_walks",
    "failed",
    "FEATURE_META",
]
