"""Feature tables A to F: raw flow features, endpoint-graph features, flow embeddings, and their joins.

Vectors stay arrays until a sink asks for numbered columns (`widen`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import hashing, net, text, vectors
from flowloom.operators.skew import heavy_keys, lookup_join, top_k_per_key
from flowloom.schema import FEATURE_META, LEAKAGE_COLUMNS
from flowloom.sources.flows import ROW_NUMBER, _field, normalize_endpoints

# The raw column that holds each target.
TARGET_COLUMNS = {"label": "Label", "protocol_name": "ProtocolName", "l7_protocol": "L7Protocol"}
HCG_BLOCKS = ["hcg_src_emb", "hcg_dst_emb", "hcg_absdiff_emb", "hcg_prod_emb"]
HCG_FLAGS = ["hcg_src_emb_missing", "hcg_dst_emb_missing"]
FLOW_EMB = "tcg_emb"
FLOW_EMB_FLAG = "tcg_emb_missing"


def numeric_source_columns(raw: DataFrame) -> list[str]:
    """Raw columns with at least one number, decided once for the whole data set.

    Runs one aggregate over all candidate columns; a single row comes back.
    """
    candidates = [c for c in raw.columns if c not in LEAKAGE_COLUMNS and c != ROW_NUMBER]
    found = raw.agg(
        *[F.max(text.plain_number(F.col(f"`{c}`")).isNotNull()).alias(f"c{i}") for i, c in enumerate(candidates)]
    ).first()
    return [c for i, c in enumerate(candidates) if found[f"c{i}"]]


def raw_features(
    raw: DataFrame,
    target: str = "protocol_name",
    seed: int = 20260525,
    valid_share: float = 0.1,
    test_share: float = 0.2,
    numeric: list[str] | None = None,
) -> DataFrame:
    """A: five meta columns, every numeric raw column as FLOAT, eleven derived features.

    One projection, no shuffle.  The epoch stays a BIGINT: as a FLOAT it would be rounded
    to steps of 128 seconds.
    """
    sides = normalize_endpoints(raw)
    label = _field(raw, TARGET_COLUMNS[target])
    number = F.col(ROW_NUMBER) if ROW_NUMBER in raw.columns else F.lit(None).cast("bigint")
    record_id = hashing.stable_record_id(_field(raw, "record_id"), number)
    _, epoch = text.parse_timestamp(_field(raw, "Timestamp"))
    base = raw.select(
        record_id.alias("record_id"),
        label.alias("target"),
        sides["src_endpoint"].alias("src_endpoint"),
        sides["dst_endpoint"].alias("dst_endpoint"),
        sides["src_port"].alias("_src_port"),
        sides["dst_port"].alias("_dst_port"),
        epoch.alias("_epoch"),
        *[
            text.finite_number(F.col(f"`{c}`")).alias(text.raw_feature_name(c))
            for c in (numeric if numeric is not None else numeric_source_columns(raw))
        ],
    )
    raw_names = [c for c in base.columns if c.startswith("raw_")]
    derived = {
        "raw_timestamp_epoch": F.col("_epoch"),
        "raw_hour": text.hour_of(F.col("_epoch")).cast("float"),
        "raw_dayofweek": text.weekday_of(F.col("_epoch")).cast("float"),
    }
    for side in ("src", "dst"):
        port = F.col(f"_{side}_port")
        derived[f"raw_{side}_port"] = port.cast("float")
        derived[f"raw_{side}_is_common_service_port"] = net.is_common_service_port(port).cast("float")
        derived[f"raw_{side}_is_proxy_port"] = net.is_proxy_port(port).cast("float")
        derived[f"raw_{side}_port_bucket_code"] = net.port_bucket_code(port).cast("float")
    split = hashing.split_of(F.col("record_id"), F.col("target"), seed, valid_share, test_share)
    meta = [split.alias("split") if c == "split" else F.col(c) for c in FEATURE_META]
    return base.select(*meta, *raw_names, *[c.alias(name) for name, c in derived.items()])


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in FEATURE_META]


def graph_features(meta: DataFrame, embeddings: DataFrame, dim: int) -> DataFrame:
    """B: endpoint vectors of both sides, their absolute difference and product, two missing flags.

    `embeddings` has `endpoint_id`, `emb`.  An unknown endpoint counts as a zero vector.
    Both lookups spread a heavy endpoint over many tasks.  Heavy endpoints are counted on
    `meta` itself, so give a stored table.
    """
    out = meta.select(*FEATURE_META)
    for side in ("src", "dst"):
        heavy = heavy_keys(meta, [f"{side}_endpoint"])
        table = embeddings.select(
            F.col("endpoint_id").alias(f"{side}_endpoint"), F.col("emb").cast("array<float>").alias(f"_{side}")
        )
        out = lookup_join(out, table, [f"{side}_endpoint"], ["record_id"], heavy=heavy)
    src, dst = (F.coalesce(F.col(f"_{s}"), vectors.zeros(dim)) for s in ("src", "dst"))
    blocks = dict(zip(HCG_BLOCKS, (src, dst, vectors.abs_diff(src, dst), vectors.product(src, dst))))
    flags = dict(zip(HCG_FLAGS, (F.col("_src").isNull(), F.col("_dst").isNull())))
    return out.select(
        *FEATURE_META,
        *[c.alias(name) for name, c in blocks.items()],
        *[c.cast("float").alias(name) for name, c in flags.items()],
    )


def fuse(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of both tables by record id: C = A + B, E = A + D, F = C + D.

    Record ids are unique, so this join has no skew; tables bucketed by record id do not
    shuffle.
    """
    extra = [c for c in right.columns if c not in left.columns]
    return left.join(right.select("record_id", *extra), "record_id", "left").select(*left.columns, *extra)


def flow_embedding_features(meta: DataFrame, embeddings: DataFrame, dim: int) -> DataFrame:
    """D: the flow's own vector and a missing flag.  `embeddings` has `record_id`, `emb`."""
    table = embeddings.select("record_id", F.col("emb").cast("array<float>").alias("_emb"))
    return (
        meta.select(*FEATURE_META)
        .join(table, "record_id", "left")
        .select(
            *FEATURE_META,
            F.coalesce("_emb", vectors.zeros(dim)).alias(FLOW_EMB),
            F.col("_emb").isNull().cast("tinyint").alias(FLOW_EMB_FLAG),
        )
    )


def rebuild_with_flow_embedding(base: DataFrame, d: DataFrame, dim: int) -> DataFrame:
    """E or F from A or C and a stored D that may hold a record id twice.

    Of several D rows the one with a vector wins, then the smallest vector.
    """
    unique = top_k_per_key(
        d.select("record_id", FLOW_EMB, FLOW_EMB_FLAG), "record_id", [F.col(FLOW_EMB_FLAG), F.col(FLOW_EMB)], 1
    )
    joined = base.join(unique, "record_id", "left")
    return joined.select(
        *base.columns,
        F.coalesce(FLOW_EMB, vectors.zeros(dim)).alias(FLOW_EMB),
        F.coalesce(FLOW_EMB_FLAG, F.lit(1).cast("tinyint")).alias(FLOW_EMB_FLAG),
    )


def widen(df: DataFrame, dims: dict[str, tuple[str, int]]) -> DataFrame:
    """Expand array columns for a wide sink: `{column: (prefix, length)}`."""
    out: list[Column] = []
    for name in df.columns:
        if name in dims:
            out.extend(vectors.indexed_columns(name, *dims[name]))
        else:
            out.append(F.col(name))
    return df.select(*out)


def hcg_layout(dim: int) -> dict[str, tuple[str, int]]:
    return {block: (f"{block}_", dim) for block in HCG_BLOCKS}


def flow_layout(dim: int) -> dict[str, tuple[str, int]]:
    return {FLOW_EMB: ("emb_", dim)}


def _bad(df: DataFrame, column: str, test) -> Column:
    """Number of bad values in a scalar or array column of one row."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("array"):
        return F.size(F.filter(column, test))
    if kind in ("float", "double"):
        return test(F.col(column)).cast("int")
    return F.lit(0)


def is_infinite(c: Column) -> Column:
    return F.coalesce(F.abs(c) == F.lit(float("inf")), F.lit(False))


def is_nan(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def numeric_quality(df: DataFrame) -> tuple[Column, Column]:
    """Aggregates that count NaN and infinite feature values, arrays included."""
    names = [c for c in feature_columns(df) if dict(df.dtypes)[c].startswith(("array", "float", "double"))]

    def total(test) -> Column:
        cells = F.lit(0)
        for name in names:
            cells = cells + _bad(df, name, test)
        return F.coalesce(F.sum(cells), F.lit(0)).cast("bigint")

    return total(is_nan), total(is_infinite)


def build_metrics(c: DataFrame) -> DataFrame:
    """One row over table C: rows, classes, missing endpoints, unparsed times, NaN and infinities."""
    nan, inf = numeric_quality(c)
    src, dst = (F.col(flag) == 1 for flag in HCG_FLAGS)
    rows = F.count(F.lit(1))
    counts = {"src": src, "dst": dst, "any": src | dst}
    return c.agg(
        rows.alias("rows"),
        F.count_distinct("target").alias("target_class_count"),
        *[F.count_if(test).alias(f"{name}_missing_count") for name, test in counts.items()],
        *[(F.count_if(test) / rows).alias(f"{name}_missing_ratio") for name, test in counts.items()],
        F.count_if(F.col("raw_timestamp_epoch") == 0).alias("timestamp_parse_failed_count"),
        nan.alias("nan_count"),
        inf.alias("inf_count"),
    )


def target_top(meta: DataFrame, n: int = 20) -> DataFrame:
    """Most frequent targets overall (`split` = all) and in each split."""
    scopes = F.explode(F.array(F.lit("all"), F.col("split")))
    counts = meta.select(scopes.alias("split"), "target").groupBy("split", "target").agg(
        F.count(F.lit(1)).alias("count")
    )
    return top_k_per_key(counts, "split", [F.desc("count"), F.col("target")], n)


def split_counts(meta: DataFrame) -> DataFrame:
    return meta.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
