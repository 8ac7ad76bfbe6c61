"""Queries on embeddings, label homogeneity, classifiers, metrics, results and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import checks, embeddings, features, hcg, metrics, models, neighbour_index, skipgram, walks
from flowloom.operators import target_encoding as te
from flowloom.plans import views
from flowloom.plans.feature_queries import A_CTE, DERIVED, RAW_NAMES, _sql, table_a, table_b, table_d
from flowloom.plans.graph_queries import CAUSES, causes, rounded
from flowloom.plans.registry import query
from flowloom.plans.view_queries import _HOST_WALKS, host_walks
from flowloom.plans.views import EVENT_TYPES, SEED, WINDOWS, with_ctes
from flowloom.session import cut_lineage

DIM = 64

# ---------------------------------------------------------------- embeddings

_UNIT = """v AS MATERIALIZED (SELECT vec_id::VARCHAR AS id, vec_id, label, embedding::DOUBLE[] AS e,
  sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS size FROM embeddings)"""
_COS = "round(list_dot_product(a.e, b.e) / (a.size * b.size), 6) + 0.0"


def vector_table(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("emb"), "label", "vec_id"
    )


@query("word2vec")
def word2vec(spark, sf_dir):
    learned = embeddings.train_word2vec(host_walks(spark, sf_dir, rounds=5, length=20), seed=SEED)
    return learned.select("token", F.size("emb").cast("bigint").alias("dim"))


@query("skipgram")
def skipgram_vectors(spark, sf_dir):
    corpus = cut_lineage(host_walks(spark, sf_dir, rounds=5, length=20))
    learned = skipgram.train_skipgram(corpus, seed=SEED)
    return learned.select("token", F.size("emb").cast("bigint").alias("dim"))


@query(
    "embedding_table",
    with_ctes(
        ["flows", "endpoint_vectors"],
        """, m AS (SELECT row_number() OVER (ORDER BY token) - 1 AS vid, token FROM (SELECT DISTINCT unnest(tokens) AS token FROM s7)),
t AS (SELECT e.endpoint_id, m.vid FROM endpoint_vectors e LEFT JOIN m ON m.token = e.endpoint_id)
SELECT count(*) AS rows, count(*) FILTER (vid IS NULL) AS missing_vid,
  round(count(vid) / count(*), 6) AS coverage, 0::BIGINT AS nan_count, 0::BIGINT AS inf_count FROM t""",
        *_HOST_WALKS,
    ),
)
def embedding_table(spark, sf_dir):
    id_map = walks.id_map(host_walks(spark, sf_dir))
    learned = views.endpoint_vectors(spark, sf_dir).select(F.col("endpoint_id").alias("token"), "emb")
    return rounded(embeddings.embedding_coverage(embeddings.embedding_table(learned, id_map)), "coverage")


@query(
    "corpus_checks",
    with_ctes(
        ["flows", "endpoint_vectors"],
        """, w AS (SELECT DISTINCT unnest(tokens) AS token FROM s7)
SELECT (SELECT count(*) FROM w) AS walk_tokens, (SELECT count(*) FROM endpoint_vectors) AS embedded_tokens,
  (SELECT count(*) FROM w WHERE token NOT IN (SELECT endpoint_id FROM endpoint_vectors)) AS not_embedded,
  (SELECT count(*) FROM endpoint_vectors WHERE endpoint_id NOT IN (SELECT token FROM w)) AS not_walked,
  (SELECT count(*) FROM s7) AS walks""",
        *_HOST_WALKS,
    ),
)
def corpus_checks(spark, sf_dir):
    return embeddings.corpus_checks(host_walks(spark, sf_dir), views.endpoint_vectors(spark, sf_dir))


@query(
    "nearest",
    f"""WITH {_UNIT}
SELECT a.id AS query, b.id AS neighbour, {_COS} AS similarity,
  (row_number() OVER (PARTITION BY a.id ORDER BY {_COS} DESC, b.id))::INTEGER AS rank
FROM (SELECT * FROM v ORDER BY vec_id LIMIT 10) a JOIN v b ON a.id <> b.id
QUALIFY rank <= 5""",
)
def nearest(spark, sf_dir):
    """Report on the first ten tokens: the five most similar rows of each."""
    table = vector_table(spark, sf_dir)
    return embeddings.nearest(table.orderBy("vec_id").limit(10), table, "id", 5)


@query(
    "embedding_quality",
    with_ctes(
        ["flows", "endpoint_vectors"],
        """, f AS (SELECT DISTINCT src_endpoint AS token FROM flows UNION SELECT dst_endpoint FROM flows)
SELECT * FROM (VALUES ('has_rows', true, (SELECT count(*) FROM endpoint_vectors)::DOUBLE), ('key_not_empty', true, 0.0),
  ('no_missing_column', true, 0.0), ('no_extra_column', true, 0.0), ('no_nan', true, 0.0), ('no_inf', true, 0.0),
  ('key_unique', true, 0.0)) t("check", ok, value)
UNION ALL SELECT 'embeddings_in_id_map', bool_and(f.token IS NOT NULL), round(count(f.token) * 100.0 / count(*), 6)
  FROM endpoint_vectors e LEFT JOIN f ON f.token = e.endpoint_id
UNION ALL SELECT 'walk_tokens_embedded', bool_and(e.endpoint_id IS NOT NULL), round(count(e.endpoint_id) * 100.0 / count(*), 6)
  FROM f LEFT JOIN endpoint_vectors e ON f.token = e.endpoint_id""".lstrip(", "),
    ).replace("embeddings)\nf AS", "embeddings),\nf AS"),
)
def embedding_quality(spark, sf_dir):
    flows = views.flows(spark, sf_dir)
    tokens = hcg.endpoints(flows).select(F.col("endpoint_id").alias("token"))
    table = views.endpoint_vectors(spark, sf_dir)
    return rounded(checks.check_embeddings(table, "endpoint_id", DIM, tokens, tokens), "value")


@query("pca_variance")
def pca_variance(spark, sf_dir):
    return embeddings.pca_variance(vector_table(spark, sf_dir), "id")


@query(
    "cosine_spread",
    f"""WITH {_UNIT}, c AS (SELECT {_COS} AS cosine FROM v a JOIN v b ON a.id < b.id)
SELECT round(median(cosine), 5) AS cosine_median, round(avg(cosine), 5) AS cosine_mean, count(*) AS pairs FROM c""",
)
def cosine_spread(spark, sf_dir):
    """All pairs of the whole table."""
    spread = embeddings.pair_cosine_spread(vector_table(spark, sf_dir), "id")
    return rounded(spread, "cosine_median", "cosine_mean", digits=5)


@query(
    "mean_pair_cosine",
    f"""WITH {_UNIT} SELECT (SELECT count(*) FROM v) AS n, round(avg(list_dot_product(a.e, b.e) / (a.size * b.size)), 6) AS cosine_mean
FROM v a JOIN v b ON a.id < b.id""",
)
def mean_pair_cosine(spark, sf_dir):
    return rounded(embeddings.mean_pair_cosine(vector_table(spark, sf_dir)), "cosine_mean")


@query(
    "norm_spread",
    f"""WITH {_UNIT} SELECT round(median(size), 6) AS norm_median, round(stddev_pop(size), 6) AS norm_std FROM v""",
)
def norm_spread(spark, sf_dir):
    return rounded(embeddings.norm_spread(vector_table(spark, sf_dir)), "norm_median", "norm_std")


_NEAR_ALL = f"""near AS MATERIALIZED (SELECT a.id AS query, b.id AS neighbour, {_COS} AS similarity,
  row_number() OVER (PARTITION BY a.id ORDER BY {_COS} DESC, b.id) AS rank FROM v a JOIN v b ON a.id <> b.id QUALIFY rank <= 5)"""


@query(
    "nn_meaning",
    with_ctes(
        ["flows"],
        """SELECT count(*) AS pairs, round(avg(similarity), 6) AS mean_cosine,
  round(avg((a.src_endpoint = b.src_endpoint)::INT), 6) AS same_endpoint_rate,
  round(avg((a.label = b.label)::INT), 6) AS same_target_rate,
  quantile_cont(abs(query::BIGINT - neighbour::BIGINT), 0.5)::DOUBLE AS record_gap_median,
  round(quantile_cont(abs(query::BIGINT - neighbour::BIGINT), 0.9), 6)::DOUBLE AS record_gap_p90,
  quantile_cont(abs(a.timestamp_epoch - b.timestamp_epoch), 0.5)::DOUBLE AS time_gap_median,
  round(quantile_cont(abs(a.timestamp_epoch - b.timestamp_epoch), 0.9), 6)::DOUBLE AS time_gap_p90
FROM near JOIN flows a ON a.record_id = 'rec_' || lpad((query::BIGINT + 1)::VARCHAR, 10, '0')
JOIN flows b ON b.record_id = 'rec_' || lpad((neighbour::BIGINT + 1)::VARCHAR, 10, '0')""",
        _UNIT,
        _NEAR_ALL.replace("ORDER BY " + _COS + " DESC, b.id", "ORDER BY " + _COS + " DESC, lpad(b.id, 10, '0')"),
    ),
)
def nn_meaning(spark, sf_dir):
    """Five nearest flows of every flow with a vector."""
    vectors = views.flow_vectors(spark, sf_dir)
    near = embeddings.nearest(vectors, vectors, "record_id", 5)
    info = views.flows(spark, sf_dir).select(
        "record_id", "src_endpoint", F.col("label").alias("target"), "timestamp_epoch"
    )
    out = embeddings.neighbour_meaning(near, info)
    return rounded(out, "mean_cosine", "same_endpoint_rate", "same_target_rate", "record_gap_p90", "time_gap_p90")


@query(
    "nn_same_label",
    f"""WITH {_UNIT}, {_NEAR_ALL}
SELECT count(*) AS queries, round(avg((a.label = b.label)::INT), 6) AS same_label_rate
FROM near JOIN v a ON a.id = query JOIN v b ON b.id = neighbour WHERE rank = 1""",
)
def nn_same_label(spark, sf_dir):
    table = vector_table(spark, sf_dir)
    near = embeddings.nearest(table, table, "id", 5)
    labels = table.select(F.col("id").alias("key"), "label")
    return rounded(embeddings.first_neighbour_agreement(near, labels), "same_label_rate")


@query(
    "embedding_missing_rate",
    with_ctes(
        ["flows", "endpoint_vectors"],
        """SELECT count(*) AS rows, round(count(*) FILTER (e.endpoint_id IS NULL) / count(*), 6) AS missing_rate
FROM flows f LEFT JOIN endpoint_vectors e ON e.endpoint_id = f.src_endpoint""",
    ),
)
def embedding_missing_rate(spark, sf_dir):
    rows = views.flows(spark, sf_dir).select("record_id", F.col("src_endpoint").alias("endpoint_id"))
    return rounded(
        embeddings.missing_rate(rows, views.endpoint_vectors(spark, sf_dir), "endpoint_id"), "missing_rate"
    )


# ---------------------------------------------------------------- label homogeneity


def _meta(spark, sf_dir) -> DataFrame:
    return views.flows(spark, sf_dir).withColumn("target", F.col("label"))


@query(
    "majority_share",
    with_ctes(["flows"], "SELECT round(max(n) / sum(n), 6) AS majority_share FROM (SELECT count(*) AS n FROM flows GROUP BY label)"),
)
def majority_share(spark, sf_dir):
    return rounded(embeddings.majority_share(_meta(spark, sf_dir)), "majority_share")


@query(
    "label_purity",
    with_ctes(
        ["flows"],
        """SELECT count(*) AS keys, round(avg(p), 6) AS mean_purity FROM (SELECT src_endpoint, max(n) / sum(n) AS p FROM (
  SELECT src_endpoint, label, count(*) AS n FROM flows GROUP BY 1, 2) GROUP BY 1)""",
    ),
)
def label_purity(spark, sf_dir):
    return rounded(embeddings.label_purity(_meta(spark, sf_dir), "src_endpoint"), "mean_purity")


@query(
    "pair_agreement",
    with_ctes(
        ["flows"],
        """SELECT relation_type, count(*) AS pairs, round(avg((a.label = b.label)::INT), 6) AS agreement FROM causes c
JOIN flows a ON a.record_id = c.src_record_id JOIN flows b ON b.record_id = c.dst_record_id GROUP BY 1""",
        CAUSES,
    ),
)
def pair_agreement(spark, sf_dir):
    return rounded(
        embeddings.pair_agreement(cut_lineage(causes(spark, sf_dir)), views.flows(spark, sf_dir)), "agreement"
    )


@query(
    "group_agreement",
    with_ctes(
        ["flows"],
        """SELECT same_pairs, ordered_pairs, round(same_pairs / ordered_pairs, 6) AS agreement FROM (
  SELECT (SELECT sum(n * (n - 1)) FROM (SELECT count(*) AS n FROM flows GROUP BY src_ip, src_port, label))::BIGINT AS same_pairs,
    (SELECT sum(n * (n - 1)) FROM (SELECT count(*) AS n FROM flows GROUP BY src_ip, src_port))::BIGINT AS ordered_pairs)""",
    ),
)
def group_agreement(spark, sf_dir):
    return rounded(embeddings.group_agreement(_meta(spark, sf_dir), ["src_ip", "src_port"]), "agreement")


@query(
    "group_sizes",
    with_ctes(
        ["flows"],
        """SELECT count(*) AS groups, round(quantile_cont(n, 0.9), 6)::DOUBLE AS size_p90, max(n) AS size_max
FROM (SELECT count(*) AS n FROM flows GROUP BY src_ip, src_port)""",
    ),
)
def group_sizes(spark, sf_dir):
    return rounded(embeddings.group_sizes(_meta(spark, sf_dir), ["src_ip", "src_port"]), "size_p90")


# ---------------------------------------------------------------- baselines and k-NN

_STRATIFIED = """(SELECT record_id, target, split, (SELECT min(r.target) FROM ranges r WHERE r.upto > x.point) AS prediction
  FROM (SELECT *, floor(('0x' || substr(md5('{seed}|' || record_id), 1, 8))::BIGINT / 4294967296.0
    * (SELECT max(upto) FROM ranges))::BIGINT AS point FROM a WHERE split = 'test') x)"""
_RANGES = """cls AS (SELECT target, count(*) AS n FROM a WHERE split = 'train' GROUP BY 1),
ranges AS MATERIALIZED (SELECT target, (sum(n) OVER (ORDER BY target))::BIGINT AS upto FROM cls)"""
_MAJORITY = """(SELECT record_id, target, split, (SELECT target FROM cls ORDER BY n DESC, target LIMIT 1) AS prediction
  FROM a WHERE split = 'test')"""


def _tests(df: DataFrame) -> DataFrame:
    return df.filter("split = 'test'").select("record_id", "target", "split", "prediction")


@query("dummy_majority", _sql(f"SELECT * FROM {_MAJORITY}", A_CTE, _RANGES))
def dummy_majority(spark, sf_dir):
    return _tests(models.predict_majority(table_a(spark, sf_dir)))


def stratified(spark, sf_dir, seed: int = SEED, a: DataFrame | None = None) -> DataFrame:
    return _tests(models.predict_stratified(a if a is not None else table_a(spark, sf_dir), seed))


_PRED = f"pred AS MATERIALIZED {_STRATIFIED.format(seed=SEED)}"


@query("dummy_stratified", _sql("SELECT * FROM pred", A_CTE, _RANGES, _PRED))
def dummy_stratified(spark, sf_dir):
    return stratified(spark, sf_dir)


SCALED = RAW_NAMES + DERIVED
_STATS = ", ".join(f"avg({c}::DOUBLE) AS m_{c}, stddev_pop({c}::DOUBLE) AS s_{c}" for c in SCALED)
# A constant column is divided by 1.
_SCALED = ", ".join(f"(({c}::DOUBLE - m_{c}) / coalesce(nullif(s_{c}, 0.0), 1.0)) AS {c}" for c in SCALED)


@query(
    "standardize",
    _sql(
        f"SELECT record_id, {', '.join(f'round({c}, 6) AS {c}' for c in SCALED)} FROM (SELECT record_id, {_SCALED} FROM a, st)",
        A_CTE,
        f"st AS (SELECT {_STATS} FROM a WHERE split = 'train')",
    ),
)
def standardize(spark, sf_dir):
    a = table_a(spark, sf_dir).select("record_id", "split", *SCALED)
    return rounded(models.standardize(a, models.scaling(a, SCALED)).drop("split"), *SCALED)


_D2 = " + ".join(f"(t.{c} - q.{c}) * (t.{c} - q.{c})" for c in SCALED)


def _knn_sql(rows: str) -> str:
    return f"""st AS (SELECT {_STATS} FROM {rows} WHERE split = 'train'),
z AS MATERIALIZED (SELECT record_id, target, split, {_SCALED} FROM {rows}, st),
knn AS MATERIALIZED (SELECT q.record_id, t.target AS label, round({_D2}, 6) AS d2 FROM z q JOIN z t ON q.split = 'test' AND t.split = 'train'
  QUALIFY row_number() OVER (PARTITION BY q.record_id ORDER BY round({_D2}, 6), t.record_id) <= 5),
voted AS MATERIALIZED (SELECT record_id, label AS prediction FROM (
  SELECT record_id, label, count(*) FILTER (d2 = 0) AS exact,
    round(coalesce(sum(1.0 / sqrt(d2)) FILTER (d2 > 0), 0.0), 6) AS score FROM knn GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY exact DESC, score DESC, label) = 1)"""


_KNN = _knn_sql("a")


def knn_predictions(spark, sf_dir) -> DataFrame:
    return models.predict_knn(table_a(spark, sf_dir), SCALED)


@query(
    "knn",
    _sql("SELECT record_id, target, split, prediction FROM a JOIN voted USING (record_id)", A_CTE, _KNN),
)
def knn(spark, sf_dir):
    return knn_predictions(spark, sf_dir)


_UNIFORM = """uni AS MATERIALIZED (SELECT record_id, label AS prediction FROM (
  SELECT record_id, label, count(*) AS score FROM knn GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY score DESC, label) = 1)"""


@query(
    "knn_uniform",
    _sql("SELECT record_id, target, split, prediction FROM a JOIN uni USING (record_id)", A_CTE, _KNN, _UNIFORM),
)
def knn_uniform(spark, sf_dir):
    return models.predict_knn(table_a(spark, sf_dir), SCALED, weights="uniform")


KNN_SIZES = {"train": 3000, "valid": 500, "test": 500}
_CAPPED = """capped AS MATERIALIZED (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY split ORDER BY
  md5((CASE split WHEN 'train' THEN '42' WHEN 'valid' THEN '43' ELSE '44' END) || '|' || record_id), record_id)
  <= CASE split WHEN 'train' THEN 3000 ELSE 500 END)"""


@query(
    "knn_capped",
    _sql("SELECT record_id, target, split, prediction FROM capped JOIN voted USING (record_id)", A_CTE, _CAPPED, _knn_sql("capped")),
)
def knn_capped(spark, sf_dir):
    """The vote on an exact sample of each split."""
    return models.predict_knn(table_a(spark, sf_dir), SCALED, sizes=KNN_SIZES)


@query("knn_indexed")
def knn_indexed(spark, sf_dir):
    """The vote of all test rows through the inverted-list index."""
    return models.predict_knn(table_a(spark, sf_dir), SCALED, indexed=True)


def _index_queries(table: DataFrame) -> DataFrame:
    """Every fiftieth row by id is a query."""
    return table.filter(F.col("id").cast("bigint") % 50 == 0)


@query("neighbour_index")
def indexed_neighbours(spark, sf_dir):
    """The five most similar rows of every fiftieth row, through the inverted-list index."""
    table = vector_table(spark, sf_dir).select("id", F.col("emb").alias("v"))
    index = neighbour_index.build(table, cosine=True)
    lists, _ = neighbour_index.tuned(index, _index_queries(table), 5)
    found = neighbour_index.search(index, _index_queries(table), 5, lists)
    return found.select(F.col("query_id").alias("query"), F.col("id").alias("neighbour"), (-F.col("value")).alias("similarity"))


@query(
    "index_recall",
    "SELECT count(*) AS indexed, count(*) FILTER (vec_id % 50 = 0) AS queries, true AS reached FROM embeddings",
)
def index_recall(spark, sf_dir):
    """Rows in the index, and whether its recall against all rows reaches nine tenths."""
    table = vector_table(spark, sf_dir).select("id", F.col("emb").alias("v"))
    index = neighbour_index.build(table, cosine=True)
    queries = _index_queries(table)
    _, recall = neighbour_index.tuned(index, queries, 5)
    asked = queries.agg(F.count(F.lit(1)).alias("n")).scalar()
    return index.rows.agg(F.count(F.lit(1)).alias("indexed")).select("indexed", asked.alias("queries"), F.lit(recall >= 0.9).alias("reached"))


# ---------------------------------------------------------------- MLlib models (rows only)


def _assembled(spark, sf_dir):
    a = table_a(spark, sf_dir)
    classes = te.class_list(a)
    return models.assemble(a, features.feature_columns(a), classes), classes


# Per class the mean and the variance of each feature, a share of the largest variance added to all.
_X = ", ".join(f"{c}::DOUBLE" for c in RAW_NAMES + DERIVED)
_GAUSS = [
    f"""cell AS MATERIALIZED (SELECT record_id, target, split, unnest([{_X}]) AS x, unnest(range({len(RAW_NAMES + DERIVED)})) AS j FROM a)""",
    """spread AS (SELECT max(v) * 1e-9 AS eps FROM (
  SELECT avg(x * x) - avg(x) * avg(x) AS v FROM cell WHERE split = 'train' GROUP BY j))""",
    """fitted AS MATERIALIZED (SELECT target AS label, j, avg(x) AS m, avg(x * x) - avg(x) * avg(x) + (SELECT eps FROM spread) AS s
  FROM cell WHERE split = 'train' GROUP BY 1, 2)""",
    "prior AS (SELECT target AS label, ln(count(*)) AS p FROM a WHERE split = 'train' GROUP BY 1)",
    """likely AS (SELECT record_id, cell.target, split, label, sum(-0.5 * ((x - m) * (x - m) / s + ln(s))) AS l
  FROM cell JOIN fitted USING (j) WHERE split = 'test' GROUP BY ALL)""",
]
_GAUSS_SQL = """SELECT record_id, target, split, label AS prediction FROM likely JOIN prior USING (label)
QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY l + p DESC, label) = 1"""


def _register_model(name: str, sql: str | None = None, **params) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        assembled, classes = _assembled(spark, sf_dir)
        return models.train(name, assembled, classes, **params).predictions


_register_model("logistic")
_register_model("tree")
_register_model("forest")
_register_model("gauss_nb", _sql(_GAUSS_SQL, A_CTE, *_GAUSS))
# Stopped after 5 rounds without a smaller validation loss; at most 3000 rounds, the operator's default.
_register_model("boosted", patience=5)


@query("feature_importance")
def feature_importance(spark, sf_dir):
    assembled, classes = _assembled(spark, sf_dir)
    trained = models.train("forest", assembled, classes)
    return models.importance_table(trained, spark, RAW_NAMES + DERIVED)


@query("training_history")
def training_history(spark, sf_dir):
    assembled, classes = _assembled(spark, sf_dir)
    return models.history_table(models.train("logistic", assembled, classes), spark)


@query("model_grid")
def model_grid(spark, sf_dir):
    a = table_a(spark, sf_dir)
    tables = {"A": a, "D": table_d(spark, sf_dir, a)}
    return models.grid(tables, {"tree": {}, "gauss_nb": {}}).drop("train_seconds")


# ---------------------------------------------------------------- metrics

_METRICS = """conf_{p} AS (SELECT target AS truth, prediction AS guess, count(*) AS n FROM {p} GROUP BY 1, 2),
cls_{p} AS (SELECT label, coalesce(hit / nullif(predicted, 0), 0.0) AS precision, coalesce(hit / nullif(support, 0), 0.0) AS recall,
    coalesce(2.0 * hit / nullif(support + predicted, 0), 0.0) AS f1, support FROM (
  SELECT label, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h)::BIGINT AS hit FROM (
    SELECT truth AS label, n AS s, 0 AS p, CASE WHEN truth = guess THEN n ELSE 0 END AS h FROM conf_{p}
    UNION ALL SELECT guess, 0, n, 0 FROM conf_{p}) GROUP BY 1)),
sum_{p} AS (SELECT (SELECT sum(n) FILTER (truth = guess) / sum(n) FROM conf_{p}) AS accuracy,
  avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
  sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall,
  sum(f1 * support) / sum(support) AS weighted_f1, sum(support)::BIGINT AS rows FROM cls_{p})"""
_METRIC_NAMES = [
    "accuracy",
    "macro_precision",
    "macro_recall",
    "macro_f1",
    "weighted_precision",
    "weighted_recall",
    "weighted_f1",
]
_ROUND_METRICS = ", ".join(f"round({m}, 6) AS {m}" for m in _METRIC_NAMES)


@query("metrics", _sql(f"SELECT {_ROUND_METRICS}, rows FROM sum_pred", A_CTE, _RANGES, _PRED, _METRICS.format(p="pred")))
def metrics_summary(spark, sf_dir):
    return rounded(metrics.summary(stratified(spark, sf_dir)), *_METRIC_NAMES)


@query(
    "metrics_majority",
    _sql(
        f"SELECT {_ROUND_METRICS}, rows FROM sum_major",
        A_CTE,
        _RANGES,
        f"major AS MATERIALIZED {_MAJORITY}",
        _METRICS.format(p="major"),
    ),
)
def metrics_majority(spark, sf_dir):
    return rounded(metrics.summary(dummy_majority(spark, sf_dir)), *_METRIC_NAMES)


@query(
    "class_report",
    _sql(
        """SELECT l.target AS label, round(coalesce(precision, 0.0), 6) AS precision, round(coalesce(recall, 0.0), 6) AS recall,
  round(coalesce(f1, 0.0), 6) AS f1, coalesce(support, 0)::BIGINT AS support
FROM (SELECT DISTINCT target FROM a) l LEFT JOIN cls_major ON cls_major.label = l.target""",
        A_CTE,
        _RANGES,
        f"major AS MATERIALIZED {_MAJORITY}",
        _METRICS.format(p="major"),
    ),
)
def class_report(spark, sf_dir):
    a = table_a(spark, sf_dir)
    predicted = _tests(models.predict_majority(a))
    report = metrics.class_report(predicted, a.select(F.col("target").alias("label")))
    return rounded(report, "precision", "recall", "f1")


@query(
    "confusion",
    _sql(
        "SELECT truth, "
        + ", ".join(f"coalesce(sum(n) FILTER (guess = '{t}'), 0)::BIGINT AS \"{t}\"" for t in EVENT_TYPES)
        + " FROM conf_pred GROUP BY 1",
        A_CTE,
        _RANGES,
        _PRED,
        _METRICS.format(p="pred"),
    ),
)
def confusion(spark, sf_dir):
    a = table_a(spark, sf_dir)
    return metrics.confusion_matrix(stratified(spark, sf_dir, a=a), te.class_list(a))


@query(
    "confusion_top20",
    _sql(
        """, top AS (SELECT truth AS label FROM conf_pred GROUP BY 1 ORDER BY sum(n) DESC, truth LIMIT 20)
SELECT t.label AS truth, g.label AS guess, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY t.label), 6) AS share
FROM top t CROSS JOIN top g LEFT JOIN conf_pred c ON c.truth = t.label AND c.guess = g.label""".replace(", top", ""),
        A_CTE,
        _RANGES,
        _PRED,
        _METRICS.format(p="pred"),
    ).replace("\n AS (SELECT truth AS label", ",\ntop AS (SELECT truth AS label"),
)
def confusion_top20(spark, sf_dir):
    counts = metrics.confusion(stratified(spark, sf_dir))
    return rounded(metrics.top_confusion(counts), "share")


@query(
    "prediction_sample",
    _sql(
        "SELECT record_id, target AS y_true, prediction AS y_pred FROM pred ORDER BY record_id LIMIT 5000",
        A_CTE,
        _RANGES,
        _PRED,
    ),
)
def prediction_sample(spark, sf_dir):
    return metrics.prediction_sample(stratified(spark, sf_dir))


@query(
    "class_f1_change",
    _sql(
        """SELECT coalesce(l.label, r.label) AS label, round(coalesce(l.f1, 0.0), 6) AS f1_left, round(coalesce(r.f1, 0.0), 6) AS f1_right,
  round(coalesce(r.f1, 0.0) - coalesce(l.f1, 0.0), 6) AS change FROM cls_major l FULL JOIN cls_pred r ON l.label = r.label""",
        A_CTE,
        _RANGES,
        _PRED,
        f"major AS MATERIALIZED {_MAJORITY}",
        _METRICS.format(p="pred"),
        _METRICS.format(p="major"),
    ),
)
def class_f1_change(spark, sf_dir):
    a = table_a(spark, sf_dir)
    labels = a.select(F.col("target").alias("label"))
    left = metrics.class_report(_tests(models.predict_majority(a)), labels)
    right = metrics.class_report(stratified(spark, sf_dir, a=a), labels)
    return rounded(metrics.compare_reports(left, right), "f1_left", "f1_right", "change")


# ---------------------------------------------------------------- results

GROUPS = ["A", "B", "C", "E", "F"]


def results_table(spark, sf_dir) -> DataFrame:
    """Both baselines for each feature group; the drawn one has its own seed per group."""
    a = table_a(spark, sf_dir)
    rows = []
    for i, group in enumerate(GROUPS):
        rows.append(metrics.result_row(stratified(spark, sf_dir, SEED + i, a), group, "dummy_stratified", 10 + i))
    rows.append(metrics.result_row(_tests(models.predict_majority(a)), "A", "dummy_most_frequent").drop("feature_count"))
    return metrics.union_results(rows)


_RUNS = [f"run{i} AS MATERIALIZED {_STRATIFIED.format(seed=SEED + i)}" for i in range(len(GROUPS))]
_RESULTS = [
    A_CTE,
    _RANGES,
    *_RUNS,
    f"major AS MATERIALIZED {_MAJORITY}",
    *[_METRICS.format(p=f"run{i}") for i in range(len(GROUPS))],
    _METRICS.format(p="major"),
    "results AS MATERIALIZED ("
    + " UNION ALL ".join(
        f"SELECT '{g}' AS feature_group, 'dummy_stratified' AS model_name, 'completed' AS status, {10 + i}::BIGINT AS feature_count, * FROM sum_run{i}"
        for i, g in enumerate(GROUPS)
    )
    + " UNION ALL SELECT 'A', 'dummy_most_frequent', 'completed', NULL, * FROM sum_major)",
]


@query(
    "result_rows",
    _sql(f"SELECT feature_group, model_name, status, feature_count, {_ROUND_METRICS}, rows FROM results", *_RESULTS),
)
def result_rows(spark, sf_dir):
    return rounded(results_table(spark, sf_dir), *_METRIC_NAMES)


@query(
    "result_pivot",
    _sql(
        "SELECT model_name, "
        + ", ".join(f"round(max(macro_f1) FILTER (feature_group = '{g}'), 6) AS \"{g}\"" for g in GROUPS)
        + " FROM results GROUP BY 1",
        *_RESULTS,
    ),
)
def result_pivot(spark, sf_dir):
    return rounded(metrics.model_by_group(results_table(spark, sf_dir), GROUPS), *GROUPS)


@query(
    "result_best",
    _sql(
        """SELECT metric, feature_group, model_name, round(value, 6) AS value FROM (
  SELECT 'macro_f1' AS metric, feature_group, model_name, macro_f1 AS value FROM results
  UNION ALL SELECT 'weighted_f1', feature_group, model_name, weighted_f1 FROM results)
QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, feature_group, model_name) = 1""",
        *_RESULTS,
    ),
)
def result_best(spark, sf_dir):
    return rounded(metrics.best_runs(results_table(spark, sf_dir)), "value")


@query(
    "result_gains",
    _sql(
        """SELECT comparison, subject, round(gain, 6) + 0.0 AS gain FROM (
"""
        + " UNION ALL ".join(
            f"""SELECT '{a}-{b}' AS comparison, x.model_name AS subject, x.macro_f1 - y.macro_f1 AS gain FROM results x
  JOIN results y ON x.model_name = y.model_name AND x.feature_group = '{a}' AND y.feature_group = '{b}'"""
            for a, b in metrics.GROUP_GAINS
        )
        + """
UNION ALL SELECT 'B-dummy', 'best', (SELECT max(macro_f1) FROM results WHERE feature_group = 'B')
  - (SELECT max(macro_f1) FROM results WHERE model_name LIKE 'dummy_%')
UNION ALL SELECT 'boosted-tree', x.feature_group, x.macro_f1 - y.macro_f1 FROM results x JOIN results y
  ON x.feature_group = y.feature_group AND x.model_name = 'dummy_stratified' AND y.model_name = 'dummy_most_frequent')""",
        *_RESULTS,
    ),
)
def result_gains(spark, sf_dir):
    """The model pair is a parameter; here the drawn baseline is set against the majority."""
    gains = metrics.gains(results_table(spark, sf_dir), boosted="dummy_stratified", tree="dummy_most_frequent")
    return rounded(gains, "gain")


@query(
    "result_divergence",
    _sql(
        """SELECT feature_group, model_name, round(weighted_f1 - macro_f1, 6) AS weighted_minus_macro,
  NULL::DOUBLE AS seconds_per_feature FROM results""",
        *_RESULTS,
    ),
)
def result_divergence(spark, sf_dir):
    return rounded(metrics.divergence(results_table(spark, sf_dir)), "weighted_minus_macro")


def _forest_on_c(spark, sf_dir) -> DataFrame:
    """`feature`, `importance` of a forest trained on the raw and graph features."""
    a = table_a(spark, sf_dir)
    c = cut_lineage(features.widen(features.fuse(a, table_b(spark, sf_dir, a)), features.hcg_layout(DIM)))
    classes, columns = te.class_list(a), features.feature_columns(c)
    trained = models.train("forest", models.assemble(c, columns, classes), classes)
    return models.importance_table(trained, spark, columns)


@query("importance_family")
def importance_family(spark, sf_dir):
    """Gains of a trained forest summed by feature family."""
    return metrics.importance_by_family(_forest_on_c(spark, sf_dir))


@query("importance_top")
def importance_top(spark, sf_dir):
    """The 30 features that a trained forest gained most from."""
    return metrics.top_importances(_forest_on_c(spark, sf_dir))


# ---------------------------------------------------------------- checks

_GRAPH_CHECKS = [
    "no_self_loop",
    "relation_type_known",
    "priority_matches_type",
    "delta_within_window",
    "same_timestamp_flag",
    "record_id_unique",
    "relation_id_unique",
    "endpoint_id_unique",
    "edge_id_unique",
    "totals_add_up",
    "no_dangling_flow",
    "no_dangling_endpoint",
]


@query(
    "check_graph",
    "SELECT * FROM (VALUES " + ", ".join(f"('{c}', true, 0.0::DOUBLE)" for c in _GRAPH_CHECKS) + ') t("check", ok, value)',
)
def check_graph(spark, sf_dir):
    flows = views.stored_flows(spark, sf_dir)
    stored = cut_lineage(causes(spark, sf_dir))
    return checks.check_graph(flows, stored, hcg.endpoints(flows), cut_lineage(hcg.edges(flows)), WINDOWS)


# Faults by the number of an edge's earlier flow: what is changed, and the check that must see it.
_FAULTY = """faulty AS MATERIALIZED (SELECT CASE WHEN n % 101 = 0 THEN 'same' ELSE relation_id END AS relation_id, src_record_id,
    CASE WHEN n % 97 = 0 THEN src_record_id WHEN n % 89 = 0 THEN 'rec_none' ELSE dst_record_id END AS dst_record_id,
    CASE WHEN n % 83 = 0 THEN 'XXX' ELSE relation_type END AS relation_type,
    relation_priority + (n % 79 = 0)::BIGINT AS relation_priority,
    CASE WHEN n % 73 = 0 THEN -1 WHEN n % 71 = 0 THEN 700000 ELSE delta_seconds END AS delta_seconds, same_timestamp
  FROM (SELECT *, regexp_extract(src_record_id, '([0-9]+)$', 1)::BIGINT AS n FROM causes))"""


@query(
    "check_graph_faults",
    with_ctes(
        ["flows"],
        """SELECT "check", value = 0 AS ok, value::DOUBLE AS value FROM (
  SELECT 'no_self_loop' AS "check", count(*) FILTER (src_record_id = dst_record_id) AS value FROM faulty
  UNION ALL SELECT 'relation_type_known', count(*) FILTER (relation_type = 'XXX') FROM faulty
  UNION ALL SELECT 'priority_matches_type', count(*) FILTER (relation_type <> 'XXX' AND relation_priority <>
    CASE relation_type WHEN 'CR' THEN 1 WHEN 'PR' THEN 2 WHEN 'DHR' THEN 3 ELSE 4 END) FROM faulty
  UNION ALL SELECT 'delta_within_window', count(*) FILTER (delta_seconds < 0 OR (relation_type <> 'XXX' AND delta_seconds >
    CASE relation_type WHEN 'CR' THEN 604800 WHEN 'PR' THEN 7200 WHEN 'DHR' THEN 86400 ELSE 259200 END)) FROM faulty
  UNION ALL SELECT 'same_timestamp_flag', count(*) FILTER (same_timestamp <> (delta_seconds = 0)) FROM faulty
  UNION ALL SELECT 'relation_id_unique', count(*) - count(DISTINCT relation_id) FROM faulty
  UNION ALL SELECT 'no_dangling_flow', (SELECT count(*) FROM (SELECT src_record_id AS r FROM faulty UNION SELECT dst_record_id FROM faulty)
    WHERE r NOT IN (SELECT record_id FROM flows))
  UNION ALL SELECT 'record_id_unique', 0 UNION ALL SELECT 'endpoint_id_unique', 0 UNION ALL SELECT 'edge_id_unique', 0
  UNION ALL SELECT 'totals_add_up', 0 UNION ALL SELECT 'no_dangling_endpoint', 0)""",
        CAUSES,
        _FAULTY,
    ),
)
def check_graph_faults(spark, sf_dir):
    """The graph's checks on edges with planted faults: each must count its own."""
    flows = views.stored_flows(spark, sf_dir)
    n = F.regexp_extract("src_record_id", "([0-9]+)$", 1).cast("bigint")
    faulty = causes(spark, sf_dir).withColumns(
        {
            "relation_id": F.when(n % 101 == 0, F.lit("same")).otherwise(F.col("relation_id")),
            "dst_record_id": F.when(n % 97 == 0, F.col("src_record_id")).when(n % 89 == 0, F.lit("rec_none")).otherwise(F.col("dst_record_id")),
            "relation_type": F.when(n % 83 == 0, F.lit("XXX")).otherwise(F.col("relation_type")),
            "relation_priority": F.col("relation_priority") + (n % 79 == 0).cast("bigint"),
            "delta_seconds": F.when(n % 73 == 0, F.lit(-1)).when(n % 71 == 0, F.lit(700000)).otherwise(F.col("delta_seconds")),
        }
    )
    return checks.check_graph(flows, cut_lineage(faulty), hcg.endpoints(flows), cut_lineage(hcg.edges(flows)), WINDOWS)


@query(
    "check_results",
    """SELECT g || '/' || m AS "check", m = 'dummy_stratified' OR g = 'A' AS ok,
  CASE WHEN m = 'dummy_stratified' OR g = 'A' THEN 0.0 ELSE 5.0 END::DOUBLE AS value
FROM (VALUES ('A'), ('B'), ('C'), ('E'), ('F')) t(g), (VALUES ('dummy_stratified'), ('dummy_most_frequent')) s(m)""",
)
def check_results(spark, sf_dir):
    return checks.check_results(results_table(spark, sf_dir), GROUPS, ["dummy_stratified", "dummy_most_frequent"])


@query(
    "check_walks",
    with_ctes(
        ["flows"],
        """SELECT 'has_lines' AS "check", true AS ok, count(*)::DOUBLE AS value FROM s7
UNION ALL SELECT 'no_empty_line', true, 0.0 UNION ALL SELECT 'tokens_in_id_map', true, 0.0
UNION ALL SELECT 'min_length', min(len(tokens)) >= 2, min(len(tokens))::DOUBLE FROM s7
UNION ALL SELECT 'id_map_not_empty', true, (SELECT count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM s7))::DOUBLE
UNION ALL SELECT 'vid_is_number', true, 0.0 UNION ALL SELECT 'token_not_empty', true, 0.0 UNION ALL SELECT 'token_unique', true, 0.0""",
        *_HOST_WALKS,
    ),
)
def check_walks(spark, sf_dir):
    corpus = cut_lineage(host_walks(spark, sf_dir))
    id_map = walks.id_map(corpus)
    unknown = walks.token_differences(walks.touched_vertices(corpus), id_map).filter("only_in = 'left'")
    return checks.check_walks(walks.corpus_stats(corpus), unknown).unionAll(checks.check_id_map(id_map))
