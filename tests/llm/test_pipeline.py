"""The pipeline stage by stage against plain versions of its decisions."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from flowloom.llm import toxicity
from flowloom.session import cut_lineage
from test_operators import plain_components

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "123 !!", "en", "s", 6)], docs.schema)
    docs = cut_lineage(docs.union(extra))
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(cut_lineage(stage(spark, kept[-1], SF_DIR)))
    for rows in kept[1:-1]:
        assert rows.columns == columns
    texts = [{r["doc_id"]: r["text"] for r in rows.collect()} for rows in kept[:-1]]
    # Language: only texts without a letter go.
    assert set(texts[0]) - set(texts[1]) == {10**6, 10**6 + 1}
    # Toxicity: what the model calls toxic goes.
    model = toxicity.fitted(spark, kept[1], SF_DIR)
    called = {r["doc_id"] for r in toxicity.predict(kept[1], model).where("predicted = 1").collect()}
    assert set(texts[2]) == set(texts[1]) - called
    # Near duplicates: the least id of each component stays.
    assert set(texts[3]) == {i for i, (n, root) in plain_components(texts[2]).items() if root == i or n == 0}
    # Decontamination: texts with a whole benchmark passage are gone, and few others are.
    items = [r["text"].lower() for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    leaked = {i for i, t in texts[3].items() if any(x in t.lower() for x in items)}
    assert not leaked & set(texts[4]) and len(set(texts[3]) - set(texts[4]) - leaked) <= 2
    # Packing: every text is there once and whole.
    pieces = kept[-1].toPandas()
    assert set(pieces["doc_id"]) == set(texts[4])
    assert all(p["length"].sum() == p["doc_tokens"].iloc[0] for _, p in pieces.groupby("doc_id"))
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 2048
    run = corpus_pipeline.run(spark, SF_DIR).toPandas()
    same = kept[-1].sparkSession.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert len(run) > 0 and same == len(texts[0]) - 2 and np.isin(run["doc_id"], list(texts[0])).all()
