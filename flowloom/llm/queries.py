"""Queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from flowloom.llm.context_mixing import op4_context_mixing
from flowloom.llm.decontamination import op5_decontamination
from flowloom.llm.fingerprints import op10_fingerprints
from flowloom.llm.language_id import op7_language_id
from flowloom.llm.license_scan import op8_license_scan
from flowloom.llm.ngram_join import op6_ngram_join
from flowloom.llm.packing import op9_packing
from flowloom.llm.periodic_runs import op13_periodic_runs
from flowloom.llm.piece_encoding import op12_piece_encoding
from flowloom.llm.resampling import ORACLE as RESAMPLING_ORACLE
from flowloom.llm.resampling import op11_importance_resampling
from flowloom.llm.sharding import op2_sharding
from flowloom.llm.toxicity import op3_toxicity
from flowloom.llm.url_filter import ORACLE as URL_ORACLE
from flowloom.llm.url_filter import op1_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_context_mixing": op4_context_mixing,
    "op5_decontamination": op5_decontamination,
    "op6_ngram_join": op6_ngram_join,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_packing": op9_packing,
    "op10_fingerprints": op10_fingerprints,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_piece_encoding": op12_piece_encoding,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op1_url_filter": URL_ORACLE, "op11_importance_resampling": RESAMPLING_ORACLE}
