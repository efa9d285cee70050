"""The queries of this package, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidemark.llm import oracle
from tidemark.llm.decontamination import op1_decontamination
from tidemark.llm.embedding_dedup import op11_embedding_dedup
from tidemark.llm.hard_negatives import op13_hard_negatives
from tidemark.llm.html_extract import op2_html_extract
from tidemark.llm.line_dedup import op8_line_dedup
from tidemark.llm.lm_scoring import op6_lm_scoring
from tidemark.llm.media import op9_media
from tidemark.llm.minhash_dedup import op3_minhash_dedup
from tidemark.llm.packing import op7_packing
from tidemark.llm.quality import op5_quality
from tidemark.llm.resampling import op12_resampling
from tidemark.llm.toxicity import op4_toxicity
from tidemark.llm.warc_zip import op10_warc_zip


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_decontamination, op2_html_extract, op3_minhash_dedup, op4_toxicity, op5_quality,
        op6_lm_scoring, op7_packing, op8_line_dedup, op9_media, op10_warc_zip,
        op11_embedding_dedup, op12_resampling, op13_hard_negatives,
    ]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
