"""Queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from utterscope.llm import decontaminate, lm_score, packing, sharding, spelling, topk, vector_codes
from utterscope.llm.bpe import op13_bpe_codec
from utterscope.llm.decontaminate import op5_decontamination
from utterscope.llm.html_text import op1_html_text
from utterscope.llm.lm_score import op10_lm_score
from utterscope.llm.packing import op9_packing
from utterscope.llm.quality import op7_quality
from utterscope.llm.secrets import op2_secret_scan
from utterscope.llm.sharding import op3_sharding
from utterscope.llm.simhash import op8_simhash
from utterscope.llm.spelling import op12_spelling
from utterscope.llm.token_count import op4_token_counts
from utterscope.llm.topk import op6_topk
from utterscope.llm.vector_codes import op11_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_secret_scan": op2_secret_scan,
        "op3_sharding": op3_sharding,
        "op4_token_counts": op4_token_counts,
        "op5_decontamination": op5_decontamination,
        "op6_topk": op6_topk,
        "op7_quality": op7_quality,
        "op8_simhash": op8_simhash,
        "op9_packing": op9_packing,
        "op10_lm_score": op10_lm_score,
        "op11_vector_codes": op11_vector_codes,
        "op12_spelling": op12_spelling,
        "op13_bpe_codec": op13_bpe_codec,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_sharding": sharding.ORACLE_SQL,
        "op5_decontamination": decontaminate.ORACLE_SQL,
        "op6_topk": topk.ORACLE_SQL,
        "op9_packing": packing.ORACLE_SQL,
        "op10_lm_score": lm_score.ORACLE_SQL,
        "op11_vector_codes": vector_codes.ORACLE_SQL,
        "op12_spelling": spelling.ORACLE_SQL,
    }
