"""Queries and SQL of this subpackage, added to the entry module where the subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isoframe.llm import collocation, license_scan, url_filter
from isoframe.llm.alignment import op12_token_alignment
from isoframe.llm.ann import op7_nearest
from isoframe.llm.cutting import op13_cutting_stock
from isoframe.llm.jaccard import op2_ngram_jaccard
from isoframe.llm.language import op10_language
from isoframe.llm.mixing import op9_mixing
from isoframe.llm.packing import op8_packing
from isoframe.llm.quality import op3_quality
from isoframe.llm.token_store import op1_token_store
from isoframe.llm.toxicity import op5_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": op1_token_store,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_quality": op3_quality,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_toxicity": op5_toxicity,
        "op6_license_scan": license_scan.op6_license_scan,
        "op7_nearest": op7_nearest,
        "op8_packing": op8_packing,
        "op9_mixing": op9_mixing,
        "op10_language": op10_language,
        "op11_collocations": collocation.op11_collocations,
        "op12_token_alignment": op12_token_alignment,
        "op13_cutting_stock": op13_cutting_stock,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": url_filter.ORACLE_SQL,
        "op6_license_scan": license_scan.ORACLE_SQL,
        "op11_collocations": collocation.ORACLE_SQL,
    }
