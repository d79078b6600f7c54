"""Thresholds and the significance predicates of each module (their strictness differs)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from isoframe.functions.columns import col


@dataclass(frozen=True)
class Thresholds:
    splicing_fdr: float = 0.05
    splicing_dpsi: float = 0.10
    deg_padj: float = 0.05
    deg_abs_log2fc: float = 1.0
    dexseq_qvalue: float = 0.10
    dtu_qvalue: float = 0.05
    program_delta_dpsi: float = 0.10


#: Named presets.
PRESETS = {
    "default": Thresholds(splicing_fdr=0.05, splicing_dpsi=0.10, program_delta_dpsi=0.10, deg_padj=0.05, deg_abs_log2fc=1.0, dexseq_qvalue=0.10, dtu_qvalue=0.05),
    "relaxed": Thresholds(splicing_fdr=0.10, splicing_dpsi=0.05, program_delta_dpsi=0.08, deg_padj=0.10, deg_abs_log2fc=0.5, dexseq_qvalue=0.10, dtu_qvalue=0.10),
    "strict": Thresholds(splicing_fdr=0.05, splicing_dpsi=0.20, program_delta_dpsi=0.15, deg_padj=0.01, deg_abs_log2fc=1.5, dexseq_qvalue=0.01, dtu_qvalue=0.01),
}


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def event_significant(fdr: Column | str, dpsi: Column | str, t: Thresholds) -> Column:
    """Landscape and program comparison: FDR below, effect at or above."""
    return _true((col(fdr) < t.splicing_fdr) & (F.abs(col(dpsi)) >= t.splicing_dpsi))


def integration_significant(fdr: Column | str, dpsi: Column | str, t: Thresholds) -> Column:
    """Gene integration: FDR below, effect above."""
    return _true((col(fdr) < t.splicing_fdr) & (F.abs(col(dpsi)) > t.splicing_dpsi))


def summary_significant(fdr: Column | str, dpsi: Column | str, t: Thresholds) -> Column:
    """Cards and event summaries: both limits included."""
    return _true((col(fdr) <= t.splicing_fdr) & (F.abs(col(dpsi)) >= t.splicing_dpsi))


def deg_significant(padj: Column | str, log2fc: Column | str, t: Thresholds) -> Column:
    """Gene integration: adjusted p at or below, effect above."""
    return _true((col(padj) <= t.deg_padj) & (F.abs(col(log2fc)) > t.deg_abs_log2fc))


def below(q: Column | str, limit: float) -> Column:
    return _true(col(q) < limit)
