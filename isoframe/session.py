"""Library entry points: an analysis over a project, module by module."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.catalog import Project, RunLog
from isoframe.functions.thresholds import PRESETS, Thresholds
from isoframe.operators import programs as P
from isoframe.operators import selection as L
from isoframe.sources import tables as R


class Analysis:
    """The queries of a project; everything is lazy and composed of the same operators."""

    #: Names of the files of each support layer, the more exact first.
    SUPPORT_FILES = {"suppa": [("", ".dpsi")], "exons": [("perGeneQValue", ".csv")], "transcripts": [("perGeneQValue", ".tsv"), ("DEXSeqResults", ".tsv"), ("getAdjustedPValues", ".tsv")]}

    def __init__(self, spark: SparkSession, project: Project, thresholds: Thresholds = PRESETS["default"], mode: str = "JC", annotation: str | None = None, support: dict[str, DataFrame | str] | None = None, log: RunLog | None = None):
        """``support``: tables ``suppa``, ``exons`` and ``transcripts``, or folders in which each comparison's file is looked for."""
        self.spark, self.project, self.t, self.mode = spark, project, thresholds, mode
        self.annotation = R.read_annotation(spark, annotation) if annotation else None
        self.support, self.log = support or {}, log or RunLog()
        self._events: DataFrame | None = None

    def _union(self, frames: list[DataFrame | None], schema: str) -> DataFrame:
        there = [f for f in frames if f is not None]
        return reduce(DataFrame.unionByName, there) if there else self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        """Events of all selected comparisons, parsed once and kept for the queries that follow."""
        if self._events is None:
            self._events = self._read_events().persist()
        return self._events

    def _read_events(self) -> DataFrame:
        columns = ["comparison", "event_type", "gene_id", "gene_symbol", "fdr", "dpsi", "event_uid", "coordinates", "psi1", "psi2"]
        frames = [R.read_events(self.spark, c.event_folder, c.comparison_id, self.mode, c.reverse_splicing) for c in self.project.selected() if c.event_folder]
        return self._union([f.select(*columns) for f in frames if f is not None], "comparison string, event_type string, gene_id string, gene_symbol string, fdr double, dpsi double, event_uid string, coordinates string, psi1 double, psi2 double")

    def deg(self) -> DataFrame:
        frames = [R.read_deg(self.spark, c.deg_path, c.comparison_id, c.reverse_deg) for c in self.project.selected() if c.deg_path]
        return self._union(frames, "comparison string, gene_id string, log2fc double, padj double, base_mean double, symbol string")

    def splicing_landscape(self) -> DataFrame:
        return P.landscape(self.events(), self.t, self.project.frame(self.spark))

    def program_comparison(self) -> tuple[DataFrame, DataFrame]:
        events = self.events()
        pairs = reduce(DataFrame.unionByName, [P.compare_pair(events, a, b, self.t) for a, b in self.project.pairs])
        return pairs, P.program_summary(pairs)

    def shortlist(self, n: int = 12) -> DataFrame:
        return P.shortlist_top(P.shortlist_rank(self.program_comparison()[0]), n)

    def _layer(self, name: str, schema: str) -> DataFrame:
        given = self.support.get(name)
        if isinstance(given, str):
            read = R.read_local_events if name == "suppa" else R.read_features
            columns = [part.split()[0] for part in schema.split(", ")]
            frames = []
            for c in self.project.selected():
                path = R.find_support_file(self.spark, given, c.source_name(name), self.SUPPORT_FILES[name])
                frame = read(self.spark, path, c.comparison_id) if path else None
                frames.append(frame.select(*columns) if frame is not None else None)
            return self._union(frames, schema)
        return given if given is not None else self.spark.createDataFrame([], schema)

    def mechanism_support(self) -> DataFrame:
        features = "comparison string, gene_id string, q double, symbol string"
        return P.mechanism_union(self.deg(), self._layer("suppa", "comparison string, event_id string, pvalue double, dpsi double"), self._layer("exons", features), self._layer("transcripts", features), self.t)

    def gene_integration(self) -> DataFrame:
        genes = P.gene_integration(self.events(), self.deg(), self.t)
        if self.annotation is None:
            return genes
        named = genes.join(self.annotation, "gene_id", "left")
        return named.selectExpr(*[f"coalesce(symbol, {c}) as {c}" if c == "gene_symbol" else c for c in genes.columns])

    def candidates(self) -> DataFrame:
        return P.candidates(self.gene_integration(), self.mechanism_support(), self.events(), self.t)

    def cross_matrix(self) -> DataFrame:
        listed = self.spark.createDataFrame([(g,) for g in self.project.blacklist], "gene string")
        return P.cross_matrix(P.without_listed(self.candidates(), listed, ["gene_symbol", "gene_id"]), [c.comparison_id for c in self.project.selected()], ordered=bool(self.project.order))

    def significant_patterns(self, a: str, b: str, abs_dpsi: float, large: float) -> DataFrame:
        return P.pattern_sets(P.significant_patterns(self.events(), a, b, abs_dpsi, large))

    def select_candidates(self, source: str = "selection", top_n: int = 20, genes: DataFrame | None = None) -> DataFrame:
        """Candidates by source, without those left out by hand; a selection is the project's, where it has one."""
        ranked = self.candidates()
        short = self.spark.createDataFrame([(g,) for g in sorted({g.lower() for g in self.project.shortlist})], "gene string")
        mark = F.coalesce(F.col("_there"), F.lit(False))
        for c in ("gene_symbol", "gene_id"):
            ranked = ranked.join(F.broadcast(short.withColumn("_there", F.lit(True)).withColumnRenamed("gene", "_g")), F.lower(c) == F.col("_g"), "left").withColumn(f"_short_{c}", mark).drop("_g", "_there")
        ranked = ranked.withColumn("shortlisted", F.col("_short_gene_symbol") | F.col("_short_gene_id")).drop("_short_gene_symbol", "_short_gene_id")
        if source == "selection" and genes is None and any(self.project.chosen.values()):
            genes = self.project.genes_frame(self.spark, "chosen")
        return L.select_candidates(ranked, source, top_n, genes, self.project.genes_frame(self.spark, "left_out"))

    def candidate_catalog(self) -> DataFrame:
        return self.candidates().orderBy("comparison", F.asc_nulls_last("rank"), "gene_symbol")

    def event_catalog(self) -> DataFrame:
        return L.event_catalog(self.events()).orderBy(*L.catalog_order())

    def event_manifest(self, chosen: DataFrame, bams: DataFrame) -> DataFrame:
        """Chosen events (event_uid) in every comparison that has them, with the alignment files (group, bam) of both groups."""
        return P.manifest(*L.events_for_manifest(L.event_catalog(self.events()), chosen, self.project.frame(self.spark)), bams)

    def gene_cards(self, expression: DataFrame, source: str = "selection", top_n: int = 20) -> DataFrame:
        return L.gene_cards(self.select_candidates(source, top_n), P.dominant_event(self.events(), self.t), expression)

    def isoform_followup(self, source: str = "shortlist", top_n: int = 20) -> DataFrame:
        return L.isoform_followup(self.select_candidates(source, top_n))

    def event_followup(self, source: str = "selection", top_n: int = 20) -> DataFrame:
        return L.event_followup(self.select_candidates(source, top_n), P.dominant_event(self.events(), self.t))

    def problems(self) -> list[str]:
        """Messages on input tables of the project that can't be read or lack columns."""
        out = []
        for c in self.project.comparisons:
            if c.event_folder:
                out += R.missing_columns(self.spark, f"{c.event_folder}/SE.MATS.{self.mode}.txt", "events")
            if c.deg_path:
                out += R.missing_columns(self.spark, c.deg_path, "deg")
        return out
