"""Queries over exons, inclusion levels, reads, posteriors and matrices, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoframe.operators import matrices as M
from isoframe.operators import reads as R
from isoframe.operators import splice as S
from isoframe.plans import proxies as X
from isoframe.plans.proxies import with_

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_CH = dict(
    ch="SELECT *, lead(s, 1) OVER w AS s2, lead(e, 1) OVER w AS e2, lead(s, 2) OVER w AS s3, lead(e, 2) OVER w AS e3, row_number() OVER w AS place, row_number() OVER (PARTITION BY gene, tx ORDER BY s DESC, e DESC) AS from_end FROM exons WINDOW w AS (PARTITION BY gene, tx ORDER BY s, e)",
    tri="SELECT DISTINCT gene, chr, strand, e AS e1, s2, e2, s3, tx FROM ch WHERE s3 IS NOT NULL",
    jun="SELECT DISTINCT gene, chr, strand, s AS s1, e AS e1, s2, e2, tx FROM ch WHERE s2 IS NOT NULL",
)


def _ev_sql(kind: str, coords: str, source: str) -> str:
    return f"SELECT gene || ';' || {kind} || ':' || chr || ':' || {coords} || ':' || strand AS event_id, p AS pos, q AS neg FROM {source}"


_OUT = "SELECT event_id, array_to_string(list_sort(list_distinct(list(pos))), ',') AS alternative, array_to_string(list_sort(list_distinct(list_concat(list(pos), list(neg)))), ',') AS total FROM x GROUP BY event_id"


def _flat(events):
    return events.select("event_id", F.array_join("alternative", ",").alias("alternative"), F.array_join("total", ",").alias("total"))


_SE = _ev_sql("'SE'", "a.e1 || '-' || a.s2 || ':' || a.e2 || '-' || a.s3", "(SELECT a.*, a.tx AS p, b.tx AS q FROM tri a JOIN jun b ON a.gene = b.gene AND a.chr = b.chr AND a.strand = b.strand AND a.e1 = b.e1 AND a.s3 = b.s2) a")


@query("se_events", with_("exons", **_CH, x=_SE) + _OUT)
def se_events(spark, d):
    return _flat(S.skipped_exons(X.exons(spark, d)))


@query("ri_events", with_("exons", **_CH, x=_ev_sql("'RI'", "s1 || ':' || e1 || '-' || s2 || ':' || e2", "(SELECT a.*, b.tx AS p, a.tx AS q FROM jun a JOIN exons b ON a.gene = b.gene AND a.s1 = b.s AND a.e2 = b.e) a")) + _OUT)
def ri_events(spark, d):
    return _flat(S.retained_introns(X.exons(spark, d)))


@query("mx_events", with_("exons", **_CH, k="SELECT gene, chr, strand, e1, s2, e2, s3, list(DISTINCT tx) AS txs FROM tri GROUP BY ALL", x="SELECT a.gene || ';MX:' || a.chr || ':' || a.e1 || '-' || a.s2 || ':' || a.e2 || '-' || a.s3 || ':' || b.e1 || '-' || b.s2 || ':' || b.e2 || '-' || b.s3 || ':' || a.strand AS event_id, a.txs AS pos, b.txs AS neg FROM k a JOIN k b ON a.gene = b.gene AND a.e1 + a.s3 = b.e1 + b.s3 AND a.e2 < b.s2") + "SELECT event_id, array_to_string(list_sort(list_distinct(flatten(list(pos)))), ',') AS alternative, array_to_string(list_sort(list_distinct(list_concat(flatten(list(pos)), flatten(list(neg))))), ',') AS total FROM x GROUP BY event_id")
def mx_events(spark, d):
    return _flat(S.exclusive_exons(X.exons(spark, d)))


_A = dict(
    x="""SELECT a.gene || ';' || CASE WHEN a.strand = '-' THEN 'A3' ELSE 'A5' END || ':' || a.chr || ':' || a.e1 || '-' || a.s2 || ':' || b.e1 || '-' || b.s2 || ':' || a.strand AS event_id, a.tx AS pos, b.tx AS neg FROM jun a JOIN jun b ON a.gene = b.gene AND a.s2 = b.s2 AND a.s1 < b.e1 AND b.e1 < a.e1
    UNION ALL SELECT a.gene || ';' || CASE WHEN a.strand = '-' THEN 'A5' ELSE 'A3' END || ':' || a.chr || ':' || a.e1 || '-' || a.s2 || ':' || b.e1 || '-' || b.s2 || ':' || a.strand, a.tx, b.tx FROM jun a JOIN jun b ON a.gene = b.gene AND a.e1 = b.e1 AND a.s2 < b.s2 AND b.s2 < a.e2"""
)


@query("a5_a3_events", with_("exons", **_CH, **_A) + _OUT)
def a5_a3_events(spark, d):
    return _flat(S.alternative_sites(X.exons(spark, d)))


_AF = dict(
    f="SELECT gene, chr, strand, s AS s1, e AS e1, s2, tx FROM ch WHERE place = 1 AND s2 IS NOT NULL", l="SELECT gene, chr, strand, e AS e1, s2, e2, tx FROM ch WHERE from_end = 2",
    x="""SELECT a.gene || ';' || CASE WHEN a.strand = '-' THEN 'AL' ELSE 'AF' END || ':' || a.chr || ':' || a.s1 || ':' || a.e1 || '-' || a.s2 || ':' || b.s1 || ':' || b.e1 || '-' || b.s2 || ':' || a.strand AS event_id, a.tx AS pos, b.tx AS neg FROM f a JOIN f b ON a.gene = b.gene AND a.s2 = b.s2 AND a.e1 < b.s1
    UNION ALL SELECT a.gene || ';' || CASE WHEN a.strand = '-' THEN 'AF' ELSE 'AL' END || ':' || a.chr || ':' || a.e1 || '-' || a.s2 || ':' || a.e2 || ':' || b.e1 || '-' || b.s2 || ':' || b.e2 || ':' || a.strand, a.tx, b.tx FROM l a JOIN l b ON a.gene = b.gene AND a.e1 = b.e1 AND b.s2 > a.e2""",
)


@query("af_al_events", with_("exons", **_CH, **_AF) + _OUT)
def af_al_events(spark, d):
    return _flat(S.alternative_ends(X.exons(spark, d)))


@query("variable_merge", with_("exons", **_CH, k="SELECT gene, e1, s2, list(DISTINCT tx) AS txs FROM jun GROUP BY ALL") + "SELECT a.gene, a.e1, a.s2, array_to_string(list_sort(list_distinct(flatten(list(b.txs)))), ',') AS txs, count(*) AS n_merged FROM k a JOIN k b ON a.gene = b.gene AND abs(a.e1 - b.e1) <= 60 AND abs(a.s2 - b.s2) <= 60 GROUP BY ALL")
def variable_merge(spark, d):
    j = S.chains(X.exons(spark, d)).where("s2 is not null").groupBy("gene", "e1", "s2").agg(F.collect_set("tx").alias("txs"))
    return S.merged_variants(j, ["gene"], ["e1", "s2"], 60).withColumn("txs", F.array_join("txs", ","))


_SPANS = "SELECT {0}, min(s) AS s, max(e) AS e FROM exons2 GROUP BY ALL"
_SHIFT = "SELECT gene, chr, strand, tx, s + (substr(gene, 2)::INT % 50) * 4000 AS s, e + (substr(gene, 2)::INT % 50) * 4000 AS e FROM exons"


def _moved(spark, d):
    shift = F.regexp_extract("gene", "[0-9]+", 0).cast("long") % 50 * 4000
    return X.exons(spark, d).withColumn("start", F.col("start") + shift).withColumn("end", F.col("end") + shift)


@query("gene_pooling", with_("exons", exons2=_SHIFT, sp=_SPANS.format("gene, chr, strand"), r="SELECT *, max(e) OVER (PARTITION BY chr, strand ORDER BY s, e, gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp", i="SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chr, strand ORDER BY s, e, gene ROWS UNBOUNDED PRECEDING) AS island FROM r", n="SELECT chr, strand, island, string_agg(gene, '_and_' ORDER BY gene) AS pooled FROM i GROUP BY ALL") + "SELECT gene, pooled FROM i JOIN n USING (chr, strand, island)")
def gene_pooling(spark, d):
    return S.pooled_genes(_moved(spark, d)).select("gene", "pooled")


@query("locus_split", with_("exons", exons2="SELECT gene, chr, strand, tx, s + substr(tx, 2)::BIGINT % 5 * 20000 AS s, e + substr(tx, 2)::BIGINT % 5 * 20000 AS e FROM exons", sp=_SPANS.format("gene, chr, strand, tx"), r="SELECT *, max(e) OVER (PARTITION BY gene ORDER BY s, e, tx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp", i="SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY gene ORDER BY s, e, tx ROWS UNBOUNDED PRECEDING)::BIGINT AS locus FROM r") + "SELECT gene, tx, locus FROM i")
def locus_split(spark, d):
    away = F.substring("tx", 2, 20).cast("long") % 5 * 20000  # transcripts of a gene in five places
    return S.split_loci(X.exons(spark, d).withColumn("start", F.col("start") + away).withColumn("end", F.col("end") + away)).select("gene", "tx", "locus")


@query("constitutive_exons", with_("exons", f="SELECT 'g' || (substr(tx, 2)::BIGINT // 3) AS gene, tx, s, e FROM exons", n="SELECT gene, count(DISTINCT tx) AS n FROM f GROUP BY 1") + "SELECT gene, s AS \"start\", e AS \"end\" FROM f JOIN n USING (gene) GROUP BY gene, s, e, n HAVING count(DISTINCT tx) = n")
def constitutive_exons(spark, d):
    small = F.concat(F.lit("g"), F.floor(F.substring("tx", 2, 20).cast("long") / 3).cast("string"))  # genes of three transcripts
    return S.constitutive_exons(X.exons(spark, d).withColumn("gene", small))


_SE_LISTS = """SELECT gene || ';SE:' || chr || ':' || e1 || '-' || s2 || ':' || e2 || '-' || s3 || ':' || strand AS event_id, array_to_string(list_sort(p), ',') AS alternative, array_to_string(list_sort(list_distinct(list_concat(p, q))), ',') AS total
FROM (SELECT gene, chr, strand, e1, s2, e2, s3, list(DISTINCT tx) AS p FROM tri GROUP BY ALL) JOIN (SELECT gene, chr, strand, e1, s2 AS s3, list(DISTINCT tx) AS q FROM jun GROUP BY ALL) USING (gene, chr, strand, e1, s3)"""
_PSI = dict(
    ex="SELECT event_id, alternative, unnest(string_split(total, ',')) AS tx FROM se", known="SELECT DISTINCT tx FROM tpm",
    m="SELECT ex.*, list_contains(string_split(alternative, ','), ex.tx) AS alt, k.tx IS NOT NULL AS known FROM ex LEFT JOIN known k ON k.tx = ex.tx",
    wh="SELECT event_id, bool_and(known) AS whole FROM m GROUP BY 1", su="SELECT event_id, sample, cond, sum(tpm) FILTER (WHERE alt) AS a, sum(tpm) AS t FROM m JOIN tpm USING (tx) GROUP BY ALL",
    psi="SELECT event_id, sample, cond, CASE WHEN whole AND t > 0 THEN coalesce(a, 0) / t END AS psi FROM su JOIN wh USING (event_id)",
)
_PW = with_("exons", "tpm", **_CH, se=_SE_LISTS, **_PSI)


def _sums(spark, d):
    return S.skipped_exon_sums(X.exons(spark, d), X.tpm(spark, d).select("tx", "sample", "tpm"))


def _psi(spark, d):
    return S.inclusion(_sums(spark, d))


@query("psi_event", _PW + "SELECT event_id, sample, round(psi, 9) AS psi FROM psi")
def psi_event(spark, d):
    return _psi(spark, d).withColumn("psi", F.round("psi", 9))


@query("psi_isoform", with_("tpm") + "SELECT gene, tx, sample, round(tpm / nullif(sum(tpm) OVER (PARTITION BY gene, sample), 0), 9) AS psi FROM tpm")
def psi_isoform(spark, d):
    return S.isoform_psi(X.tpm(spark, d)).withColumn("psi", F.round("psi", 9))


def _cond(spark):
    return spark.createDataFrame([("s0", "c1"), ("s1", "c1"), ("s2", "c2"), ("s3", "c2")], "sample string, cond string")


_DPSI = "SELECT event_id, CASE WHEN count(*) FILTER (WHERE psi IS NULL) = 0 AND count(DISTINCT cond) = 2 THEN avg(psi) FILTER (WHERE cond = 'c2') - avg(psi) FILTER (WHERE cond = 'c1') END AS dpsi FROM psi GROUP BY 1"


@query("delta_psi", _PW + f"SELECT event_id, round(dpsi, 6) AS dpsi FROM ({_DPSI})")
def delta_psi(spark, d):
    return S.delta_psi(_psi(spark, d).join(F.broadcast(_cond(spark)), "sample"), "c1", "c2").withColumn("dpsi", F.round("dpsi", 6))


_AB = dict(rs="SELECT event_id, sample, cond, sum(tpm) AS t FROM ex JOIN tpm USING (tx) GROUP BY ALL", bc="SELECT event_id, cond, avg(CASE WHEN t > 0 THEN log10(t) END) AS m FROM rs GROUP BY ALL", ab="SELECT event_id, avg(m) AS abundance FROM bc GROUP BY 1 HAVING count(m) = 2 AND avg(m) <> 0")


@query("event_abundance", with_("exons", "tpm", **_CH, se=_SE_LISTS, **_PSI, **_AB) + "SELECT event_id, round(abundance, 6) AS abundance FROM ab")
def event_abundance(spark, d):
    return S.abundance(_sums(spark, d), _cond(spark)).withColumn("abundance", F.round("abundance", 6))


_REP = "SELECT a.event_id, a.cond, a.sample AS s1, b.sample AS s2, abs(a.psi - b.psi) AS delta, abundance FROM psi a JOIN psi b ON a.event_id = b.event_id AND a.cond = b.cond AND a.sample < b.sample JOIN ab ON ab.event_id = a.event_id WHERE a.psi IS NOT NULL AND b.psi IS NOT NULL"


@query("replicate_pairs", with_("exons", "tpm", **_CH, se=_SE_LISTS, **_PSI, **_AB) + f"SELECT event_id, cond, round(delta, 6) AS delta, round(abundance, 6) AS abundance FROM ({_REP})")
def replicate_pairs(spark, d):
    sums, cond = _sums(spark, d), _cond(spark)
    r = S.replicate_deltas(S.inclusion(sums).join(F.broadcast(cond), "sample"), S.abundance(sums, cond))
    return r.select("event_id", "cond", F.round("delta", 6).alias("delta"), F.round("abundance", 6).alias("abundance"))


_EMP = dict(
    r0=f"SELECT event_id, cond, s1, s2, round(delta, 9) AS delta, round(abundance, 6) AS abundance FROM ({_REP})",
    r1="SELECT *, row_number() OVER (ORDER BY abundance, delta, event_id, cond, s1, s2) - 1 AS i FROM r0", av="SELECT abundance, min(i) AS i FROM r1 GROUP BY 1",
    e0=f"SELECT event_id, round(dpsi, 9) AS dpsi, round(abundance, 6) AS abundance FROM ({_DPSI}) JOIN ab USING (event_id) WHERE dpsi IS NOT NULL",
    lo="SELECT e0.*, av.abundance AS la, av.i AS li FROM e0 ASOF LEFT JOIN av ON e0.abundance >= av.abundance", hi="SELECT lo.*, av.abundance AS ha, av.i AS hi FROM lo ASOF LEFT JOIN av ON lo.abundance <= av.abundance",
    fi="SELECT *, greatest(0, least(CASE WHEN la IS NULL OR ha - abundance < abundance - la THEN hi ELSE li END - 100, greatest(0, (SELECT count(*) FROM r1) - 200))) AS a FROM hi",
)


@query("empirical_p", with_("exons", "tpm", **_CH, se=_SE_LISTS, **_PSI, **_AB, **_EMP) + "SELECT fi.event_id, round((1 - count(*) FILTER (WHERE delta <= abs(dpsi))::DOUBLE / count(*)) * 0.5, 9) AS p FROM fi JOIN r1 ON r1.i >= a AND r1.i < a + least(200, (SELECT count(*) FROM r1)) GROUP BY fi.event_id, dpsi")
def empirical_p(spark, d):
    sums, cond = _sums(spark, d), _cond(spark)
    psi = S.inclusion(sums).join(F.broadcast(cond), "sample")
    ab = S.abundance(sums, cond).withColumn("abundance", F.round("abundance", 6))
    events = S.delta_psi(psi, "c1", "c2").where("dpsi is not null").join(ab, "event_id").withColumn("dpsi", F.round("dpsi", 9))
    return S.empirical_p(events, S.replicate_deltas(psi, ab).withColumn("delta", F.round("delta", 9)), 200).withColumn("p", F.round("p", 9))


#: Two replicates a condition: exact where all four values differ (of the 6 choices of two ranks one each gives U = 0 and 1), else the corrected normal.
_MW = dict(
    v="SELECT event_id, cond, round(psi, 9) AS psi FROM psi WHERE psi IS NOT NULL", c="SELECT event_id, min(cond) AS c1 FROM v GROUP BY 1",
    k="SELECT v.*, c1, rank() OVER (PARTITION BY v.event_id ORDER BY psi) + (count(*) OVER (PARTITION BY v.event_id, psi) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY v.event_id, psi) AS t FROM v JOIN c USING (event_id)",
    g="SELECT event_id, coalesce(sum(r) FILTER (WHERE cond = c1), 0) AS r1, count(*) FILTER (WHERE cond = c1)::DOUBLE AS n1, count(*)::DOUBLE AS n, sum(t * t - 1) AS ties FROM k GROUP BY 1",
    h="SELECT *, n - n1 AS n2, r1 - n1 * (n1 + 1) / 2 AS u, n1 * (n - n1) / 12 * ((n + 1) - ties / greatest(n * (n - 1), 1.0)) AS var FROM g",
    z="SELECT *, greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(greatest(var, 1e-12)) / sqrt(2.0) AS x FROM h", zt="SELECT *, 1 / (1 + 0.3275911 * x) AS q FROM z",
)


@query("mann_whitney", with_("exons", "tpm", **_CH, se=_SE_LISTS, **_PSI, **_MW) + """SELECT event_id, round(CASE WHEN n1 = 0 OR n2 = 0 OR (var <= 0) THEN 1
  WHEN ties = 0 AND n1 = 2 AND n2 = 2 THEN least(1, 2 * CASE least(u, 4 - u) WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END / 6.0::DOUBLE)
  WHEN ties = 0 THEN least(1, 2 * (1 + least(u, n1 * n2 - u)) / n)
  ELSE least(1, q * (0.254829592 + q * (-0.284496736 + q * (1.421413741 + q * (-1.453152027 + q * 1.061405429)))) * exp(-x * x)) END, 9) AS p FROM zt""")
def mann_whitney(spark, d):
    return S.mann_whitney(_psi(spark, d).withColumn("psi", F.round("psi", 9)).join(F.broadcast(_cond(spark)), "sample")).withColumn("p", F.round("p", 9))


@query("diff_splice", f"WITH mw AS ({SQL['mann_whitney']}), dp AS ({_PW}SELECT event_id, round(dpsi, 6) AS dpsi FROM ({_DPSI.replace('avg(psi)', 'avg(round(psi, 9))')})), " + """r AS (SELECT event_id, dpsi, p, split_part(event_id, ';', 1) AS gene FROM dp JOIN mw USING (event_id) WHERE dpsi IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY p, event_id) AS i, count(*) OVER (PARTITION BY gene) AS m FROM r)
SELECT 'c1' AS cond1, 'c2' AS cond2, event_id, dpsi, round(least(min(p * m / i) OVER (PARTITION BY gene ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 6) AS p FROM k
UNION ALL SELECT 'c1', 'c2', event_id, NULL, 1.0 FROM dp WHERE dpsi IS NULL""")
def diff_splice(spark, d):
    psi = _psi(spark, d).withColumn("psi", F.round("psi", 9)).join(F.broadcast(_cond(spark)), "sample")
    return S.diff_splice(psi, ["c1", "c2"], method="classical", by_gene=True).withColumn("dpsi", F.round("dpsi", 6)).withColumn("p", F.round("p", 6))


_BH = "SELECT comparison, gene_id, padj AS p, count(*) OVER ({0}) AS m, row_number() OVER ({0} ORDER BY padj, gene_id, comparison) AS r FROM deg"


@query("bh_global", with_("deg", k=_BH.format("")) + "SELECT comparison, gene_id, round(least(min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 9) AS fdr FROM k")
def bh_global(spark, d):
    return S.bh(X.deg(spark, d).withColumnRenamed("padj", "p"), key=["gene_id", "comparison"]).select("comparison", "gene_id", F.round("fdr", 9).alias("fdr"))


@query("bh_by_group", with_("deg", k=_BH.format("PARTITION BY comparison")) + "SELECT comparison, gene_id, round(least(min(p * m / r) OVER (PARTITION BY comparison ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 9) AS fdr FROM k")
def bh_by_group(spark, d):
    return S.bh(X.deg(spark, d).withColumnRenamed("padj", "p"), by=["comparison"], key=["gene_id", "comparison"]).select("comparison", "gene_id", F.round("fdr", 9).alias("fdr"))


@query("log10_pvals", with_("deg") + "SELECT comparison, gene_id, round(-log10(CASE WHEN padj = 0 THEN (SELECT min(padj) FROM deg WHERE padj <> 0) / 2 ELSE padj END), 6) AS log10p, padj < 0.05 AS significant FROM deg")
def log10_pvals(spark, d):
    return S.log10_p(X.deg(spark, d), "padj").select("comparison", "gene_id", F.round("log10p", 6).alias("log10p"), "significant")


@query("join_files", with_("deg") + "SELECT gene_id AS id, max(log2fc) FILTER (WHERE comparison = 'A') AS a, max(log2fc) FILTER (WHERE comparison = 'N' AND padj < 0.05) AS n FROM deg WHERE comparison = 'A' OR (comparison = 'N' AND padj < 0.05) GROUP BY 1")
def join_files(spark, d):
    x = X.deg(spark, d).select(F.col("gene_id").alias("id"), F.col("log2fc").alias("value"), "comparison", "padj")
    return S.joined_files([("a", x.where("comparison = 'A'")), ("n", x.where("comparison = 'N' and padj < 0.05"))])


@query("field_select", "SELECT o_custkey::VARCHAR AS id, coalesce(arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, coalesce(arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'O'), 0) AS o FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def field_select(spark, d):
    x = X.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"), "o_orderstatus")
    return S.selected_fields([("f", x.where("o_orderstatus = 'F'")), ("o", x.where("o_orderstatus = 'O'"))])


# reads
_BLK = """b0 AS (SELECT row_number() OVER () AS rid, sample, strand, pos, unnest(regexp_extract_all(cigar, '([0-9]+)([A-Z])', 1))::BIGINT AS n, unnest(regexp_extract_all(cigar, '([0-9]+)([A-Z])', 2)) AS op, generate_subscripts(regexp_extract_all(cigar, '([0-9]+)([A-Z])', 1), 1) AS k FROM reads),
b1 AS (SELECT *, pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N') THEN n ELSE 0 END) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM b0)"""


@query("coverage", with_("reads") + "," + _BLK + ", st AS (SELECT sample, st::BIGINT AS pos, 1 AS d FROM b1 WHERE op = 'M' UNION ALL SELECT sample, (st + n)::BIGINT, -1 FROM b1 WHERE op = 'M'), g AS (SELECT sample, pos, sum(d) AS d FROM st GROUP BY ALL) SELECT sample, pos, (sum(d) OVER (PARTITION BY sample ORDER BY pos))::BIGINT AS depth FROM g")
def coverage(spark, d):
    return R.coverage(X.reads(spark, d), ["sample"])


@query("junction_counts", with_("reads") + "," + _BLK + " SELECT sample, strand, (st - 1)::BIGINT AS donor, (st + n)::BIGINT AS acceptor, count(*) AS n FROM b1 WHERE op = 'N' GROUP BY sample, strand, st, b1.n HAVING count(*) >= 2")
def junction_counts(spark, d):
    return R.junction_counts(X.reads(spark, d), ["sample", "strand"], 2)


_OVERLAID = "," + _BLK + ", j AS (SELECT sample, strand, (st - 1)::BIGINT AS donor, (st + n)::BIGINT AS acceptor, count(*) AS n FROM b1 WHERE op = 'N' GROUP BY sample, strand, st, b1.n) SELECT strand, donor, acceptor, round_even({}, 0)::BIGINT AS n FROM j GROUP BY ALL"


@query("junction_means", with_("reads") + _OVERLAID.format("avg(n)"))
def junction_means(spark, d):
    return R.overlaid_junctions(R.junction_counts(X.reads(spark, d), ["sample", "strand"]), ["strand"])


@query("junction_medians", with_("reads") + _OVERLAID.format("median(n)"))
def junction_medians(spark, d):
    return R.overlaid_junctions(R.junction_counts(X.reads(spark, d), ["sample", "strand"]), ["strand"], "median")


@query("intron_islands", with_("reads") + "," + _BLK + ", iv AS (SELECT DISTINCT sample, (st * 50)::BIGINT AS s, (st * 50 + n)::BIGINT AS e FROM b1 WHERE op = 'N'), r AS (SELECT *, max(e) OVER (PARTITION BY sample ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY sample ORDER BY s, e ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM r), g AS (SELECT sample, island, max(s) AS \"start\", min(e) AS \"end\" FROM i GROUP BY ALL) SELECT *, round(pow(\"end\" - \"start\", 0.7), 6) AS shrunk FROM g WHERE \"start\" < \"end\"")
def intron_islands(spark, d):
    n = R.aligned_blocks(X.reads(spark, d)).where("kind = 'N'").select("sample", (F.col("start") * 50).alias("start"), (F.col("start") * 49 + F.col("end") + 1).alias("end")).distinct()
    return R.intron_islands(n, ["sample"]).withColumn("shrunk", F.round("shrunk", 6))


@query("rpkm", "SELECT l_partkey, round(count(*) / ((l_partkey % 900 + 100) / 1000.0) / 1.5::DOUBLE, 6) AS rpkm FROM lineitem GROUP BY 1")
def rpkm(spark, d):
    c = X.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).withColumn("length", F.col("l_partkey") % 900 + 100)
    return R.rpkm(c, 1_500_000).select("l_partkey", F.round("rpkm", 6).alias("rpkm"))


@query("insert_len", "WITH x AS (SELECT (o_totalprice % 300)::DOUBLE AS length FROM orders WHERE o_totalprice % 300 > 0), m AS (SELECT avg(length) AS m, stddev_pop(length) AS s FROM x), k AS (SELECT length FROM x, m WHERE abs(length - m) <= 1.5 * s) SELECT min(length) AS least, max(length) AS most, round(avg(length), 6) AS mean, round(stddev_pop(length), 6) AS sd, count(*) AS n, round(stddev_pop(length) / sqrt(avg(length)), 6) AS dispersion FROM k")
def insert_len(spark, d):
    x = R.insert_lengths(X.table(spark, d, "orders").select((F.col("o_totalprice") % 300).alias("length")), 1.5)
    return x.select(F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n", F.col("least").cast("double").alias("least"), F.col("most").cast("double").alias("most"), F.round("dispersion", 6).alias("dispersion"))


@query("credible_interval", with_("posterior") + "SELECT event, round(list_sum(psi1) / len(psi1), 10) AS mean, list_sort(psi1)[greatest(1, round_even(len(psi1) * 0.025, 0))::INT] AS lo, list_sort(psi1)[greatest(1, round_even(len(psi1) * 0.975, 0))::INT] AS hi FROM posterior")
def credible_interval(spark, d):
    return R.credible_interval(X.posterior(spark, d).select("event", F.col("psi1").alias("psi"))).withColumn("mean", F.round("mean", 10))


_BF = "SELECT event, d, list_sum(d) / len(d) AS delta, stddev_samp_ AS sd FROM (SELECT event, list_transform(generate_series(1, len(psi1)), lambda i: psi1[i] - psi2[i]) AS d, list_aggregate(list_transform(generate_series(1, len(psi1)), lambda i: psi1[i] - psi2[i]), 'stddev_samp') AS stddev_samp_ FROM posterior)"
_BFQ = "SELECT event, round(delta, 9) AS delta, round(CASE WHEN abs(delta) <= 0.009 THEN 0 ELSE least(1 / (list_sum(list_transform(d, lambda v: exp(-v * v / (2 * (0.3 * sd) * (0.3 * sd))))) / (len(d) * 0.3 * sd * sqrt(2 * pi()))), 1e12) END, 4) AS bf FROM bf0"


@query("kde_bayes_factor", with_("posterior", bf0=_BF) + _BFQ)
def kde_bayes_factor(spark, d):
    return R.bayes_factors(X.posterior(spark, d)).select("event", F.round("delta", 9).alias("delta"), F.round("bf", 4).alias("bf"))


@query("bf_thresholds", with_("posterior", bf0=_BF, b=_BFQ) + "SELECT t AS threshold, (SELECT count(*) FROM b WHERE bf >= t) AS n FROM (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (5.0::DOUBLE), (10.0::DOUBLE)) v(t)")
def bf_thresholds(spark, d):
    return R.threshold_counts(kde_bayes_factor(spark, d), [0.0, 1.0, 2.0, 5.0, 10.0])


@query("bf_filter", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE abs(l_discount) >= 0.05 AND l_quantity >= 10 AND ((l_partkey % 20 >= 5 AND l_suppkey % 20 >= 2 AND l_partkey % 20 + l_suppkey % 20 >= 12) OR (l_suppkey % 20 >= 5 AND l_partkey % 20 >= 2 AND l_partkey % 20 + l_suppkey % 20 >= 12))")
def bf_filter(spark, d):
    p, s = (F.col(c) % 20 for c in ("l_partkey", "l_suppkey"))
    text = lambda a, b: F.concat(F.lit("(1,0):"), a.cast("string"), F.lit(",(0,1):"), b.cast("string"), F.lit(",(1,1):3"))
    x = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("delta"), F.col("l_quantity").alias("bf"), text(p, s).alias("counts1"), text(s, p).alias("counts2"))
    return R.bayes_filter(x, 0.05, 10, 5, 2, 12).select("l_orderkey", "l_linenumber", "l_partkey")


@query("replicate_vote", "SELECT l_partkey AS event, count(*) AS n, sum(sign(l_quantity - 20))::DOUBLE AS votes FROM lineitem GROUP BY 1 HAVING count(*) >= 12 AND abs(sum(sign(l_quantity - 20))) >= 12")
def replicate_vote(spark, d):
    return R.replicate_votes(X.table(spark, d, "lineitem").select(F.col("l_partkey").alias("event"), (F.col("l_quantity") - 20).alias("delta")), 12)


@query("count_filters", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE CASE l_linenumber % 4 WHEN 0 THEN l_partkey % 9 + l_suppkey % 9 >= 10 AND l_orderkey % 3 >= 1 WHEN 1 THEN l_partkey % 9 + l_suppkey % 9 >= 20 WHEN 2 THEN l_partkey % 9 >= 1 AND l_suppkey % 9 >= 1 AND l_partkey % 9 + l_suppkey % 9 >= 20 ELSE false END")
def count_filters(spark, d):
    k = F.col("l_linenumber") % 4
    kind = F.when(k == 0, "SE").when(k == 1, "AFE").when(k == 2, "TandemUTR").otherwise("MXE")
    x = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("etype"), (F.col("l_partkey") % 9).alias("inc"), (F.col("l_suppkey") % 9).alias("exc"), (F.col("l_orderkey") % 3).alias("common"))
    return R.count_filter(x).select("l_orderkey", "l_linenumber", "l_partkey")


# matrices
@query("mad_top", with_("posterior", s="SELECT 'l' || (event % 50) AS label, event AS feature, list_sum(psi1) / len(psi1) AS m, psi1 FROM posterior", f="SELECT label, feature, round(list_sum(list_transform(psi1, lambda v: abs(v - m))) / len(psi1), 9) AS spread FROM s", o="SELECT *, row_number() OVER (PARTITION BY label ORDER BY spread DESC, feature) AS n FROM f") + "SELECT label, feature, spread FROM o WHERE n = 1 ORDER BY spread DESC, label LIMIT 20")
def mad_top(spark, d):
    x = X.posterior(spark, d).select(F.concat(F.lit("l"), (F.col("event") % 50).cast("string")).alias("label"), F.col("event").alias("feature"), F.col("psi1").alias("values"))
    return M.most_variable(x, 20).withColumn("spread", F.round("spread", 9))


@query("supervised_matrix", with_("ev", o="SELECT *, row_number() OVER (PARTITION BY gene_symbol ORDER BY abs(dpsi) DESC, fdr, event_uid) AS n FROM ev WHERE comparison = 'A' AND fdr <= 0.05 AND abs(dpsi) >= 0.2") + "SELECT gene_symbol AS label, event_uid AS feature, abs(dpsi) AS size, fdr FROM o WHERE n = 1")
def supervised_matrix(spark, d):
    x = X.ev(spark, d).where("comparison = 'A'").select(F.col("gene_symbol").alias("label"), F.col("event_uid").alias("feature"), F.col("fdr").alias("pvalue"), F.col("fdr").alias("qvalue"), "dpsi")
    return M.supervised(x, 0.05, 0.05, 0.2).select("label", "feature", F.abs("dpsi").alias("size"), F.col("qvalue").alias("fdr"))


@query("row_zscore", with_("tpm") + "SELECT tx AS feature, sample, round((tpm - avg(tpm) OVER (PARTITION BY tx)) / nullif(stddev_samp(tpm) OVER (PARTITION BY tx), 0), 6) AS z FROM tpm")
def row_zscore(spark, d):
    return M.row_zscores(X.tpm(spark, d).select(F.col("tx").alias("feature"), "sample", F.col("tpm").alias("value"))).withColumn("z", F.round("z", 6))


@query("heatmap_aggregate", with_("ev", r="SELECT gene_symbol AS g, event_uid AS f, min(dpsi) AS dpsi, max(fdr) AS ref, sum(fdr) AS psi FROM ev WHERE comparison = 'A' GROUP BY ALL", s="SELECT g, max(abs(dpsi)) AS m, arg_max(dpsi, (ref, f)) AS sg FROM r GROUP BY 1 HAVING max(abs(dpsi)) >= 0.1") + "SELECT g AS group_id, round(sum(psi), 6) AS psi FROM r JOIN s USING (g) WHERE sign(dpsi) = sign(sg) GROUP BY 1")
def heatmap_aggregate(spark, d):
    r = X.ev(spark, d).where("comparison = 'A'").groupBy(F.col("gene_symbol").alias("group_id"), F.col("event_uid").alias("feature")).agg(F.min("dpsi").alias("dpsi"), F.max("fdr").alias("ref"), F.sum("fdr").alias("psi"))
    r = r.withColumn("sample", F.lit("s")).withColumn("start", F.lit(0)).withColumn("end", F.lit(0))
    return M.aggregate_mode(r, 0.1).select("group_id", F.round("psi", 6).alias("psi"))


@query("principal_components")
def principal_components(spark, d):
    return M.principal_components(X.tpm(spark, d).select(F.col("tx").alias("feature"), "sample", F.col("tpm").alias("value")), 3)


@query("reads_in_genes", with_("reads", g="SELECT 'g' || i AS gene, 1000 + i * 100 AS gs, 1400 + i * 100 AS ge FROM range(40) t(i)") + "SELECT gene, count(*) AS n FROM reads JOIN g ON pos >= gs AND pos + CASE WHEN cigar = '50M' THEN 50 WHEN cigar = '10M5I35M' THEN 45 WHEN cigar = '20M3D30M' THEN 53 ELSE 50 + regexp_extract(cigar, 'M([0-9]+)N', 1)::INT END - 1 <= ge GROUP BY 1 HAVING count(*) >= 20")
def reads_in_genes(spark, d):
    from isoframe.functions import columns as C

    r = X.reads(spark, d).select(F.lit("c").alias("chr"), F.col("pos").alias("start"), C.cigar_end("pos", "cigar").alias("end"))
    g = spark.range(40).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("gene"), F.lit("c").alias("chr"), (1000 + F.col("id") * 100).alias("start"), (1400 + F.col("id") * 100).alias("end"))
    return R.reads_inside(r, g, 20, 500)
