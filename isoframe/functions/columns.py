"""Column expressions of the data model: identifiers, directions, classes, text helpers.

All are Column -> Column functions inside whole-stage code generation; null stays null
unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that table readers take as missing.
MISSING = ["", "NA", "N/A", "n/a", "nan", "NaN", "NULL", "null", "None", "#N/A", "#NA", "-nan", "-NaN", "<NA>", "#N/A N/A", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN"]

#: Coordinate columns of each event type, in the order of event ids.
UID_COLUMNS = {
    "SE": ["exonStart_0base", "exonEnd", "upstreamES", "upstreamEE", "downstreamES", "downstreamEE"],
    "RI": ["upstreamES", "upstreamEE", "downstreamES", "downstreamEE", "riExonStart_0base", "riExonEnd"],
    "MXE": ["upstreamES", "upstreamEE", "downstreamES", "downstreamEE", "1stExonStart_0base", "1stExonEnd", "2ndExonStart_0base", "2ndExonEnd"],
    "A3SS": ["longExonStart_0base", "longExonEnd", "shortES", "shortEE", "flankingES", "flankingEE"],
    "A5SS": ["longExonStart_0base", "longExonEnd", "shortES", "shortEE", "flankingES", "flankingEE"],
}
EVENT_TYPES = ["SE", "RI", "A3SS", "A5SS", "MXE"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """Text as double; whatever is no number, and NaN, is null."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


#: White space of text, as a class of a regular expression.
_WHITE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def clean_text(c: Column | str) -> Column:
    """Without white space and then quotes around it, double ones first; empty and ``nan`` are null."""
    x = F.regexp_replace(col(c).cast("string"), rf"^{_WHITE}+|{_WHITE}+\z", "")
    x = F.regexp_replace(F.regexp_replace(x, r'^"+|"+\z', ""), r"^'+|'+\z", "")
    return F.when((x != "") & (F.lower(x) != "nan"), x)


def normalize_gene_id(c: Column | str) -> Column:
    """Gene id without its version: the core of an Ensembl id in any case, else without a last ``.digits``."""
    x = clean_text(c)
    core = F.regexp_extract(x, r"(?i)^(ENS[A-Z]*G[0-9]+)(?:\.[0-9]+)?$", 1)
    return F.when(core != "", core).otherwise(F.regexp_replace(x, r"^(.+)\.[0-9]+$", "$1"))


def event_uid(event_type: str, present: Sequence[str], chrom: str = "chr", strand: str = "strand") -> Column:
    """Type, chromosome, strand and the coordinates that the table has, joined by ``|``; a missing value reads ``nan``."""
    wanted = [c for c in [chrom, strand, *UID_COLUMNS[event_type]] if c in present]
    return F.concat_ws("|", F.lit(event_type), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")) for c in wanted])


def coordinates_text(event_type: Column | str, columns: Sequence[str]) -> Column:
    """``type | name=value | ...`` over the values that aren't null."""
    return F.concat_ws(" | ", col(event_type), *[F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string"))) for c in columns])


def flipped(value: Column | str, flip: Column) -> Column:
    """Effect with the sign of the wanted direction."""
    return F.when(F.coalesce(flip, F.lit(False)), -col(value)).otherwise(col(value))


def numbers(c: Column | str, sep: str = ",") -> Column:
    """Delimited text as array of doubles; what is no number is null."""
    return F.transform(F.split(col(c), sep), lambda t: F.nullif(F.trim(t).try_cast("double"), F.lit(float("nan"))))


def inc_level_mean(c: Column | str) -> Column:
    """Mean of the readable numbers of a comma list; none: null."""
    xs = F.filter(numbers(c), lambda x: x.isNotNull())
    return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs))


def gene_lookup_key(gene_id: Column | str, symbol: Column | str) -> Column:
    """``id:`` and the normalised id, else ``sym:`` and the lower-case symbol, else empty."""
    return F.coalesce(F.concat(F.lit("id:"), normalize_gene_id(gene_id)), F.concat(F.lit("sym:"), F.lower(clean_text(symbol))), F.lit(""))


def safe_name(c: Column | str) -> Column:
    """Everything but letters, digits, ``_``, ``-`` and ``.`` as ``_``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col(c), r"[^A-Za-z0-9_.\-]+", "_"), "^_+|_+$", "")


#: What stands between the groups of a comparison's name, in the order tried.
DELIMITERS = ["_vs_", "-vs-", " vs ", "-"]


def split_comparison(c: Column | str) -> Column:
    """struct(experiment, control) of a comparison's name, at the first delimiter that it has; else nulls."""
    x = col(c)
    out = F.struct(F.lit(None).cast("string").alias("experiment"), F.lit(None).cast("string").alias("control"))
    for d in reversed(DELIMITERS):
        parts = F.struct(F.substring_index(x, d, 1).alias("experiment"), F.substr(x, F.instr(x, d) + F.lit(len(d))).alias("control"))
        out = F.when(F.instr(x, d) > 0, parts).otherwise(out)
    return out


def swapped_name(c: Column | str) -> Column:
    """Name of the comparison in the other direction; unchanged where it can't be split."""
    out = col(c)
    for d in reversed(DELIMITERS):
        x = col(c)
        out = F.when(F.instr(x, d) > 0, F.concat(F.substr(x, F.instr(x, d) + F.lit(len(d))), F.lit(d), F.substring_index(x, d, 1))).otherwise(out)
    return out


def direction_label(value: Column | str, up: str, down: str, zero: str) -> Column:
    v = col(value)
    return F.when(v > 0, up).when(v < 0, down).otherwise(zero)


def inclusion_text(value: Column | str, left: Column | str, right: Column | str) -> Column:
    """``inclusion higher in A than B``, ``inclusion lower in A than B`` or ``no directional shift``."""
    v = col(value)
    say = lambda how: F.concat(F.lit(f"inclusion {how} in "), col(left), F.lit(" than "), col(right))
    return F.when(v > 0, say("higher")).when(v < 0, say("lower")).otherwise("no directional shift")


def pair_class(sig_a: Column, sig_b: Column, dpsi_a: Column, dpsi_b: Column, large: float) -> Column:
    """One of eight classes of an event in two comparisons."""
    both = sig_a & sig_b
    return (
        F.when(both & (dpsi_a.isNull() | dpsi_b.isNull()), "shared_unresolved")
        .when(both & ((dpsi_a == 0) | (dpsi_b == 0)), "shared_zero_direction")
        .when(both & (F.signum(dpsi_a) != F.signum(dpsi_b)), "opposite_direction")
        .when(both & (F.abs(dpsi_a - dpsi_b) >= large), "same_direction_large_delta")
        .when(both, "shared_same_direction")
        .when(sig_a, "A_only")
        .when(sig_b, "B_only")
        .otherwise("neither")
    )


def gene_direction(log2fc: Column, dpsi: Column, deg_sig: Column, as_sig: Column) -> Column:
    """struct(direction_class, agreement_class, combined_class) of a gene's two layers; null effects count as 0."""
    fc, dp = F.coalesce(log2fc, F.lit(0.0)), F.coalesce(dpsi, F.lit(0.0))
    word = lambda v: F.when(v > 0, "up").when(v < 0, "down")
    both = F.coalesce(F.concat_ws("_", F.lit("both"), F.when(word(fc).isNotNull() & word(dp).isNotNull(), F.concat_ws("_", word(fc), word(dp)))), F.lit("both"))
    direction = (
        F.when(deg_sig & as_sig, both)
        .when(deg_sig, F.when(fc > 0, "DE-only_up").otherwise("DE-only_down"))
        .when(as_sig, F.when(dp > 0, "AS-only_posPSI").otherwise("AS-only_negPSI"))
        .otherwise("neither")
    )
    agreement = F.when(deg_sig & as_sig & (fc * dp > 0), "concordant").when(deg_sig & as_sig & (fc * dp < 0), "discordant").when(deg_sig | as_sig, "single_layer").otherwise("neither")
    combined = F.when(deg_sig & as_sig, "both").when(deg_sig, "DE-only").when(as_sig, "AS-only").otherwise("neither")
    return F.struct(direction.alias("direction_class"), agreement.alias("agreement_class"), combined.alias("combined_class"))


def evidence_class(deg: Column, splicing: Column, exon: Column, transcript: Column) -> Column:
    """Names of the layers with evidence, joined by ``_``; none: ``unclassified``."""
    joined = F.concat_ws("_", F.when(deg, "DEG"), F.when(splicing, "rMATS"), F.when(exon, "DEXSeq"), F.when(transcript, "DTU"))
    return F.when(joined != "", joined).otherwise("unclassified")


def candidate_direction(deg: Column, splicing: Column, exon: Column, transcript: Column, log2fc: Column, dpsi: Column) -> Column:
    side = lambda v: F.when(v > 0, "up").otherwise("down")
    return (
        F.when(deg & splicing & log2fc.isNotNull() & dpsi.isNotNull(), F.concat(F.lit("transcript_"), side(log2fc), F.lit("_splicing_"), side(dpsi)))
        .when(deg & ~splicing, "DEG_only")
        .when(splicing & ~deg & (exon | transcript), "rMATS_DEXSeq_or_DTU_only")
        .when(splicing & ~deg, "rMATS_only")
        .otherwise("unclassified")
    )


def candidate_tier(deg: Column, splicing: Column, support: Column) -> Column:
    """Tiers 1 to 5; expression with support but without splicing has none."""
    return (
        F.when(deg & splicing & support, "Tier 1")
        .when(deg & splicing, "Tier 2")
        .when(splicing & support, "Tier 3")
        .when(splicing, "Tier 4")
        .when(deg & ~support, "Tier 5")
        .otherwise("Unclassified")
    )


#: What a tier says.
TIER_TEXT = {
    "Tier 1": "Tier 1: DEG significant, rMATS significant, and DEXSeq/DTU support. Strong multi-layer candidate.",
    "Tier 2": "Tier 2: DEG significant and rMATS significant. Core expression-splicing candidate.",
    "Tier 3": "Tier 3: rMATS significant with DEXSeq/DTU support but no DEG. Splicing-primary candidate.",
    "Tier 4": "Tier 4: rMATS significant only. Event-level splicing candidate.",
    "Tier 5": "Tier 5: DEG significant only. Expression-only candidate.",
}


def tier_text(tier: Column | str) -> Column:
    texts = F.create_map(*[F.lit(x) for pair in TIER_TEXT.items() for x in pair])
    return F.coalesce(texts[col(tier)], F.lit("Unclassified candidate."))


def plot_class(deg: Column, splicing: Column, log2fc: Column, dpsi: Column) -> Column:
    return (
        F.when(deg & splicing & (log2fc * dpsi > 0), "DEG + DAS same direction")
        .when(deg & splicing, "DEG + DAS opposite direction")
        .when(deg, "DEG only")
        .when(splicing, "DAS only")
        .otherwise("Not significant")
    )


def log_score(q: Column | str) -> Column:
    """-log10 of a corrected p-value, at most 300; null: 0."""
    return F.when(col(q).isNotNull(), -F.log10(F.greatest(col(q), F.lit(1e-300)))).otherwise(0.0)


def gene_tokens(text: Column | str) -> Column:
    """Names in free text, split at white space, commas, semicolons and bars; of equal ones in any case the first stays."""
    parts = F.filter(F.split(col(text), r"[\s,;|]+"), lambda t: t != "")
    folded = F.transform(parts, F.lower)
    return F.filter(parts, lambda t, i: F.array_position(folded, F.lower(t)) == i + 1)


def first_names(text: Column | str, n: int = 3) -> Column:
    return F.array_join(F.slice(F.split(col(text), ","), 1, n), ",")


def suppa_genes(event_id: Column | str) -> Column:
    """Gene ids of a local-event id: what stands before ``;``, split at ``_and_``."""
    return F.split(F.substring_index(col(event_id), ";", 1), "_and_")


def cigar_parts(cigar: Column | str) -> Column:
    """Array of (length, operation)."""
    n, op = F.regexp_extract_all(col(cigar), F.lit("([0-9]+)([A-Z=])"), F.lit(1)), F.regexp_extract_all(col(cigar), F.lit("([0-9]+)([A-Z=])"), F.lit(2))
    return F.zip_with(n, op, lambda a, b: F.struct(a.cast("long").alias("n"), b.alias("op")))


def cigar_end(start: Column | str, cigar: Column | str) -> Column:
    """Last position that an alignment covers."""
    return F.aggregate(F.filter(cigar_parts(cigar), lambda p: p["op"].isin("M", "D", "N", "=", "X")), col(start).cast("long"), lambda a, p: a + p["n"]) - 1


def mate_strand(flag: Column | str) -> Column:
    return F.when(col(flag).bitwiseAND(F.lit(16)) != 0, "-").otherwise("+")


def mate_name(qname: Column | str) -> Column:
    """Read name without its mate mark; a mark takes three characters away, as the tools that write such names do."""
    x = col(qname)
    return F.when(x.rlike("[/#][12]$"), F.substring(x, 1, F.length(x) - 3)).otherwise(x)


def read_counts(text: Column | str) -> Column:
    """struct(inc, exc, both) of ``(1,0):n,(0,1):m,(1,1):k``; what is missing is 0."""
    get = lambda key: F.coalesce(F.nullif(F.regexp_extract(col(text), rf"\({key}\):([0-9]+)", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return F.struct(get("1,0").alias("inc"), get("0,1").alias("exc"), get("1,1").alias("both"))


def capped_bayes_factor(text: Column | str) -> Column:
    first = F.get(F.split(col(text), ","), F.lit(0)).try_cast("double")
    return F.when(first.isNotNull(), F.least(first, F.lit(1e12)))


def preview_kind(name: Column | str) -> Column:
    n = F.lower(col(name))
    return (
        F.when(n.rlike(r"\.(png|jpg|jpeg|svg)$"), "image")
        .when(n.rlike(r"\.pdf$"), "pdf")
        .when(n.rlike(r"\.(tsv|csv)$"), "table")
        .when(n.rlike(r"\.(txt|log|md|json|ya?ml)$"), "text")
        .otherwise("other")
    )
