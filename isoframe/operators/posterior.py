"""Posterior samples of isoform shares from counts of read classes.

A read class is the set of isoforms that its reads fit; a gene's reads come in no more
classes than their fits differ, so a gene with a hundred million reads costs as much as one
with a hundred.  A read is drawn from isoform k with probability psi_k m_k / sum(psi m), m
being the places that a read has in it, and then from one of those places; so a class's
probability is the sum of its isoforms' psi, over sum(psi m).  The prior is a Dirichlet
distribution.  A Metropolis-Hastings walk moves log ratios of the shares, for all chains of
all genes of a batch at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chains of a gene, steps that are thrown away, steps that are used, and how many of these make one sample.
CHAINS, BURN_IN, STEPS, LAG = 6, 500, 2000, 10
#: Genes of a batch, steps whose random numbers are drawn at a time, and the share of accepted steps that the burn-in tunes the width for.
GENES, DRAWN, WANTED = 128, 250, 0.35


def _seeded(gene: str) -> np.random.Generator:
    """Random numbers of a gene: the same whatever batch, task or retry it is in."""
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(gene.encode(), digest_size=8).digest(), "little"))


def log_posterior(shares: np.ndarray, fits: np.ndarray, n: np.ndarray, places: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log density (up to a constant) of log ratios of shares, for each gene and chain.

    shares: genes, chains, isoforms.  fits: genes, classes, isoforms.  n: genes, classes.
    """
    of_class = np.einsum("gck,gjk->gcj", shares, fits)
    reads = np.einsum("gj,gcj->gc", n, np.log(np.maximum(of_class, 1e-300)))
    total = np.log(np.maximum(np.einsum("gck,gk->gc", shares, places), 1e-300))
    return reads - n.sum(1)[:, None] * total + np.einsum("gk,gck->gc", prior, np.log(np.maximum(shares, 1e-300)))


def _shares(y: np.ndarray) -> np.ndarray:
    full = np.concatenate([y, np.zeros((*y.shape[:2], 1))], axis=2)
    full = np.exp(full - full.max(axis=2, keepdims=True))
    return full / full.sum(axis=2, keepdims=True)


def walk(genes: list[str], fits: np.ndarray, n: np.ndarray, places: np.ndarray, prior: float = 1.0, chains: int = CHAINS, burn_in: int = BURN_IN, steps: int = STEPS, lag: int = LAG) -> tuple[np.ndarray, np.ndarray]:
    """Samples (genes, samples, isoforms) and the share of accepted steps of each gene, for genes with the same number of isoforms."""
    count, k = len(genes), places.shape[1]
    rng = [_seeded(g) for g in genes]
    alpha = np.full((count, k), prior)
    y = np.stack([r.normal(0, 0.5, (chains, k - 1)) for r in rng])
    at = log_posterior(_shares(y), fits, n, places, alpha)
    width, accepted, tuned, kept = np.full(count, 0.5), np.zeros(count), np.zeros(count), []
    for step in range(burn_in + steps):
        if step % DRAWN == 0:
            noise = np.stack([r.normal(size=(DRAWN, chains, k - 1)) for r in rng])
            chance = np.log(np.stack([r.random((DRAWN, chains)) for r in rng]))
        to = y + width[:, None, None] * noise[:, step % DRAWN]
        there = log_posterior(_shares(to), fits, n, places, alpha)
        take = chance[:, step % DRAWN] < there - at
        y, at = np.where(take[:, :, None], to, y), np.where(take, there, at)
        if step < burn_in:  # from then on the width stays, so the walk leaves the posterior as it is
            tuned += take.mean(1)
            if step % 25 == 24:
                width *= np.exp(tuned / 25 - WANTED)
                tuned[:] = 0
        else:
            accepted += take.mean(1)
            if (step - burn_in) % lag == lag - 1:
                kept.append(_shares(y))
    return np.concatenate(kept, axis=1), accepted / steps


def _sample(settings: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_size: dict[int, list[dict]] = {}
            for r in batch.to_pylist():
                by_size.setdefault(len(r["isoforms"]), []).append(r)
            for k, rows in sorted(by_size.items()):
                rows.sort(key=lambda r: len(r["classes"]))
                for low in range(0, len(rows), GENES):
                    some = rows[low : low + GENES]
                    most = max(len(r["classes"]) for r in some)
                    fits, n = np.ones((len(some), most, k)), np.zeros((len(some), most))  # a class without reads says nothing
                    for g, r in enumerate(some):
                        for j, c in enumerate(sorted(r["classes"], key=lambda c: c["fits"])):
                            fits[g, j], n[g, j] = c["fits"], c["n"]
                    places = np.array([[max(i["places"], 0) for i in r["isoforms"]] for r in some], float)
                    samples, accepted = walk([r["gene"] for r in some], fits, n, places, **settings)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["gene"] for r in some], pa.string()), pa.array([[i["isoform"] for i in r["isoforms"]] for r in some], pa.list_(pa.string())), pa.array(samples.tolist(), pa.list_(pa.list_(pa.float64()))), pa.array(n.sum(1).astype(np.int64)), pa.array(accepted)],
                        ["gene", "isoforms", "psi", "n", "accepted"],
                    )

    return run


def posterior_samples(classes: DataFrame, isoforms: DataFrame, read_length: int, overhang: int = 1, prior: float = 1.0, chains: int = CHAINS, burn_in: int = BURN_IN, steps: int = STEPS, lag: int = LAG) -> DataFrame:
    """gene, isoforms (in order of names), psi (samples, each a share for every isoform), n reads, accepted share of steps.

    classes: gene, fits (0/1 for each isoform in order of names), n, as ``read_classes``
    gives them.  isoforms: gene, isoform, length.  Reads that fit no isoform are left out; a
    gene without reads or with one isoform has nothing to sample and gives no row.
    """
    named = isoforms.groupBy(F.col("gene").cast("string").alias("gene")).agg(F.array_sort(F.collect_list(F.struct(F.col("isoform").cast("string").alias("isoform"), (F.col("length") - read_length + 1 - 2 * (overhang - 1)).cast("long").alias("places")))).alias("isoforms"))
    counted = classes.where(F.exists("fits", lambda x: x > 0)).groupBy(F.col("gene").cast("string").alias("gene"), "fits").agg(F.sum("n").alias("n")).groupBy("gene").agg(F.collect_list(F.struct("fits", "n")).alias("classes"))
    met = counted.join(named, "gene").where(F.size("isoforms") > 1)
    return met.select("gene", "classes", "isoforms").mapInArrow(_sample({"prior": prior, "chains": chains, "burn_in": burn_in, "steps": steps, "lag": lag}), "gene string, isoforms array<string>, psi array<array<double>>, n long, accepted double")


def by_isoform(samples: DataFrame) -> DataFrame:
    """event (gene:isoform), psi (array): samples of each isoform by itself, as intervals, summaries and Bayes factors take them."""
    return samples.select("gene", "psi", F.posexplode("isoforms").alias("_k", "isoform")).select(F.concat_ws(":", "gene", "isoform").alias("event"), F.transform("psi", lambda x: F.get(x, F.col("_k"))).alias("psi"))


def two_isoform_mean(classes: DataFrame, isoforms: DataFrame, read_length: int, overhang: int = 1, points: int = 400) -> DataFrame:
    """gene, n, mean of the first isoform's share under a flat prior, integrated over a grid: what the sampler is held against.

    classes of genes with two isoforms: gene, fits, n.
    """
    m = isoforms.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("isoform", (F.col("length") - read_length + 1 - 2 * (overhang - 1)).cast("double").alias("m")))).alias("i")).where(F.size("i") == 2)
    count = lambda a, b: F.sum(F.when((F.get("fits", F.lit(0)) == a) & (F.get("fits", F.lit(1)) == b), F.col("n")).otherwise(0))
    g = classes.groupBy("gene").agg(count(1, 0).alias("first"), count(0, 1).alias("second"), count(1, 1).alias("both")).join(m, "gene")
    x = F.transform(F.sequence(F.lit(1), F.lit(points)), lambda i: (i - 0.5) / points)
    log = lambda p: F.col("first") * F.log(p) + F.col("second") * F.log(1 - p) - (F.col("first") + F.col("second") + F.col("both")) * F.log(p * F.col("i")[0]["m"] + (1 - p) * F.col("i")[1]["m"])
    g = g.withColumn("_l", F.transform(x, log)).withColumn("_m", F.array_max("_l"))
    total = F.aggregate("_l", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("_m")))
    mean = F.aggregate(F.arrays_zip(x.alias("x"), F.col("_l").alias("l")), F.lit(0.0), lambda a, v: a + v["x"] * F.exp(v["l"] - F.col("_m"))) / total
    return g.select("gene", (F.col("first") + F.col("second") + F.col("both")).alias("n"), mean.alias("mean"))
