"""Quality scores by hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, packed, spread_join
from .textstats import MEASURES, SAMPLE_ROWS, expand, fit_softmax, labelled_sample, linear_columns, measures, standardise


@dataclass
class EvidenceModel:
    """A document classifier: log odds of good quality from its text alone."""

    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray

    def log_odds(self, m: Column) -> Column:
        bad, good = linear_columns([m[i] for i in range(len(self.mean))], self.mean, self.sd, self.weights)
        return F.greatest(F.least(good - bad, F.lit(30.0)), F.lit(-30.0))


def fit_evidence(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> EvidenceModel:
    """Fit the document classifier on at most ``sample_rows`` labelled rows; held-out rows (crc32 of the identifier divisible by 5) are never used."""
    got = labelled_sample(docs, labels, id_col, text_col, ["quality"], sample_rows).select(measures(F.col("text")).alias("m"), F.col("quality").alias("y")).collect()
    x = np.array([r.m[:MEASURES] for r in got], dtype=float).reshape(len(got), MEASURES)
    y = np.array([int(r.y > 0) for r in got], dtype=int)
    if len(set(y.tolist())) < 2:  # nothing to tell apart: neutral evidence
        return EvidenceModel(np.zeros(MEASURES), np.ones(MEASURES), np.zeros((2 * MEASURES + 1, 2)))
    mean, sd = standardise(x)
    return EvidenceModel(mean, sd, fit_softmax(expand((x - mean) / sd), y, 2))


def _prior_strength(m: float, spread: float) -> float:
    """Pseudo-counts of a Beta prior with mean ``m`` whose means vary by ``spread``."""
    return min(1e6, max(1.0, m * (1 - m) / spread - 1)) if spread > 0 else 1e6


def quality_scores(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: id, doc (its columns), log_odds (text evidence), host_quality, path_quality and quality (their combination, 0 to 1).

    ``host`` and ``path`` default to the columns source and lang: a path belongs to a host. The document classifier's
    probabilities are summed as soft counts per (host, path) and per host. The variance of host means around the global
    mean beyond sampling noise gives the strength of the global prior, that of path means around their hosts the strength
    of the host prior; so a site of few documents stays near its parent and a large one follows its own. A document's
    log odds are the text evidence plus how far its path's posterior lies from the global one.

    A hot host is pre-aggregated before any shuffle. Site posteriors are broadcast if a count allows it, else joined
    with hot sites spread. Null host or path: a site of its own. Null text counts as empty. No labels: text evidence is
    neutral. Repeated rows count and are scored each. An empty table gives an empty result. Without ``with_text`` there
    is no doc and the texts are read once; with it they are read twice, for the sites and for the
    result, but never shuffled.
    """
    model = fit_evidence(docs, labels, id_col, text_col, sample_rows)
    host = F.coalesce((F.col("source") if host is None else host).cast("string"), F.lit("\x00"))
    path = F.coalesce((F.col("lang") if path is None else path).cast("string"), F.lit("\x00"))
    whole = [packed(docs).alias("doc")] if with_text else []
    scored = docs.select(F.col(f"`{id_col}`").alias("id"), *whole, F.struct(host.alias("host"), path.alias("path")).alias("site"), measures(F.col(f"`{text_col}`")).alias("m"))
    scored = scored.withColumn("log_odds", model.log_odds(F.col("m"))).drop("m")
    if not with_text:
        scored = cut(scored)
    p = 1 / (1 + F.exp(-F.col("log_odds")))
    paths = cut(scored.groupBy("site").agg(F.sum(p).alias("s"), F.count(F.lit(1)).alias("n")))
    hosts = cut(paths.groupBy(F.col("site.host").alias("host")).agg(F.sum("s").alias("hs"), F.sum("n").alias("hn")))
    total = hosts.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n")).first()
    m = min(max(total.s / total.n, 1e-6), 1 - 1e-6) if total.n else 0.5

    def excess(df: DataFrame, mean: Column, n: Column, centre: Column) -> float:
        got = df.agg(F.sum(n * (mean - centre) ** 2).alias("v"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("k")).first()
        return max(0.0, (got.v - got.k * m * (1 - m)) / got.n) if got.n else 0.0

    k_host = _prior_strength(m, excess(hosts, F.col("hs") / F.col("hn"), F.col("hn"), F.lit(m)))
    hosts = hosts.withColumn("host_quality", (F.col("hs") + k_host * m) / (F.col("hn") + k_host))
    sites = cut(paths.join(hosts.select("host", "host_quality"), F.col("site.host") == F.col("host")))
    k_path = _prior_strength(m, excess(sites, F.col("s") / F.col("n"), F.col("n"), F.col("host_quality")))
    sites = sites.select("site", F.col("host_quality").alias("host_quality"), ((F.col("s") + k_path * F.col("host_quality")) / (F.col("n") + k_path)).alias("path_quality"))
    if sites.count() <= BROADCAST_ROWS:
        joined = scored.join(F.broadcast(sites), "site")
    else:
        joined = spread_join(scored, sites, "site", "id")
    q = F.greatest(F.least(F.col("path_quality"), F.lit(1 - 1e-6)), F.lit(1e-6))
    odds = F.col("log_odds") + F.log(q / (1 - q)) - math.log(m / (1 - m))
    return joined.withColumn("quality", 1 / (1 + F.exp(-odds))).drop("site")


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """One row per row of ``docs``: id, log_odds, host_quality, path_quality, quality, kept (quality >= threshold)."""
    found = quality_scores(docs, labels, with_text=False, **options)
    return found.select(F.col("id").alias(options.get("id_col", "doc_id")), "log_odds", "host_quality", "path_quality", "quality", (F.col("quality") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` with quality of ``threshold`` or more, with their columns, whatever their names. Repeated rows are
    judged each; null texts count as empty ones; an empty table stays empty.
    """
    return quality_scores(docs, labels, **options).where(F.col("quality") >= threshold).select("doc.*")
