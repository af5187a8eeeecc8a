"""Mixing domains to target weights with soft memberships, with DataFrame functions alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, packed
from .textstats import MEASURES, SAMPLE_ROWS, expand, fit_softmax, labelled_sample, linear_columns, measures, standardise

#: The domains that the labelled table tells apart, and default target shares of tokens.
DOMAINS = ("clean", "toxic", "junk")
TARGET = {"clean": 0.90, "toxic": 0.04, "junk": 0.06}
#: Word heads in the classifier's vocabulary at most.
VOCABULARY = 1000
#: Shares of a Newton step that are tried.
STEP_SIZES = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)


def _heads(words: Column) -> Column:
    """Distinct first five characters of words, in lower case."""
    return F.array_distinct(F.transform(words, lambda x: F.lower(F.substring(x, 1, 5))))


def _domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic > 0, 1).when(quality > 0, 0).otherwise(2)


def with_posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of ``docs``: id, doc (its columns) and mix: tokens and p0, p1, p2, the posteriors of ``DOMAINS``, rounded to 3 digits and adding up to 1.

    Word heads that at least 8 toxic sample rows hold and that lean to them by over six standard deviations form the
    vocabulary, at most ``VOCABULARY``; it is part of the model. A softmax regression on their summed log odds and the
    shape measures of the text gives the posteriors. Both are fitted on at most ``sample_rows`` labelled rows; scoring
    is a row's own affair, without a shuffle.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, ["quality", "toxic"], sample_rows)
    sample = cut(sample.select(_domain(F.col("quality"), F.col("toxic")).alias("y"), measures(F.col("text"), _heads).alias("s")).select("y", "s.m", F.col("s.also").alias("heads")))
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n = sizes.get(1, 0), sum(sizes.values())
    a, c = F.col("a"), F.col("c")
    z = (a - c * (n1 / max(n, 1))) / F.sqrt(c * (max(n1 * (n - n1), 1) / max(n, 1) ** 2))
    weight = F.log((a + 0.5) / (n1 + 1.0)) - F.log((c - a + 0.5) / (n - n1 + 1.0))
    vocabulary = (
        sample.select("y", F.explode("heads").alias("head"))
        .groupBy("head")
        .agg(F.sum((F.col("y") == 1).cast("int")).alias("a"), F.count(F.lit(1)).alias("c"))
        .where((a >= 8) & (z > 6))
        .orderBy(z.desc(), "head")
        .limit(VOCABULARY)
        .select("head", weight.alias("w"))
        .collect()
    )
    known = F.array(*[F.lit(r.head) for r in vocabulary]).cast("array<string>")
    weights = F.create_map(*[x for r in vocabulary for x in (F.lit(r.head), F.lit(r.w))]) if vocabulary else F.create_map(F.lit(""), F.lit(0.0))

    def lean(heads: Column) -> Column:
        return F.least(F.aggregate(F.array_intersect(heads, known), F.lit(0.0), lambda s, h: s + F.coalesce(F.element_at(weights, h), F.lit(0.0))), F.lit(30.0))

    learnt = sample.select("y", "m", lean(F.col("heads")).alias("lean")).collect()
    x = np.array([[*r.m[:MEASURES], r.lean] for r in learnt], dtype=float).reshape(len(learnt), MEASURES + 1)
    mean, sd = standardise(x) if learnt else (np.zeros(MEASURES + 1), np.ones(MEASURES + 1))
    fitted = fit_softmax(expand((x - mean) / sd), np.array([r.y for r in learnt], dtype=int), 3) if len(sizes) > 1 else np.zeros((2 * MEASURES + 3, 3))

    def scored(x: Column) -> Column:
        def shares(e: Column) -> Column:
            total = e[0] + e[1] + e[2]
            p1, p2 = F.round(e[1] / total, 3), F.round(e[2] / total, 3)
            return F.struct(x["m"][MEASURES].cast("long").alias("tokens"), F.greatest(F.round(1 - p1 - p2, 3), F.lit(0.0)).alias("p0"), p1.alias("p1"), p2.alias("p2"))

        def softmax(s: Column) -> Column:
            return let(F.transform(s, lambda v: F.exp(v - F.array_max(s))), shares)

        def scores(leaning: Column) -> Column:
            return let(F.array(*linear_columns([*[x["m"][i] for i in range(MEASURES)], leaning], mean, sd, fitted)), softmax)

        return let(lean(x["also"]), scores)

    # a filter is not pushed below the row number, where it would evaluate all this once more
    mix = let(measures(F.col(f"`{text_col}`"), _heads), scored)
    return docs.select(F.col(f"`{id_col}`").alias("id"), packed(docs).alias("doc"), mix.alias("mix"), F.monotonically_increasing_id().alias("row"))


def projected_rates(cells: DataFrame, share: list[float], held: np.ndarray, max_rate: float, steps: int):
    """A function from posteriors to rates, fitted by projected gradient steps with momentum on the rates of ``cells``.

    Rates stay between 0 and ``max_rate``, those of documents that are more likely of the first domain than not at 1 or more,
    so none of them goes. Beside the first domain's tokens the others' are to have the ratios of ``share``: the squared
    misses are made least, from rates of 1 on. A step is one aggregation over the cells; a rate follows from the steps'
    misses and a document's own posteriors, so nothing is kept for each document. Targets that these bounds don't allow
    stay unmet; ``mixing_shares`` tells.
    """
    others = [k for k in (1, 2) if held[k] and share[0] > 0]
    ratio = {k: share[k] / share[0] for k in others}

    def parts(x) -> list[Column]:
        return [x(f"p{k}") - x("p0") * float(ratio[k]) for k in others]

    def bounded(x, r: Column) -> Column:
        return F.greatest(F.when(x("p0") > 0.5, F.lit(1.0)).otherwise(F.lit(0.0)), F.least(F.lit(float(max_rate)), r))

    history: list[tuple[list[float], float]] = []

    def after(x) -> Column:
        """The rate after all steps and the point from which the next one goes."""
        start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
        if not history:
            return start
        past = F.array(*[F.struct(*[F.lit(float(g)).alias(f"g{i}") for i, g in enumerate(gaps)], F.lit(float(b)).alias("b")) for gaps, b in history])

        def step(now: Column, h: Column) -> Column:
            down = sum((part * h[f"g{i}"] for i, part in enumerate(parts(x))), F.lit(0.0))
            return let(bounded(x, now["y"] - down), lambda r: F.struct(r.alias("r"), (r + (r - now["r"]) * h["b"]).alias("y")))

        return F.aggregate(past, start, step)

    if others:
        sums = cells.agg(*[F.sum(F.col("t") * p * p) for p in parts(F.col)], F.sum(F.col("t") * F.col("p0"))).first()
        scale, tokens = [max(v or 0.0, 1e-9) * len(others) for v in sums[:-1]], sums[-1] or 0.0
        momentum = 1.0
        for _ in range(steps):
            told = cells.withColumn("at", after(F.col))
            row = told.agg(*[F.sum(F.col("t") * F.col("at.y") * p) for p in parts(F.col)], *[F.sum(F.col("t") * F.col("at.r") * p) for p in parts(F.col)]).first()
            gaps, missed = [v or 0.0 for v in row[: len(others)]], [v or 0.0 for v in row[len(others) :]]
            if max(abs(v) for v in missed) <= 1e-3 * tokens:
                break
            faster = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
            history.append(([g / s for g, s in zip(gaps, scale, strict=True)], (momentum - 1) / faster))
            momentum = faster
    return lambda x: after(x)["r"]


def mixing_rates(docs: DataFrame, labels: DataFrame, target: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, max_repeat: float | None = None, steps: int = 40, with_text: bool = True, keep_first: bool = False, max_rate: float = 4.0) -> DataFrame:
    """Per row of ``docs`` what ``with_posteriors`` tells, and rate: how often the document is to be used.

    Rates are nonnegative and bring expected domain tokens, the sum of rate times tokens times posterior, to their
    targets, with the least squared change of rates from 1. Such rates are 1 plus the posteriors times one number a
    domain, or 0; the numbers are found by Newton steps of the best of ``STEP_SIZES``. The targets' total is what uses
    the first domain once, so clean documents are not thinned out, and documents of a scarce domain are repeated. With
    ``max_repeat`` the total is lowered until no domain's target is over that many times its tokens, so all shares are
    met still. A domain that ``target`` doesn't name keeps what it has beside the others' shares, one without any tokens is
    left out, and targets that no rates meet are met as nearly as a slight
    penalty on the numbers allows. Posteriors have three digits, so documents meet in at most 501,501 cells; a step is
    two aggregations over the cells and a few numbers to the driver. A document's rate follows from its posteriors and
    these numbers alone, so the fit is applied row by row without a join.

    With ``keep_first`` the rates come from ``projected_rates`` instead: documents of the first domain stay, and none is
    used more than ``max_rate`` times.

    Null and empty texts have no tokens and rate as their posteriors say. Without labels all posteriors are equal.
    Repeated rows count and are rated each. An empty table gives an empty result. Without ``with_text`` there is no
    doc and the texts are read once.
    """
    target = TARGET if target is None else target
    posts = with_posteriors(docs, labels, id_col, text_col, sample_rows)
    if not with_text:
        posts = cut(posts.select("id", "mix"))
    cells = cut(posts.groupBy("mix.p0", "mix.p1", "mix.p2").agg(F.sum("mix.tokens").alias("t")))
    mass = list(cells.agg(*[F.coalesce(F.sum(F.col("t") * F.col(f"p{k}")), F.lit(0.0)) for k in range(3)]).first())
    share = [target.get(d, 0.0) for d in DOMAINS]
    held = np.array([d in target and m > 0 for d, m in zip(DOMAINS, mass, strict=True)])
    if keep_first:
        fitted = projected_rates(cells, share, held, max_rate, steps)
        return posts.withColumn("rate", let(F.col("mix"), lambda x: fitted(x.__getitem__)))
    total = mass[0] / share[0] if share[0] > 0 and mass[0] > 0 else sum(mass)
    if max_repeat is not None:
        total = min([total, *[max_repeat * m / s for s, m in zip(share, mass, strict=True) if s > 0 and m > 0]])
    want = np.array([s * total if m > 0 else 0.0 for s, m in zip(share, mass, strict=True)])
    products = [(j, k) for j in range(3) for k in range(j, 3)]
    ridge, at = 1e-6 * max(sum(mass), 1.0), np.zeros(3)

    def rated(x, at: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), 1 + x("p0") * float(at[0]) + x("p1") * float(at[1]) + x("p2") * float(at[2]))

    def total_of(value: Column) -> Column:
        return F.coalesce(F.sum(F.col("t") * value), F.lit(0.0))

    for _ in range(steps):
        now = rated(F.col, at)
        used = (now > 0).cast("int")
        row = cells.agg(*[total_of(now * F.col(f"p{k}")) for k in range(3)], *[total_of(used * F.col(f"p{j}") * F.col(f"p{k}")) for j, k in products]).first()
        gaps = np.where(held, np.array(row[:3]) - want, 0.0)
        if max(abs(gaps)) <= 1e-4 * max(total, 1.0):
            break
        slopes = ridge * np.eye(3)
        for (j, k), v in zip(products, row[3:], strict=True):
            slopes[j, k] += v
            slopes[k, j] += v if j != k else 0.0
        slopes = np.where(held[:, None] & held, slopes, np.eye(3))  # no number for a domain without a target
        step = np.linalg.solve(slopes, gaps + ridge * at)
        tried = [at - size * step for size in STEP_SIZES]
        squares = cells.agg(*[total_of(rated(F.col, x) * rated(F.col, x)) for x in tried]).first()
        at = min(zip(squares, tried, strict=True), key=lambda v: v[0] / 2 - v[1] @ want + ridge / 2 * v[1] @ v[1])[1]

    def rate(x: Column) -> Column:
        return rated(x.__getitem__, at)

    return posts.withColumn("rate", let(F.col("mix"), rate))


def _copies(key: Column, rate: Column) -> Column:
    """``rate`` rounded up or down by the hash of the identifier, right on average."""
    return F.floor(rate + F.pmod(F.xxhash64(key), F.lit(1 << 20)) / float(1 << 20)).cast("long")


def mixing_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, posteriors, rate, copies."""
    columns = [F.col(f"mix.p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    rated = mixing_rates(docs, labels, with_text=False, **options)
    return rated.select(F.col("id").alias(options.get("id_col", "doc_id")), F.col("mix.tokens").alias("n_tokens"), *columns, "rate", _copies(F.col("id"), F.col("rate")).alias("copies"))


def mixing_shares(report: DataFrame, target: dict[str, float] | None = None) -> DataFrame:
    """(domain, target, reached) of a ``mixing_report``: each domain's share of the expected tokens of all domains that have a target."""
    target = TARGET if target is None else target
    sums = report.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{d}")), F.lit(0.0)).alias(d) for d in target])
    whole = sum((F.col(d) for d in target), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(float(v)).alias("target"), (F.col(d) / F.nullif(whole, F.lit(0.0))).alias("reached")) for d, v in target.items()])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def mixed_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with mix_rate and mix_copies in place of columns of these names; documents of which no copy is to be used go.

    Repeated rows are judged each; null texts count as empty ones; an empty table stays empty.
    """
    rated = mixing_rates(docs, labels, **options).select("doc", "row", "rate", _copies(F.col("id"), F.col("rate")).alias("copies")).where("copies > 0 and row >= 0")
    mine = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("mix_rate", "mix_copies")]
    return rated.select(*mine, F.col("rate").alias("mix_rate"), F.col("copies").alias("mix_copies"))
