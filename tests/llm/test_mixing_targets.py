import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("max_repeat", [None, 1.0])
def test_scarce_domains_meet_their_shares(spark, max_repeat):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    bad = labels.where("quality = 0 and toxic = 0 and doc_id % 6 > 0").select("doc_id").distinct()
    report = mixing.mixing_report(docs.join(bad, "doc_id", "left_anti"), labels, max_repeat=max_repeat).persist()
    spent = {d: report.agg(F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{d}"))).first()[0] for d in mixing.DOMAINS}
    mass = {d: report.agg(F.sum(F.col("n_tokens") * F.col(f"p_{d}"))).first()[0] for d in mixing.DOMAINS}
    assert mass["junk"] < 0.8 * 0.06 / 0.9 * mass["clean"]
    for domain, share in mixing.TARGET.items():
        assert abs(spent[domain] / sum(spent.values()) - share) < 0.002, (spent, mass)
    assert report.agg(F.min("rate")).first()[0] >= 0
    if max_repeat is None:
        assert abs(spent["clean"] - mass["clean"]) < 0.01 * mass["clean"]


def test_projected_rates_keep_clean_documents(spark):
    """Rates in bounds; the shares are met, or none that the bounds allow come nearer: a plain projected gradient finds no better."""
    import numpy as np

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    target = {"clean": 0.95, "toxic": 0.05}
    for few in (docs, docs.where("doc_id < 120")):
        report = mixing.mixing_report(few, labels, target=target, keep_first=True, max_rate=4.0).persist()
        rows = report.collect()
        rate, t = np.array([r.rate for r in rows]), np.array([float(r.n_tokens) for r in rows])
        p = np.array([[r.p_clean, r.p_toxic] for r in rows])
        low = (p[:, 0] > 0.5).astype(float)
        assert (rate >= low).all() and rate.max() <= 4.0 and all(r.copies >= 1 for r in rows if r.p_clean > 0.5)
        part = p[:, 1] - p[:, 0] * 0.05 / 0.95
        mine, plain = abs((t * rate * part).sum()), np.ones(len(rows))
        for _ in range(4000):
            plain = np.clip(plain - part * (t * plain * part).sum() / (t * part * part).sum(), low, 4.0)
        assert mine <= abs((t * plain * part).sum()) + 2e-3 * (t * p[:, 0]).sum()
        shares = {r.domain: r.reached for r in mixing.mixing_shares(report, target).collect()}
        assert abs(sum(shares.values()) - 1) < 1e-9
        if mine <= 1e-3 * (t * p[:, 0]).sum():
            assert abs(shares["toxic"] - 0.05) < 0.01
