"""Operators whose results SQL can't express, computed once more by their definitions in plain Python."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import mixing, quality, toxicity
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"


def test_scores_match_single_windows():
    """Each window alone, step by step: gates, attention and the largest probability."""
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in toxicity.start(rng).items()}
    H = toxicity.HIDDEN

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def run(xs, w, b, u):
        h, out = np.zeros(H), []
        for x in xs:
            a, g = x @ w + b, h @ u
            r, z = sigmoid(a[:H] + g[:H]), sigmoid(a[H : 2 * H] + g[H : 2 * H])
            c = np.tanh(a[2 * H :] + r * g[2 * H :])
            h = c + z * (h - c)
            out.append(h)
        return out

    def score(text):
        words = toxicity.WORD.findall(text.lower())
        best = -1.0
        for w in toxicity.windows_of(words):
            if not w:
                continue
            xs = [toxicity.inputs(p, [x])[0][0] for x in w]
            ahead = run(xs, p["wx"][:, : 3 * H], p["bx"][: 3 * H], p["uf"])
            back = run(xs[::-1], p["wx"][:, 3 * H :], p["bx"][3 * H :], p["ub"])[::-1]
            states = np.array([np.concatenate(s) for s in zip(ahead, back, strict=True)])
            s = np.tanh(states @ p["wa"]) @ p["va"]
            weights = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            best = max(best, float(sigmoid((weights @ states) @ p["wo"] + p["bo"]).ravel()[0]))
        return best if best >= 0 else float(sigmoid(p["bo"]).ravel()[0])

    vocabulary = ["abc", "defgh", "x", "été", "river", "stones"]
    texts = ["", "12 !!", "one", *[" ".join(rng.choice(vocabulary, n)) for n in (5, 63, 64, 65, 200)]]
    got = toxicity.score_texts(p, texts)
    assert got == pytest.approx([score(t) for t in texts], abs=1e-4)


def test_quality_matches_its_definition(spark):
    docs = table(spark, SF, "documents")
    rows = quality.quality_report(docs, table(spark, SF, "labels")).join(docs.select("doc_id", "source", "lang"), "doc_id").collect()
    chance = {r.doc_id: 1 / (1 + math.exp(-r.log_odds)) for r in rows}
    paths, hosts = defaultdict(list), defaultdict(list)
    for r in rows:
        paths[r.source, r.lang].append(chance[r.doc_id])
        hosts[r.source].append(chance[r.doc_id])
    m = sum(chance.values()) / len(rows)

    def strength(groups, centre):
        n = sum(map(len, groups.values()))
        v = sum(len(g) * (sum(g) / len(g) - centre(k)) ** 2 for k, g in groups.items())
        spread = max(0.0, (v - len(groups) * m * (1 - m)) / n)
        return min(1e6, max(1.0, m * (1 - m) / spread - 1)) if spread > 0 else 1e6

    k = strength(hosts, lambda _: m)
    host = {h: (sum(g) + k * m) / (len(g) + k) for h, g in hosts.items()}
    k = strength(paths, lambda p: host[p[0]])
    for r in rows:
        g = paths[r.source, r.lang]
        q = (sum(g) + k * host[r.source]) / (len(g) + k)
        odds = r.log_odds + math.log(q / (1 - q)) - math.log(m / (1 - m))
        assert (r.host_quality, r.path_quality, r.quality) == pytest.approx((host[r.source], q, 1 / (1 + math.exp(-odds))), abs=1e-6)
        assert r.kept == (r.quality >= 0.5)


@pytest.mark.parametrize("target", [mixing.TARGET, {"clean": 0.95, "toxic": 0.05}])
def test_rates_match_projected_gradient(spark, target):
    """Projected gradient steps on the rates themselves, penalising missed totals, come to the same rates."""
    rows = mixing.mixing_report(table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels"), target=target).collect()
    p = np.array([[r.p_clean, r.p_toxic, r.p_junk] for r in rows])
    t = np.array([float(r.n_tokens) for r in rows])
    held = [i for i, d in enumerate(mixing.DOMAINS) if d in target]
    a = (p * t[:, None])[:, held]
    share = np.array([target[mixing.DOMAINS[i]] for i in held])
    want = share * a[:, 0].sum() / share[0]
    rate = np.array([r.rate for r in rows])
    assert (rate >= 0).all() and np.abs(a.T @ rate - want).max() <= 2e-4 * want.sum()
    # the least squared change, weighed by tokens: rates above 0 are 1 plus posteriors times one number a domain, the others would be below
    inside = rate > 1e-9
    numbers = np.linalg.lstsq(p[inside][:, held], rate[inside] - 1, rcond=None)[0]
    assert np.abs(np.maximum(0, 1 + p[:, held] @ numbers) - rate).max() < 1e-6
