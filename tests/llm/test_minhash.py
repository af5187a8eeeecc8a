"""MinHash groups against all pairs, sketches against their definition, and buckets that stars alone don't settle."""

import random

import numpy as np

from tidemark.llm import minhash
from tidemark.llm.common import table
from tidemark.llm.minhash import minhash_groups

SCHEMA = "doc_id long, text string, sha string, t string, k string, row string"


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    links = 0
    for i, j in {(i, j) for h in holders.values() for i in h for j in h if i < j}:
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            links += 1
            root = [root[i] if r == root[j] else r for r in root] if root[i] != root[j] else root
    low = {r: min([d for (d, _), x in zip(rows, root) if x == r and d is not None], default=None) for r in set(root)}
    return [(d, len(s), low[r] if s else d, d == (low[r] if s else d)) for (d, _), s, r in zip(rows, sets, root)], links


def got(spark, rows):
    out = minhash_groups(spark.createDataFrame([(*r, "s", "t", "k", "r") for r in rows], SCHEMA))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(str, (tuple(r) for r in out.collect())))


def copies(rng, words, times, changes):
    for _ in range(times):
        other = list(words)
        for i in rng.sample(range(len(words)), changes):
            other[i] = f"c{rng.randrange(10**6)}"
        yield " ".join(other)


def test_against_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for n in (3, 6, 10, 11, 12, 40, 120, 500):
        for _ in range(6):
            words = [f"w{rng.randrange(900)}" for _ in range(n)]
            rows += [" ".join(words), " ".join(words).title(), " ".join(words[:-1])]
            for changes in (1, max(1, n // 80), max(1, n // 50), max(1, n // 30)):
                rows += copies(rng, words, 2, changes)
    rng.shuffle(rows)
    rows = list(enumerate(rows)) + [(900, ""), (901, None), (902, " \t\n"), (903, rows[0]), (903, rows[0]), (None, rows[1]), (None, None), (904, "É é"), (905, "é É"), (906, "x" * 400_000), (907, "y z " * 100_000)]
    expected, links = brute(rows)
    assert links > 300 and got(spark, rows) == sorted(map(str, expected))
    assert got(spark, []) == []


def test_buckets_with_several_components(spark, monkeypatch):
    """Texts that share a long passage meet in buckets whose centres most of them are not linked with."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for _ in range(60):
        own = passage + [f"w{rng.randrange(10**6)}" for _ in range(30)]
        rows.append(" ".join(own))
        rows += copies(rng, own, 2, 1)
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    expected, links = brute(rows)
    assert links > 100
    for crowded in (200, 3):
        monkeypatch.setattr(minhash, "CROWDED", crowded)
        assert got(spark, rows) == sorted(map(str, expected))


def test_chain_is_one_component(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        rows.append((500 - i, " ".join(words)))
        words[rng.randrange(200)] = f"n{i}"
        words[rng.randrange(200)] = f"m{i}"
    expected, _ = brute(rows)
    assert len({r[2] for r in expected}) == 1 and got(spark, rows) == sorted(map(str, expected))


def test_sketch_agrees_as_often_as_sets_are_similar():
    rng = np.random.default_rng(2)
    for n, apart in ((9, 3), (40, 10), (1000, 200)):
        pairs = []
        for _ in range(300):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
            pairs.append((np.sort(x[apart // 2 :]), np.sort(np.concatenate([x[: apart // 2], x[apart:]]))))
        a, b = minhash.sketches([p for p, _ in pairs]), minhash.sketches([p for _, p in pairs])
        assert abs((a == b).mean() - (1 - apart / n)) < 0.03
        assert all(set(r) <= set(p) for r, (p, _) in zip(a, pairs, strict=True))


def test_query_against_all_pairs(spark):
    import __spark_entry__

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    expected, links = brute(rows)
    out = __spark_entry__.queries()["op11_minhash"](spark, sf)
    assert links > 20 and sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, expected))
