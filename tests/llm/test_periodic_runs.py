"""Periodic runs against a brute force over every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.common import table
from tidemark.llm.periodic_runs import find_runs, periodic_runs

SCHEMA = "doc_id long, text string, row string, id string, name string"


def brute_runs(codes, least=12):
    n, best = len(codes), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if codes[i] != codes[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and codes[j] == codes[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    n = len(w)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    top = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    best = (None,) * 4 if top is None else (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2])
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def check(codes, least=12):
    assert [tuple(r) for r in find_runs(np.array(codes), least).tolist()] == brute_runs(list(codes), least)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.sampled_from([2, 5, 12]))
def test_few_words(codes, least):
    check(codes, least)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=9))
def test_repeated_pieces(pieces):
    check([c for piece, times in pieces for c in piece * times])


def test_squares_around_a_break_and_fibonacci_words():
    check([0, 1] * 20 + [0] + [0, 1] * 20 + [0])
    check(([0, 1] * 9 + [0]) * 5 + [2] + ([0, 1, 0] * 7 + [1]) * 4)
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    check(b)
    check([0] * 700)
    rng = random.Random(3)
    for period in (1, 2, 3, 7, 15, 16, 17, 31, 33, 64, 100):
        piece = [rng.randrange(4) for _ in range(period)]
        check([5, 6] + piece * 2 + piece[: period // 3] + [7] + piece * 4 + [8])


@pytest.mark.parametrize("seed", range(6))
def test_random_words(seed):
    rng = random.Random(seed)
    check([rng.randrange(2 + seed) for _ in range(500)])


def test_reports(spark):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c"), (None, "a b " * 9), (4, "x " * 30), (4, "x " * 30), (5, "a b c d " * 12), (6, "é ü " * 40_000), (7, "Aa aA " * 4)]
    rows += [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(160)))) for i in range(20, 80)]
    got = periodic_runs(spark.createDataFrame([(*r, "r", "i", "n") for r in rows], SCHEMA), rewrite=True).collect()
    small = [(d, t) for d, t in rows if d != 6]
    assert sorted(map(str, (tuple(r)[:-1] for r in got if r.doc_id != 6))) == sorted(map(str, (brute_report(d, t) for d, t in small)))
    assert [(r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.collapsed) for r in got if r.doc_id == 6] == [(1, 0, 80_000, 2, 40_000_000, "é ü")]
    assert all(hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 for r in got)
    assert any(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 and r.n_runs for r in got)
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_against_brute_force(spark):
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = __spark_entry__.queries()["op12_periodic_runs"](spark, sf).collect()
    assert len(got) == len(docs)
    few = [r for r in got if len((docs[r.doc_id] or "").split()) <= 700]
    assert len(few) > 150 and sum(r.n_runs for r in few) > 10
    assert sorted(map(str, map(tuple, few))) == sorted(str(brute_report(r.doc_id, docs[r.doc_id])) for r in few)
