import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import components, table
from tidemark.llm.simhash import hamming_links, simhash_groups

SCHEMA = "doc_id long, text string, row string, fp string"


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    if not runs:
        return 0
    h = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in runs], dtype=np.uint64)
    return sum(1 << b for b in range(64) if int(((h >> np.uint64(b)) & np.uint64(1)).sum()) * 2 > len(h))


def brute(rows):
    fps = {(i, d): brute_fp(t) for i, (d, t) in enumerate(rows)}
    keys = list(fps)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for k in keys:
        if k[1] is not None:
            low[find(k)] = min(low.get(find(k), k[1]), k[1])
    return sorted((d is None, d or 0, f"{fps[i, d]:016x}", low.get(find((i, d)))) for i, d in keys)


def run(df):
    return sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in df.collect())


def test_matches_brute_force_on_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    assert run(simhash_groups(docs)) == brute([tuple(r) for r in docs.collect()])


def test_nulls_ties_short_texts_and_repeats(spark):
    rows = [(5, None), (3, ""), (9, " \t"), (None, "a b c d"), (7, "A b c d"), (7, "a b c d"), (1, "one two"), (2, "one"), (4, "É é É é"), (6, "x " * 9000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    assert run(simhash_groups(df)) == brute(rows)


def test_empty_table(spark):
    assert simhash_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_dense_postings_keep_every_link(spark, monkeypatch):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    values = {base}
    for _ in range(400):
        v = rng.choice(sorted(values))
        for _ in range(rng.randint(1, 3)):
            v ^= 1 << rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 63])
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(50)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in signed], "fp long")

    def grouped():
        return {r[0]: r[1] for r in components(hamming_links(df)).collect()}

    listed = grouped()
    monkeypatch.setattr(simhash, "PAIRED_POSTING", 3)
    assert grouped() == listed
    root = {v: v for v in signed}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {v: find(v) for v in listed} == listed
    assert {v for v in signed if find(v) != v} <= set(listed)


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(edges).collect()
    assert len(got) == 201 and {r[1] for r in got} == {0}


def test_tally_drops_pairs_that_meet(spark):
    from tidemark.llm.simhash import shared_bytes

    # the first two share four bytes and meet in a posting, the last two differ in one bit
    pairs = [(0x1122334400000000, 0x1122334455667788), (0x1122334455667788, 0x1122334455667789)]
    got = spark.createDataFrame(pairs, "a long, b long").select(shared_bytes(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [4, 7]
    fps = spark.createDataFrame([(a,) for p in pairs for a in p], "fp long").distinct()
    for bits in (1, 2):
        assert {frozenset(r) for r in hamming_links(fps, bits).collect()} == {frozenset(pairs[1])}
