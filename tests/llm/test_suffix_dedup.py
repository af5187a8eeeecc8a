import hashlib
import random
from collections import Counter

import numpy as np

from tidemark.llm import suffix_dedup as module
from tidemark.llm.common import table
from tidemark.llm.suffix_dedup import core_size, repeated_starts, suffix_array, suffix_dedup

SCHEMA = "doc_id long, text string, key string, bytes string, spans int"


def brute(rows, length):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        kept = bytes(x for x, g in zip(b, gone[1:-1], strict=True) if not g)
        out.append((d is None, d or 0, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((r[0] is None, r[0] or 0, *r[1:5]) for r in df.collect())


def test_suffix_array_matches_sorting(monkeypatch):
    rng = random.Random(4)
    for queue in (1 << 20, 5):
        monkeypatch.setattr(module, "QUEUE_POSITIONS", queue)
        for _ in range(60):
            n = rng.randint(1, 120)
            body = [rng.choice([1, 2, 3, 4][: rng.randint(1, 4)]) for _ in range(n)]
            t = np.array([*body, 0], np.uint16)
            assert suffix_array(t, 1000).tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())


def test_repeated_starts():
    a, b = b"abcdefghijklmnop", b"xxabcdefghijkzz"
    short, hits = repeated_starts([a, b], np.array([len(a) - 7, len(b) - 7]), (8, 10))
    assert [np.flatnonzero(h).tolist() for h in hits] == [[0, 1], [2, 3]]
    assert [np.flatnonzero(h).tolist() for h in short] == [[0, 1, 2, 3], [2, 3, 4, 5]]


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh é") for _ in range(3000))
    rows = [(i, "".join(base[(k := rng.randrange(2500)) : k + rng.randint(50, 500)] + rng.choice("XYZ") * rng.randint(0, 3) for _ in range(rng.randint(0, 4)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "y" * 900), (103, "ab" * 300), (104, rows[3][1]), (None, rows[5][1]), (3, rows[3][1]), (105, "y" * 120), (106, "short"), (107, "short")]
    df = spark.createDataFrame([(*r, "c", "c", 1) for r in rows], SCHEMA)
    assert got(suffix_dedup(df, length=100)) == brute(rows, 100)
    also = suffix_dedup(df, length=100, passage=80)
    assert got(also) == brute(rows, 100)
    # passages of 80 bytes are always told of, and nothing that has no repeated string of a core's size
    least, most = ({(*r[:2], r[2]): r[3] for r in brute(rows, n)} for n in (80, core_size(80)))
    told = {(r.doc_id is None, r.doc_id or 0, r.n_bytes): r.n_repeated for r in also.collect()}
    assert all((told[k] > 0) >= (least[k] > 0) and told[k] <= most[k] for k in told) and sum(v > 0 for v in told.values()) > 20
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in also.collect())
    monkeypatch.setattr(module, "HOT_PLACES", 1)
    monkeypatch.setattr(module, "SHARD_BYTES", 5000)
    assert got(suffix_dedup(df, length=100)) == brute(rows, 100)
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    assert got(suffix_dedup(docs)) == brute([tuple(r) for r in docs.collect()], 400)
