import math
import random

import pyarrow as pa

from tidemark.llm import common
from tidemark.llm import line_dedup as module
from tidemark.llm.common import table
from tidemark.llm.line_dedup import dedup_lines, edit_similar, line_dedup_report, normalise

SCHEMA = "doc_id long, text string, row string, removed string, __x int, doc_key string, doc string, `left` string, `a.b` string"
MORE = ("c", "c", 1, "c", "c", "c", "c")


def norm_lines(text):
    if text is None:
        return []
    plain = "".join("0" if c in "0123456789" else c if c == "\n" or ord(c) > 127 or "a" <= c <= "z" else " " for c in text.lower())
    lines = [" ".join(x for x in line.split(" ") if x) for line in plain.split("\n")]
    return [x or "".join(c for c in y if c > " " and ord(c) != 127) for x, y in zip(lines, text.lower().split("\n"), strict=True)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    """rows have distinct identifiers."""
    seen = sorted((d, p, x) for d, t in rows for p, x in enumerate(norm_lines(t)) if x)
    texts = sorted({x for _, _, x in seen})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and edits(a, b) <= math.floor(0.2 * max(len(a), len(b)) + 1e-9):
                root[find(i)] = find(j)
    number = {x: i for i, x in enumerate(texts)}
    kept, gone = set(), {}
    for d, p, x in seen:
        g = find(number[x])
        if g in kept:
            gone.setdefault(d, []).append(p)
        kept.add(g)
    return sorted((d, gone.get(d, [])) for d, _ in rows)


def got(df):
    return sorted((r.doc_id, r.removed) for r in df.collect())


def test_normalise_matches_its_definition():
    texts = ["Hello, World!\n\n  A  1 b \n***\n x", "", "É Ü\t z\n", "a", "\n", "  ", "水 水\nabc", "&& \x00 |\n=="]
    lines, owner = normalise(pa.array(texts))
    assert [x.decode() for x in lines] == [x for t in texts for x in norm_lines(t)]
    assert owner.tolist() == [i for i, t in enumerate(texts) for _ in t.split("\n")]


def test_edit_similarity_matches_its_definition():
    rng = random.Random(1)
    for _ in range(1500):
        b = a = [rng.choice("abcé") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 9)):
            i = rng.randint(0, len(b))
            b = b[:i] + rng.choice([[], ["x"], [rng.choice("abc")]]) + b[i + rng.randint(0, 1) :]
        a, b = "".join(a), "".join(b)
        assert edit_similar(a, b) == (edits(a, b) <= math.floor(max(len(a), len(b)) * 0.2 + 1e-9))
    long = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    assert edit_similar(long, "x" + long[:30_000] + long[30_100:]) and not edit_similar(long, long[::-1])


def test_fuzzy_lines_match_brute_force(spark):
    rng = random.Random(5)
    words = ["the", "river", "stone", "carries", "old", "letters", "across", "winter", "fields", "silently", "again"]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (6, 12, 30, 60)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(1, 5)):
            x = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                i = rng.randrange(len(x))
                x = x[:i] + rng.choice("abcdez ") + x[i + 1 :]
            lines.append(rng.choice([x, x.upper(), x + "!!", "  " + x]))
        lines.append("short line")
        rows.append((d, "\n".join(lines)))
    df = spark.createDataFrame([(*r, *MORE) for r in rows], SCHEMA)
    every = {(d, p) for d, gone in brute(rows) for p in gone}
    expected = got(line_dedup_report(df))
    found = {(d, p) for d, gone in expected for p in gone}
    assert found <= every and len(found) >= 0.97 * len(every) and len(every) > 30
    out = dedup_lines(df)
    assert out.columns == df.columns and {tuple(r[2:]) for r in out.collect()} == {MORE}
    kept = {r.doc_id: r.text for r in out.collect()}
    for (d, gone), (_, text) in zip(expected, rows, strict=True):
        left = "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone)
        assert kept.get(d, "") == left


def test_nulls_empty_repeats_and_long(spark):
    long = " ".join(f"word{i % 977}" for i in range(2500))
    text = "one two three four five\n\nOne two, three four FIVE"
    rows = [(1, None), (2, ""), (3, text), (4, long), (5, long + " tail"), (3, text), (None, text)]
    df = spark.createDataFrame([(*r, *MORE) for r in rows], SCHEMA)
    out = sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.removed) for r in line_dedup_report(df).collect())
    assert [x for x in out if x[1] not in (4, 5)] == [(False, 1, 0, []), (False, 2, 0, []), (False, 3, 3, [0, 2]), (False, 3, 3, [2]), (True, 0, 3, [0, 2])]
    assert sum(len(x[3]) for x in out if x[1] in (4, 5)) == 1
    assert line_dedup_report(spark.createDataFrame([], SCHEMA)).collect() == dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    left = [(r.doc_id, r.text) for r in dedup_lines(df).collect() if r.doc_id in (1, 2, 3, None)]
    assert sorted(left, key=lambda x: x[0]) == [(1, None), (2, ""), (3, "one two three four five\n")]


def test_crowded_postings_are_dealt_out(spark, monkeypatch):
    rng = random.Random(8)
    base = [" ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(16)) for _ in range(3)]
    rows = []
    for d in range(60):
        x = rng.choice(base).split(" ")
        x[rng.randrange(16)] = "".join(rng.choice("klmnop") for _ in range(7))
        rows.append((d, " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    for size in (32, 2):
        monkeypatch.setattr(module, "PAIRED_POSTING", size)
        monkeypatch.setattr(common, "FILTER_WORDS", 64)
        assert got(line_dedup_report(df)) == expected


def test_crowded_posting_loses_no_pair(spark, monkeypatch):
    # 300 lines of one posting with sketches far apart; two similar ones differ in every byte of their SimHashes
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(60)).strip() for _ in range(299)]
    texts.append(texts[150][:-1] + "z")
    marks = [rng.getrandbits(55) << 8 for _ in texts]
    marks[299] = marks[150] ^ 0x0101010101010100

    def posted(batches):
        for batch in batches:
            k = batch.column("k")
            yield pa.RecordBatch.from_arrays([pa.array([7] * len(k), pa.int64()), k, pa.array([marks[x] for x in k.to_pylist()], pa.int64())], names=["slot", "k", "sketch"])

    monkeypatch.setattr(module, "_posted", posted)
    lines = spark.createDataFrame([(x.encode(), i, x.encode()) for i, x in enumerate(texts)], "key binary, k long, line binary")
    for size in (1024, 50):
        monkeypatch.setattr(module, "PAIRED_POSTING", size)
        links = [{bytes(r.a), bytes(r.b)} for r in module.similar_lines(lines).collect()]
        assert links == [{texts[150].encode(), texts[299].encode()}]


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").where("length(text) < 2500").limit(30).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(line_dedup_report(df)) == brute(rows)


def test_characters_bound_edits():
    rng = random.Random(7)
    for _ in range(300):
        a = [rng.choice("abcé水 x") for _ in range(rng.randint(1, 40))]
        b = [rng.choice("abcé水 y") if rng.random() < 0.2 else c for c in a if rng.random() > 0.1] or ["z"]
        a, b = "".join(a), "".join(b)
        counts = module._Lines([a.encode(), b.encode()]).letters()
        assert counts.sum(axis=1).tolist() == [len(a), len(b)]
        assert module.letters_bound(counts[:1], counts[1:])[0] <= edits(a, b)


def test_near_copies_are_not_paired_with_all(spark, monkeypatch):
    # copies of one line, each with two other words, so that one in four is similar to another; all meet in one posting
    rng = random.Random(10)
    base = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(16)]
    texts = []
    for _ in range(400):
        x = list(base)
        for i in rng.sample(range(16), 2):
            x[i] = "".join(rng.choice("klmnop") for _ in range(7))
        texts.append(" ".join(x))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compared = []

    def counted(df):
        out = cut(df)
        if df.columns == ["a", "b"]:
            compared.append(out.count())
        return out

    cut = module.cut
    monkeypatch.setattr(module, "cut", counted)
    gone = {(d, p) for d, at in got(line_dedup_report(df)) for p in at}
    assert len(gone) >= 390
    assert sum(compared) < 30 * len(texts), compared
