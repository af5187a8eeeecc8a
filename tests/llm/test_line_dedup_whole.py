import glob
import random
import time

import numpy as np
from test_line_dedup import edits, norm_lines

from tidemark.llm import common, line_dedup
from tidemark.llm.common import table
from tidemark.llm.line_dedup import line_blocks, line_dedup_report
from tidemark.llm.queries import op1_line_dedup


def sample(spark):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").where("text is not null").select("text").limit(400).collect()]
    return sorted({x for t in texts for x in norm_lines(t) if x.isascii() and len(x) >= 30})


def letters(rng, x, share):
    out = list(x)
    for i in rng.sample(range(len(x)), max(1, int(share * len(x)))):
        out[i] = rng.choice("abcdefghijklmnopqrstuvwxyz")
    return "".join(out)


def word(rng, x, share):
    words = x.split(" ")
    i = rng.randrange(len(words))
    words[i] = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in words[i])
    return " ".join(words)


def blocks(lines):
    at, slots, _ = line_blocks([x.encode() for x in lines])
    return [set(slots[np.flatnonzero(at == i)].tolist()) for i in range(len(lines))]


def test_blocks_find_changed_lines(spark):
    rng = random.Random(2)
    lines = sample(spark)
    for low, high in ((30, 80), (80, 160), (160, 400), (400, 1000)):
        some = rng.sample([x for x in lines if low <= len(x) < high], 100)
        for change, share, least in ((letters, 0.0, 0.99), (word, 0.0, 0.95), (letters, 0.05, 0.9), (letters, 0.10, 0.4)):
            changed = [change(rng, x, share) for x in some]
            slots = blocks(some + changed)
            met = [bool(a & b) for a, b in zip(slots[:100], slots[100:], strict=True)]
            assert sum(met) / len(met) >= least, (low, change.__name__, share, sum(met))


def test_short_lines_of_one_edit_always_meet():
    rng = random.Random(4)
    for _ in range(300):
        x = "".join(rng.choice("ab cé水") for _ in range(rng.randint(5, 9))).strip() or "abcde"
        i = rng.randrange(len(x))
        for y in (x[:i] + "z" + x[i + 1 :], x[:i] + x[i + 1 :]):
            if y and max(len(x), len(y)) <= 9:
                a, b = blocks([x, y])
                assert a & b


def test_links_match_edit_similarity_alone(spark):
    rng = random.Random(6)
    rows, seen = [], []
    for d, x in enumerate(rng.sample([x for x in sample(spark) if 30 <= len(x) < 300 and len(x.split(" ")) >= 8], 30)):
        for y in (x, letters(rng, x, 0.0), letters(rng, x, 0.05), word(rng, x, 0.0)):
            rows.append((len(rows), y))
            seen.append((d, norm_lines(y)[0]))
    removed = sum(len(r.removed) for r in line_dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    root = list(range(len(seen)))
    for i in range(len(seen)):
        for j in range(i):
            a, b = seen[i][1], seen[j][1]
            if root[i] != root[j] and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(set(a.split()) & set(b.split())) > 2 and edits(a, b) <= 0.2 * max(len(a), len(b)):
                root = [root[j] if r == root[i] else r for r in root]
    expected = len(seen) - len(set(root))
    assert expected >= 90
    assert 0.97 * expected <= removed <= expected


def test_query_takes_the_whole_job(spark, tmp_path):
    line = "a quiet river carries the old letters across seven winter fields again"
    spark.createDataFrame([(1, line), (2, line.replace("river", "stone"))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.removed for r in op1_line_dedup(spark, str(tmp_path)).collect()} == {1: [], 2: [0]}


def test_every_line_that_is_not_blank_counts(spark, tmp_path):
    thai = "แม่น้ำสายเก่าไหลผ่านทุ่งนาในฤดูหนาว"
    chinese = "那条安静的河流把旧信带过了七片冬天的田野，然后又回到了大海的身边。"
    rows = [(1, f"Contents\n\n \t\n{thai}\n{chinese}\n* * *\n}}"), (2, f"  contents!\n\n{thai}\n{chinese.replace('七', '八')}\n***\nend"), (3, "\n \n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.removed for r in op1_line_dedup(spark, str(tmp_path)).collect()} == {1: [], 2: [0, 2, 3, 4], 3: []}


def test_shuffle_files_are_let_go_on_the_way(spark):
    def held():
        return set(glob.glob(f"{spark.sparkContext.getConf().get('spark.local.dir')}/**/shuffle_*.data", recursive=True))

    rng = random.Random(4)
    rows = []
    for i in range(300):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(20)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:9], "changed", *words[10:]]))]
    common.release(spark)
    time.sleep(2)
    before = held()
    seen = []

    def watched(*args, **kwargs):
        time.sleep(2)  # files are deleted in the background
        seen.append(len(held() - before))
        return components(*args, **kwargs)

    components, line_dedup.components = line_dedup.components, watched
    try:
        removed = sum(r.n_removed for r in line_dedup.line_dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    finally:
        line_dedup.components = components
    assert removed == 300
    # the second time all links are known, and what found them is gone
    assert len(seen) == 2 and seen[1] <= 8, seen
