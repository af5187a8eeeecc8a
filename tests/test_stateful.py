import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.changes import safe_seq
from tidemark.operators.dispatch import bump_generations, complete_generations
from tidemark.operators.merge import mark_dirty
from tidemark.streaming import stateful

BASE = datetime(2024, 1, 1)


@pytest.fixture
def on_disk(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    stateful.keep_state_on_disk(spark)
    yield spark
    spark.conf.set(name, before)


def batches(spark, tmp_path, stream, schema, parts):
    """Output rows of each batch; the query is started anew for every one and goes on from its checkpoint."""
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{n}")
        sink = stream(spark.readStream.schema(schema).parquet(f"{src}/*")).writeStream.foreachBatch(lambda df, i: df.withColumn("n", F.lit(i)).write.mode("append").parquet(out))
        query = sink.option("checkpointLocation", cp).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    return sorted(spark.read.parquet(out).collect(), key=lambda r: r.n)


def latest(rows, keys, values):
    return {tuple(r[k] for k in keys): tuple(r[v] for v in values) for r in rows}


def test_watermark_equals_the_batch_result_and_never_falls(on_disk, tmp_path):
    rng, parts, open_ = random.Random(3), [], []
    for n in range(3):
        rows = []
        for seq in range(n * 90 + 1, n * 90 + 91):
            stream = rng.choice("ab")
            rows.append((stream, seq, False))
            open_.append((stream, seq))
        rng.shuffle(open_)
        done, open_ = open_[: len(open_) * 5 // 6], open_[len(open_) * 5 // 6 :]
        rows += [(*x, True) for x in done]
        parts.append(rows + rows[:5] + [("a", None, True)])
    parts.append([(*x, True) for x in open_])
    schema = "stream string, seq long, committed boolean"
    got = batches(on_disk, tmp_path, stateful.watermark_stream, schema, parts)
    for name in "ab":
        told = [r.safe_seq for r in got if r.stream == name]
        assert told == sorted(set(told)) and len(told) > 1
    every = on_disk.createDataFrame([x for p in parts for x in p if x[1] is not None], schema)
    want = safe_seq(every.groupBy("stream", "seq").agg(F.max("committed").alias("committed")))
    assert latest(got, ["stream"], ["safe_seq"]) == {(r.stream,): (r.safe_seq,) for r in want.collect()}


def test_dirty_scopes_equal_the_batch_result(on_disk, tmp_path):
    rng = random.Random(5)
    parts = [[(f"s{rng.randrange(6)}", BASE + timedelta(seconds=rng.randrange(500)), False) for _ in range(20)] for _ in range(2)]
    parts.append([("s0", BASE + timedelta(seconds=900), True), ("s1", BASE - timedelta(days=1), True), ("s2", None, True), *parts[0]])
    schema = "scope_key string, at timestamp, cleared boolean"
    got = latest(batches(on_disk, tmp_path, stateful.dirty_stream, schema, parts), ["scope_key"], ["marked_us", "dirty"])
    marks = on_disk.createDataFrame([x for p in parts for x in p if x[1] is not None and not x[2]], schema).withColumnRenamed("at", "marked_at")
    want = mark_dirty(marks.limit(0), marks).select("scope_key", F.unix_micros("marked_at").alias("us")).collect()
    assert got == {(r.scope_key,): (r.us, r.scope_key != "s0") for r in want}


def test_generations_equal_the_batch_operators_and_tell_overdue(on_disk, tmp_path):
    def intent(key, s, due):
        return ("k", key, BASE + timedelta(seconds=s), BASE + timedelta(seconds=due), None)

    def done(key, s, generation):
        return ("k", key, BASE + timedelta(seconds=s), None, generation)

    parts = [
        [intent("a", 1, 50), intent("a", 2, 40), intent("b", 3, 900), intent(None, 1, 5000)],
        [intent("a", 20, 70), done("b", 20, 1), done("a", 21, 1)],
        [intent("c", 100, 4000), done("a", 100, 1)],
        [intent("c", 101, 3000)],
    ]
    schema = "kind string, key string, received_at timestamp, deadline timestamp, done_generation long"
    got = batches(on_disk, tmp_path, stateful.generations_stream, schema, parts)
    state = on_disk.createDataFrame([], "kind string, refresh_key string, generation long, completed_generation long, deadline timestamp, event_received_at timestamp")
    for rows in parts:
        df = on_disk.createDataFrame(rows, schema)
        ended = df.where("done_generation is not null").select("kind", F.col("key").alias("refresh_key"), F.col("done_generation").alias("generation"))
        state = complete_generations(bump_generations(state.where("refresh_key is not null"), df.where("done_generation is null and key is not null")), ended)
    want = {(r.refresh_key,): (r.generation, r.completed_generation, r.d, r.e) for r in state.select("*", F.unix_micros("deadline").alias("d"), F.unix_micros("event_received_at").alias("e")).collect()}
    mine = latest([r for r in got if not r.overdue and r.refresh_key is not None], ["refresh_key"], ["generation", "completed_generation", "deadline_us", "received_us"])
    assert mine == want and want[("b",)][2] is None and want[("a",)][0] == 2
    late = [(r.refresh_key, r.generation) for r in got if r.overdue]
    assert late == [("a", 2)]
