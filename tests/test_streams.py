from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators.merge import Spec
from tidemark.sources.snapshots import current_version, read_snapshot
from tidemark.streaming import streams

BASE = datetime(2024, 1, 1)


def feed(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")


def drain(query):
    query.awaitTermination(180)
    assert query.exception() is None


def test_dedupe_survives_a_restart(spark, tmp_path):
    schema = "delivery_guid string, received_at timestamp"
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def run():
        df = streams.dedupe_stream(spark.readStream.schema(schema).parquet(f"{src}/*"))
        drain(df.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start())

    feed(spark, src, "a", [("g1", BASE), ("g1", BASE), ("g2", BASE + timedelta(hours=1))], schema)
    run()
    feed(spark, src, "b", [("g2", BASE + timedelta(hours=2)), ("g3", BASE + timedelta(hours=2))], schema)
    run()
    assert sorted(r[0] for r in spark.read.parquet(out).select("delivery_guid").collect()) == ["g1", "g2", "g3"]


def test_debounce_stream(spark, tmp_path):
    schema = "kind string, key string, received_at timestamp"
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def run():
        df = streams.debounce_stream(spark.readStream.schema(schema).parquet(f"{src}/*"), 5)
        drain(df.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start())

    feed(spark, src, "a", [("k", "a", BASE + timedelta(seconds=s)) for s in (0, 3, 4, 6, 9)], schema)
    run()
    feed(spark, src, "b", [("k", "b", BASE + timedelta(minutes=5))], schema)
    run()
    feed(spark, src, "c", [("k", "b", BASE + timedelta(minutes=9))], schema)
    run()
    got = sorted((r.key, r.opened_us) for r in spark.read.parquet(out).collect())
    first = got[0][1]
    assert [(k, (o - first) // 1_000_000) for k, o in got] == [("a", 0), ("a", 6), ("b", 300)]


def test_merge_sink_makes_one_version_a_batch(spark, tmp_path):
    schema = "id long, v string, gh_updated_at timestamp, last_checked_at timestamp, tombstoned_at timestamp"
    src, table, events, cp = (str(tmp_path / x) for x in ("in", "table", "events", "cp"))
    spec = Spec(("id",), ("v",))
    write = streams.merge_sink(table, spec, events, F.concat(F.lit("x:"), F.col("id").cast("string")), "x.changed")

    def run():
        df = spark.readStream.schema(schema).parquet(f"{src}/*")
        drain(df.writeStream.foreachBatch(write).option("checkpointLocation", cp).trigger(availableNow=True).start())

    day = [BASE + timedelta(days=n) for n in range(9)]
    feed(spark, src, "a", [(1, "a", day[1], day[1], None), (2, "a", day[1], day[1], None)], schema)
    run()
    feed(spark, src, "b", [(1, "b", day[2], day[2], None), (2, "old", day[0], day[3], None), (3, "c", day[1], day[1], None)], schema)
    run()
    assert current_version(spark, table) == 2
    assert {r.id: r.v for r in read_snapshot(spark, table).collect()} == {1: "b", 2: "a", 3: "c"}
    assert spark.read.parquet(events).count() == 4
    write(spark.read.schema(schema).parquet(f"{src}/b"), 1)  # a batch that comes again changes nothing
    assert {r.id: r.v for r in read_snapshot(spark, table).collect()} == {1: "b", 2: "a", 3: "c"} and spark.read.parquet(events).count() == 4


def test_tail_sink_keeps_cursors(spark, tmp_path):
    schema = "stream string, seq long"
    src, cursors, cp = (str(tmp_path / x) for x in ("in", "cursors", "cp"))
    seen = []
    deliver = streams.tail_sink(lambda df, n: seen.extend(r.seq for r in df.collect()), cursors, "c")
    for name, rows in (("a", [("e", 2), ("e", 1)]), ("b", [("e", 3), ("w", 4)])):
        feed(spark, src, name, rows, schema)
        drain(spark.readStream.schema(schema).parquet(f"{src}/*").writeStream.foreachBatch(deliver).option("checkpointLocation", cp).trigger(availableNow=True).start())
    assert seen == [1, 2, 3, 4]
    assert {(r.stream, r.cursor_seq) for r in streams.cursor_of(spark, cursors).collect()} == {("e", 3), ("w", 4)}


def test_histogram_stream(spark, tmp_path):
    schema = "received_at timestamp, committed_at timestamp"
    feed(spark, str(tmp_path / "in"), "a", [(BASE, BASE + timedelta(seconds=s)) for s in (1, 4, 30)], schema)
    df = streams.latency_histogram_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), [5, 60])
    drain(df.writeStream.format("memory").queryName("hist").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    row = spark.table("hist").first()
    assert (row.le_5, row.le_60, row.n, row.invalid) == (2, 3, 3, 0)
