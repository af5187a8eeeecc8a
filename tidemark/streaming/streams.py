"""The streaming forms: the same operators over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import changes, merge
from ..operators.dispatch import expand_targets, intent_key, match_rules
from ..operators.merge import Spec
from ..sources.deliveries import decode_payload, project_envelope
from ..sources.snapshots import append_events, current_version, read_snapshot, write_snapshot


def dedupe_stream(df: DataFrame, lookback: str = "3 days") -> DataFrame:
    """The first of each delivery within the lookback; state older than it is dropped."""
    return df.withWatermark("received_at", lookback).dropDuplicatesWithinWatermark(["delivery_guid"])


def intent_stream(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Deliveries to intents; rows that can't be decoded are left to ``split_poison`` on the same input."""
    good = project_envelope(decode_payload(df).where("decode_error is null"))
    return intent_key(expand_targets(match_rules(good, rules))).where("key is not null").withColumn("priority", F.lit("event"))


def coalesce_stream(intents: DataFrame, window: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """One row per (kind, key, priority) and window with the earliest received_at."""
    return intents.withWatermark("received_at", late).groupBy(F.window("received_at", window), "kind", "key", "priority").agg(F.min("received_at").alias("first_at"), F.count(F.lit(1)).alias("n")).drop("window")


def debounce_stream(intents: DataFrame, seconds: int = 5, late: str = "10 seconds") -> DataFrame:
    """Windows opened by a key's first intent, emitted when the watermark passes their end; later intents in them don't extend them."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened = list(state.get[0]) if state.exists else []
        if not state.hasTimedOut:
            for batch in batches:
                opened += [t.value // 1000 for t in batch["received_at"]]
        opened.sort()
        mark, out, begin = state.getCurrentWatermarkMs() * 1000, [], None
        rest: list[int] = []
        for t in opened:
            if begin is None or t >= begin + seconds * 1_000_000:
                begin = t
                if begin + seconds * 1_000_000 <= mark:
                    out.append((*key, begin, begin + seconds * 1_000_000))
            if begin + seconds * 1_000_000 > mark:
                rest.append(t)
        if rest:
            state.update((rest,))
            state.setTimeoutTimestamp(max(rest[0] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["kind", "key", "opened_us", "due_us"])

    keyed = intents.withWatermark("received_at", late).select("kind", "key", "received_at")
    return keyed.groupBy("kind", "key").applyInPandasWithState(fold, "kind string, key string, opened_us long, due_us long", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def merge_sink(table: str, spec: Spec, events: str | None = None, entity_key=None, kind: str = "") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges observations into the versioned table; version n + 1 is batch n, so a batch that comes again makes the same version."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = batch_id + 1
        before = [v for v in [current_version(spark, table)] if v is not None]
        if before and before[0] > version:
            return
        state = read_snapshot(spark, table, min(before[0], version - 1)) if before and version > 1 else spark.createDataFrame([], _state_schema(batch, spec))
        merged = merge.merge_if_newer(state, batch, spec).persist()
        write_snapshot(merged.drop("change"), table, version)
        if events:
            changed = merged.where("change <> 'kept'").select(entity_key.alias("entity_key"), F.lit(kind).alias("kind"))
            append_events(changed, events, batch_id)
        merged.unpersist()

    return write


def _state_schema(batch: DataFrame, spec: Spec):
    from pyspark.sql import types as T

    names = list(dict.fromkeys((*spec.keys, *spec.payload, spec.version, *spec.extra)))
    return T.StructType([T.StructField(n, batch.schema[n].dataType if n in batch.columns else T.TimestampNTZType()) for n in names])


def tail_sink(handler: Callable[[DataFrame, int], None], cursors: str, consumer: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each batch on in order of seq and keeps the consumer's cursor with it."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        ordered = batch.orderBy("seq").persist()
        handler(ordered, batch_id)
        append_events(ordered.groupBy("stream").agg(F.max("seq").alias("seq")).withColumn("consumer", F.lit(consumer)), cursors, batch_id)
        ordered.unpersist()

    return deliver


def cursor_of(spark: SparkSession, cursors: str) -> DataFrame:
    return changes.advance_cursor(spark.createDataFrame([], "consumer string, stream string, cursor_seq long"), spark.read.parquet(cursors))


def latency_histogram_stream(df: DataFrame, bounds: list[float], window: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Latency buckets per window of commit time."""
    s = (F.unix_micros("committed_at") - F.unix_micros("received_at")) / 1_000_000
    sums = [F.count_if(s <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return df.withWatermark("committed_at", late).groupBy(F.window("committed_at", window)).agg(*sums, F.count(F.lit(1)).alias("n"), F.count_if(s < 0).alias("invalid"))
