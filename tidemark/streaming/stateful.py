"""Streams whose state outlives batches: refresh generations, dirty scopes, and the watermark of visible sequence numbers.

State is kept by Spark (``transformWithState``), which needs the RocksDB state store: call ``keep_state_on_disk`` first.
A stream that starts again from its checkpoint goes on from the state of its last finished batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Parts of a stream of events that are followed on their own, so that one busy stream doesn't meet in one task.
LANES = 64


def keep_state_on_disk(spark: SparkSession) -> None:
    """State of streams started from now on is held by RocksDB beside the checkpoint, not in the executors' heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class _Generations(StatefulProcessor):
    """Per (kind, key) the generation, the completed one, deadline and event time, in microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("generation", "generation long, completed long, deadline long, received long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        generation, completed, deadline, received = self.state.get() if self.state.exists() else (0, 0, None, None)
        intents, done = False, None
        for r in rows:
            if r.done_generation is None:
                intents, deadline, received = True, _least(deadline, r.deadline_us), _least(received, r.received_us)
            else:
                done = r.done_generation if done is None else max(done, r.done_generation)
        generation += intents
        if done is not None:
            completed = max(completed, done)
            if done >= generation:
                deadline = received = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if deadline is not None:
            self.handle.registerTimer(max(deadline // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        self.state.update((generation, completed, deadline, received))
        yield Row(kind=key[0], refresh_key=key[1], generation=generation, completed_generation=completed, deadline_us=deadline, received_us=received, overdue=False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        generation, completed, deadline, received = self.state.get()
        yield Row(kind=key[0], refresh_key=key[1], generation=generation, completed_generation=completed, deadline_us=deadline, received_us=received, overdue=True)

    def close(self) -> None:
        pass


def generations_stream(changes: DataFrame, late: str = "10 seconds") -> DataFrame:
    """The new state of every (kind, key) that a batch touches, and a row with ``overdue`` once the watermark passes a deadline whose generation isn't done.

    ``changes`` (kind, key, received_at, deadline, done_generation): a row without done_generation is an intent, one with
    it tells that this generation is done. As in ``bump_generations`` and then ``complete_generations``, a key's intents of a batch
    make one generation more, deadline and event time become the earlier ones, and both are cleared by the end of the
    present generation. Null keys are keys of their own. The state is one row a key.
    """
    timed = changes.withWatermark("received_at", late)
    rows = timed.select("kind", F.col("key").alias("refresh_key"), "received_at", F.unix_micros("received_at").alias("received_us"), F.unix_micros("deadline").alias("deadline_us"), F.col("done_generation").cast("long").alias("done_generation"))
    out = "kind string, refresh_key string, generation long, completed_generation long, deadline_us long, received_us long, overdue boolean"
    return rows.groupBy("kind", "refresh_key").transformWithState(_Generations(), out, "append", "eventTime")


class _Dirty(StatefulProcessor):
    """Per scope the latest time at which it was marked and the latest at which it was cleared."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getMapState("times", "what string", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = {what: self.times.getValue((what,))[0] if self.times.containsKey((what,)) else None for what in ("marked", "cleared")}
        now = dict(held)
        for r in rows:
            what = "cleared" if r.cleared else "marked"
            now[what] = r.at_us if now[what] is None else max(now[what], r.at_us)
        for what in ("marked", "cleared"):
            if now[what] != held[what]:
                self.times.updateValue((what,), (now[what],))
        if now != held:
            dirty = now["marked"] is not None and (now["cleared"] is None or now["marked"] > now["cleared"])
            yield Row(scope_key=key[0], marked_us=now["marked"], dirty=dirty)

    def close(self) -> None:
        pass


def dirty_stream(marks: DataFrame) -> DataFrame:
    """Scopes whose state a batch of ``marks`` (scope_key, at, cleared) changes: scope_key, marked_us (the latest mark), dirty.

    A scope is dirty while its latest mark is later than its latest clearing, whatever the order in which they arrive;
    marks that come again change nothing. Rows without a time are left out.
    """
    rows = marks.where("at is not null").select("scope_key", F.unix_micros("at").alias("at_us"), F.coalesce("cleared", F.lit(False)).alias("cleared"))
    return rows.groupBy("scope_key").transformWithState(_Dirty(), "scope_key string, marked_us long, dirty boolean", "append", "none")


class _Open(StatefulProcessor):
    """Per lane of a stream the numbers announced and not yet committed, and the greatest one seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "seq long", "one boolean")
        self.top = handle.getValueState("top", "top long, first long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        top, first = self.top.get() if self.top.exists() else (None, None)
        before, began, done = (top, first), set(), set()
        for r in rows:
            top = r.seq if top is None else max(top, r.seq)
            (done if r.committed else began).add(r.seq)
        began -= done  # a number's commit wins over its announcement in one batch
        for seq in began:
            self.open.updateValue((seq,), (True,))
        closed = [seq for seq in done if self.open.containsKey((seq,))]
        for seq in closed:
            self.open.removeKey((seq,))
        if first in closed:
            first = min((k[0] for k in self.open.keys()), default=None)
        elif began:
            first = _least(first, min(began))
        if (top, first) != before:
            self.top.update((top, first))
            yield Row(stream=key[0], lane=key[1], top=top, first_open=first)

    def close(self) -> None:
        pass


class _Safe(StatefulProcessor):
    """Per stream the lanes' first open numbers and greatest ones, and the watermark last told."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lanes = handle.getMapState("lanes", "lane int", "top long, first_open long")
        self.told = handle.getValueState("told", "seq long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in rows:
            self.lanes.updateValue((r.lane,), (r.top, r.first_open))
        tops, firsts = zip(*self.lanes.values(), strict=True)
        gaps = [f for f in firsts if f is not None]
        safe = min(gaps) - 1 if gaps else max(tops)
        told = self.told.get()[0] if self.told.exists() else None
        if told is None or safe > told:
            self.told.update((safe,))
            yield Row(stream=key[0], safe_seq=safe)

    def close(self) -> None:
        pass


def watermark_stream(events: DataFrame) -> DataFrame:
    """(stream, safe_seq) whenever the sequence below which everything is committed rises; it never falls.

    ``events`` (stream, seq, committed): a number comes with committed false when it is handed out and with true when it
    commits, not in a later batch than that; repeats change nothing and rows without a number are left out. What is kept grows with the numbers
    handed out and not committed alone. A stream is followed in ``LANES`` lanes by its numbers, whose changes meet once a batch.
    """
    rows = events.where("seq is not null").select("stream", F.col("seq").cast("long").alias("seq"), F.coalesce("committed", F.lit(False)).alias("committed"), F.pmod("seq", F.lit(LANES)).cast("int").alias("lane"))
    lanes = rows.groupBy("stream", "lane").transformWithState(_Open(), "stream string, lane int, top long, first_open long", "append", "none")
    return lanes.groupBy("stream").transformWithState(_Safe(), "stream string, safe_seq long", "append", "none")
