"""The change stream: watermark, tail, cursors, snapshots, replay, retention, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def safe_seq(events: DataFrame) -> DataFrame:
    """Per stream the greatest sequence below which everything is committed."""
    return events.groupBy("stream").agg(F.coalesce(F.min(F.when(~F.col("committed"), F.col("seq"))) - 1, F.max("seq")).alias("safe_seq"))


def visibility_watermark(events: DataFrame) -> int:
    """The greatest sequence of all streams below which everything is committed; 0 for an empty stream."""
    row = events.agg(F.min(F.when(~F.col("committed"), F.col("seq"))).alias("gap"), F.max("seq").alias("top")).first()
    return (row.gap - 1) if row.gap is not None else (row.top or 0)


def tail(events: DataFrame, stream: str, cursor: int, safe: int, limit: int) -> DataFrame:
    """A page: events of a stream after the cursor and up to the watermark, by sequence."""
    return events.where((F.col("stream") == stream) & (F.col("seq") > cursor) & (F.col("seq") <= safe)).orderBy("seq").limit(limit)


def advance_cursor(cursors: DataFrame, delivered: DataFrame) -> DataFrame:
    """Cursors (consumer, stream, cursor_seq) moved to the last delivered sequence, never back; delivering twice changes nothing."""
    d = delivered.groupBy("consumer", "stream").agg(F.max("seq").alias("last"))
    return cursors.join(d, ["consumer", "stream"], "full").select("consumer", "stream", F.greatest("cursor_seq", "last").alias("cursor_seq"))


def delivered_within(cursors: DataFrame, events: DataFrame, span: int) -> DataFrame:
    """(consumer, stream, seq): the ``events`` (stream, seq) whose sequence is after a cursor by ``span`` at most.

    Sequences meet in buckets of ``span`` numbers, of which a cursor needs two, so the work grows with cursors, events and
    what is delivered, not with cursors times events of a stream.
    """
    at = F.floor(F.col("cursor_seq") / span)
    c = cursors.select("consumer", "stream", "cursor_seq", F.explode(F.array(at, at + 1)).alias("bucket"))
    e = events.select("stream", "seq", F.floor(F.col("seq") / span).alias("bucket"))
    return c.join(e, ["stream", "bucket"]).where((F.col("seq") > F.col("cursor_seq")) & (F.col("seq") <= F.col("cursor_seq") + span)).select("consumer", "stream", "seq")


def resync_needed(cursors: DataFrame, horizons: DataFrame) -> DataFrame:
    """Consumers whose next event may have been pruned."""
    h = horizons.select("stream", "pruned_through_seq")
    return cursors.join(h, "stream", "left").select("consumer", "stream", "cursor_seq", (F.col("cursor_seq") < F.coalesce("pruned_through_seq", F.lit(0))).alias("resync"))


def bootstrap(entities: dict[str, DataFrame]) -> DataFrame:
    """Live entities of every kind as (kind, entity_key, document)."""
    out = None
    for kind, df in sorted(entities.items()):
        rows = df.where("tombstoned_at is null")
        doc = F.to_json(F.struct(*[c for c in sorted(df.columns) if c not in ("entity_key", "tombstoned_at")]))
        part = rows.select(F.lit(kind).alias("kind"), "entity_key", doc.alias("document"))
        out = part if out is None else out.unionByName(part)
    return out


def snapshot_size(snapshot: DataFrame, max_entities: int, max_bytes: int) -> DataFrame:
    """Entities and bytes of a snapshot against the limits."""
    return snapshot.agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum(F.octet_length("document")), F.lit(0)).alias("bytes")).withColumn("too_large", (F.col("entities") > max_entities) | (F.col("bytes") > max_bytes))


def materialize(events: DataFrame, state: DataFrame, kinds: list[str]) -> DataFrame:
    """Reference events joined with current live state by key; of what is gone a tombstone is told. Unknown kinds are ignored."""
    live = state.where("tombstoned_at is null").drop("tombstoned_at").withColumn("__live", F.lit(True))
    known = events.where(F.col("kind").isin(*kinds))
    return known.join(live, "entity_key", "left").withColumn("op", F.when(F.col("__live"), "upsert").otherwise("tombstone")).drop("__live")


#: Sequence numbers of a bucket of ``after_counts``.
BUCKET = 4096


def after_counts(events: DataFrame, points: DataFrame) -> DataFrame:
    """(stream, after_seq, outstanding, oldest): how many ``events`` (stream, seq, occurred_at) follow each of the ``points`` (stream, after_seq), and the earliest time among them.

    Events are counted in buckets of sequence numbers; a point takes the running counts of the buckets after its own and
    meets single events of its own bucket only, so the work grows with events and points, not with their product.
    """
    bucket = F.floor(F.col("seq") / BUCKET).alias("bucket")
    e = events.select("stream", "seq", "occurred_at", bucket)
    p = points.select("stream", "after_seq", F.floor(F.col("after_seq") / BUCKET).alias("bucket")).distinct()
    counts = e.groupBy("stream", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("occurred_at").alias("first"))
    every = counts.join(p.select("stream", "bucket").distinct(), ["stream", "bucket"], "full")
    later = Window.partitionBy("stream").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = every.select("stream", "bucket", F.sum("n").over(later).alias("more"), F.min("first").over(later).alias("more_first"))
    inside = p.join(e, ["stream", "bucket"]).where("seq > after_seq").groupBy("stream", "after_seq").agg(F.count(F.lit(1)).alias("n"), F.min("occurred_at").alias("first"))
    both = p.join(beyond, ["stream", "bucket"]).join(inside, ["stream", "after_seq"], "left")
    return both.select("stream", "after_seq", (F.coalesce("more", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("outstanding"), F.least("more_first", "first").alias("oldest"))


def replay_advisory(requests: DataFrame, events: DataFrame, horizons: DataFrame, safe: DataFrame, limit: int) -> DataFrame:
    """What stands against a replay from after_seq: pruned_horizon, future_sequence, replay_limit_exceeded, or nothing.

    Outstanding events are taken from running counts of ``after_counts``.
    """
    bounds = safe.join(horizons, "stream", "left").select("stream", "safe_seq", F.coalesce("pruned_through_seq", F.lit(0)).alias("pruned"))
    r = requests.join(bounds, "stream", "left")
    safe_events = events.join(safe, "stream").where("seq <= safe_seq").select("stream", "seq", F.lit(None).cast("timestamp").alias("occurred_at"))
    seen = after_counts(safe_events, requests).select("stream", "after_seq", "outstanding")
    out = r.join(seen, ["stream", "after_seq"], "left").withColumn("outstanding", F.coalesce("outstanding", F.lit(0)))
    advice = F.when(F.col("after_seq") < F.col("pruned"), "pruned_horizon").when(F.col("after_seq") > F.col("safe_seq"), "future_sequence").when(F.col("outstanding") > limit, "replay_limit_exceeded").otherwise("ok")
    return out.select("consumer", "stream", "after_seq", "outstanding", advice.alias("advisory"))


def prune_events(events: DataFrame, cutoff: str, safe: DataFrame, horizons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is kept, and the horizons: events older than the cutoff and below the watermark go."""
    e = events.join(F.broadcast(safe), "stream", "left")
    old = F.coalesce((F.col("occurred_at") < F.lit(cutoff).cast("timestamp_ntz")) & (F.col("seq") <= F.col("safe_seq")), F.lit(False))
    gone = e.where(old).groupBy("stream").agg(F.max("seq").alias("gone"))
    new = horizons.join(gone, "stream", "full").select("stream", F.greatest("pruned_through_seq", "gone").alias("pruned_through_seq"))
    return e.where(~old).select(*events.columns), new


def audit_delivery(applied: DataFrame, events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Per consumer and stream: applied, distinct, expected, cursor; exactly_once if they agree."""
    a = applied.groupBy("consumer", "stream").agg(F.count(F.lit(1)).alias("applied"), F.count_distinct("seq").alias("distinct"), F.max("seq").alias("top"))
    e = events.groupBy("stream").agg(F.count(F.lit(1)).alias("expected"), F.max("seq").alias("last"))
    out = a.join(e, "stream").join(cursors, ["consumer", "stream"], "left")
    good = (F.col("applied") == F.col("distinct")) & (F.col("distinct") == F.col("expected")) & (F.col("cursor_seq") == F.col("last"))
    return out.select("consumer", "stream", "applied", "distinct", "expected", "cursor_seq", F.coalesce(good, F.lit(False)).alias("exactly_once"))


def project(snapshot: DataFrame, deltas: DataFrame) -> DataFrame:
    """A consumer's copy (entity_key, value): the snapshot at its sequence with later deltas, the last of each key; deleted keys are absent."""
    every = snapshot.select("entity_key", "value", F.lit(-1).cast("long").alias("seq"), F.lit(False).alias("deleted")).unionByName(deltas.select("entity_key", "value", "seq", "deleted"))
    last = every.groupBy("entity_key").agg(F.max_by(F.struct("value", "deleted"), "seq").alias("r"))
    return last.where("not r.deleted").select("entity_key", "r.value")
