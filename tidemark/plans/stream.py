"""Queries on the change stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fx, run_sql
from ..operators import changes as c
from .registry import query

HORIZON = "SELECT 'entities' AS stream, 2000 AS pruned_through_seq UNION ALL SELECT 'work_items', 500"
SAFE = "SELECT stream, coalesce(min(CASE WHEN NOT committed THEN seq END) - 1, max(seq)) AS safe_seq FROM fx_change_events GROUP BY stream"


@query("g1_safe_seq", SAFE)
def _(spark, sf):
    return c.safe_seq(fx(spark, sf, "change_events"))


@query("g2_tail", "SELECT seq, kind, entity_key FROM fx_change_events WHERE stream = 'entities' AND seq > 100 AND seq <= 5000 ORDER BY seq LIMIT 200")
def _(spark, sf):
    return c.tail(fx(spark, sf, "change_events"), "entities", 100, 5000, 200).select("seq", "kind", "entity_key")


@query("g3_advance_cursor", "WITH d AS (SELECT c.consumer, c.stream, max(e.seq) AS last FROM fx_consumers c JOIN fx_change_events e ON e.stream = c.stream AND e.seq > c.cursor_seq AND e.seq <= c.cursor_seq + 300 GROUP BY c.consumer, c.stream) SELECT c.consumer, c.stream, greatest(c.cursor_seq, coalesce(d.last, 0)) AS cursor_seq FROM fx_consumers c LEFT JOIN d ON d.consumer = c.consumer AND d.stream = c.stream")
def _(spark, sf):
    cursors = fx(spark, sf, "consumers")
    e = fx(spark, sf, "change_events").select("stream", "seq")
    delivered = c.delivered_within(cursors, e, 300)
    return c.advance_cursor(cursors, delivered.unionByName(delivered))


@query("g4_resync", f"SELECT consumer, c.stream, cursor_seq < pruned_through_seq AS resync FROM fx_consumers c JOIN ({HORIZON}) h ON h.stream = c.stream")
def _(spark, sf):
    return c.resync_needed(fx(spark, sf, "consumers"), run_sql(spark, sf, HORIZON)).select("consumer", "stream", "resync")


def _snapshot(spark, sf):
    pulls = run_sql(spark, sf, "SELECT 'pr:1:' || CAST(1000 + repo_id AS STRING) || ':' || CAST(number AS STRING) AS entity_key, number, tombstoned_at FROM fx_pulls")
    repos = run_sql(spark, sf, "SELECT 'repo:1:' || CAST(gh_id AS STRING) AS entity_key, repo_id AS number, tombstoned_at FROM fx_repos")
    return c.bootstrap({"pull_request": pulls, "repository": repos})


@query("g5_bootstrap", "SELECT 'pull_request' AS kind, 'pr:1:' || CAST(1000 + repo_id AS STRING) || ':' || CAST(number AS STRING) AS entity_key, '{\"number\":' || CAST(number AS STRING) || '}' AS document FROM fx_pulls WHERE tombstoned_at IS NULL UNION ALL SELECT 'repository', 'repo:1:' || CAST(gh_id AS STRING), '{\"number\":' || CAST(repo_id AS STRING) || '}' FROM fx_repos WHERE tombstoned_at IS NULL")
def _(spark, sf):
    return _snapshot(spark, sf)


@query("g6_snapshot_size", "WITH d AS (SELECT '{\"number\":' || CAST(number AS STRING) || '}' AS d FROM fx_pulls WHERE tombstoned_at IS NULL UNION ALL SELECT '{\"number\":' || CAST(repo_id AS STRING) || '}' FROM fx_repos WHERE tombstoned_at IS NULL) SELECT count(*) AS entities, CAST(sum(length(d)) AS BIGINT) AS bytes, count(*) > 1000 OR sum(length(d)) > 1000000 AS too_large FROM d")
def _(spark, sf):
    return c.snapshot_size(_snapshot(spark, sf), 1000, 1_000_000)


REFS = "SELECT seq, kind, 'pr:1:' || CAST(1000 + CAST(floor((seq % 3000) / 5) AS BIGINT) % 25 AS STRING) || ':' || CAST(seq % 3000 + 1 AS STRING) AS entity_key FROM fx_change_events"
PULL_KEYS = "SELECT 'pr:1:' || CAST(1000 + repo_id AS STRING) || ':' || CAST(number AS STRING) AS entity_key, title, tombstoned_at FROM fx_pulls"


@query("g7_materialize", f"SELECT r.seq, r.entity_key, p.title, CASE WHEN p.entity_key IS NULL THEN 'tombstone' ELSE 'upsert' END AS op FROM ({REFS}) r LEFT JOIN (SELECT * FROM ({PULL_KEYS}) WHERE tombstoned_at IS NULL) p ON p.entity_key = r.entity_key WHERE r.kind IN ('pull_request.changed', 'pull_request.tombstoned')")
def _(spark, sf):
    out = c.materialize(run_sql(spark, sf, REFS), run_sql(spark, sf, PULL_KEYS), ["pull_request.changed", "pull_request.tombstoned"])
    return out.select("seq", "entity_key", "title", "op")


@query("g8_replay_advisory", f"WITH s AS ({SAFE}), h AS ({HORIZON}), r AS (SELECT consumer, c.stream, cursor_seq AS after_seq, safe_seq, pruned_through_seq AS pruned, (SELECT count(*) FROM fx_change_events e WHERE e.stream = c.stream AND e.seq > cursor_seq AND e.seq <= safe_seq) AS outstanding FROM fx_consumers c JOIN s ON s.stream = c.stream JOIN h ON h.stream = c.stream) SELECT consumer, stream, after_seq, outstanding, CASE WHEN after_seq < pruned THEN 'pruned_horizon' WHEN after_seq > safe_seq THEN 'future_sequence' WHEN outstanding > 1000 THEN 'replay_limit_exceeded' ELSE 'ok' END AS advisory FROM r")
def _(spark, sf):
    e = fx(spark, sf, "change_events")
    return c.replay_advisory(fx(spark, sf, "consumers").withColumnRenamed("cursor_seq", "after_seq"), e, run_sql(spark, sf, HORIZON), c.safe_seq(e), 1000)


PRUNED = f"SELECT e.stream, max(e.seq) AS gone FROM fx_change_events e JOIN ({SAFE}) s ON s.stream = e.stream WHERE occurred_at < TIMESTAMP '2024-01-10 00:00:00' AND seq <= safe_seq GROUP BY e.stream"


@query("g9_prune_events", f"SELECT h.stream, greatest(pruned_through_seq, coalesce(gone, 0)) AS pruned_through_seq, (SELECT count(*) FROM fx_change_events e JOIN ({SAFE}) s ON s.stream = e.stream WHERE e.stream = h.stream AND NOT (occurred_at < TIMESTAMP '2024-01-10 00:00:00' AND seq <= safe_seq)) AS kept FROM ({HORIZON}) h LEFT JOIN ({PRUNED}) p ON p.stream = h.stream")
def _(spark, sf):
    e = fx(spark, sf, "change_events")
    kept, horizons = c.prune_events(e, "2024-01-10 00:00:00", c.safe_seq(e), run_sql(spark, sf, HORIZON))
    return horizons.join(kept.groupBy("stream").agg(F.count(F.lit(1)).alias("kept")), "stream", "left").select("stream", "pruned_through_seq", "kept")


@query("g10_audit_delivery", "WITH x AS (SELECT stream, count(*) AS n, max(seq) AS last FROM fx_change_events GROUP BY stream), l AS (SELECT stream, count(*) AS n FROM fx_change_events WHERE seq % 1000 = 1 GROUP BY stream) SELECT consumer, c.stream, CAST(CASE CAST(cursor_seq AS BIGINT) % 4 WHEN 0 THEN x.n ELSE x.n + coalesce(l.n, 0) END AS BIGINT) AS applied, x.n AS distinct, x.n AS expected, CAST(cursor_seq AS BIGINT) % 4 = 0 AS exactly_once FROM fx_consumers c JOIN x ON x.stream = c.stream LEFT JOIN l ON l.stream = c.stream WHERE cursor_seq <= 900".replace("AS distinct", 'AS "distinct"'))
def _(spark, sf):
    some = fx(spark, sf, "consumers").where("cursor_seq <= 900")
    e = fx(spark, sf, "change_events").select("stream", "seq")
    once = some.join(e, "stream").select("consumer", "stream", "seq", "cursor_seq")
    applied = once.unionByName(once.where("seq % 1000 = 1 and cursor_seq % 4 <> 0"))
    last = e.groupBy("stream").agg(F.max("seq").alias("cursor_seq"))
    cursors = some.drop("cursor_seq").join(last, "stream")
    return c.audit_delivery(applied, e, cursors).drop("cursor_seq")


@query("g11_project", "WITH d AS (SELECT entity_key, seq, kind LIKE '%tombstoned' AS deleted FROM fx_change_events), l AS (SELECT entity_key, arg_max(seq, seq) AS seq, arg_max(deleted, seq) AS deleted FROM d GROUP BY entity_key) SELECT entity_key, 'v' || CAST(seq AS STRING) AS value FROM l WHERE NOT deleted UNION ALL SELECT 'pr:1:1:' || CAST(s_suppkey AS STRING), 'snap' FROM supplier")
def _(spark, sf):
    deltas = fx(spark, sf, "change_events").select("entity_key", F.concat(F.lit("v"), F.col("seq").cast("string")).alias("value"), "seq", F.col("kind").endswith("tombstoned").alias("deleted"))
    snapshot = run_sql(spark, sf, "SELECT 'pr:1:1:' || CAST(s_suppkey AS STRING) AS entity_key, 'snap' AS value FROM supplier")
    return c.project(snapshot, deltas.unionByName(deltas.where("seq % 7 = 0")))
