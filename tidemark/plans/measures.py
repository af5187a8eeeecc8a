"""Queries on measures and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import NOW, PULL_NOW, fx, run_sql
from ..functions.scalars import count_label
from ..operators import alerts, changes
from ..operators import metrics as m
from .registry import query, us

D, P = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{PULL_NOW}'"
SAFE = "SELECT stream, coalesce(min(CASE WHEN NOT committed THEN seq END) - 1, max(seq)) AS safe_seq FROM fx_change_events GROUP BY stream"


def age(t: str, x: str) -> str:
    return f"(epoch_us({t}) - epoch_us({x})) / 1000000.0"


@query("j1_delivery_metrics", f"SELECT (SELECT {age(D, 'min(received_at)')} FROM fx_deliveries WHERE status IN ('pending', 'processing')) AS oldest_unprocessed_s, (SELECT count(*) FROM fx_deliveries WHERE status = 'parked') AS parked, (SELECT {age(D, 'min(received_at)')} FROM fx_deliveries WHERE status = 'parked') AS oldest_parked_s, count(*) AS outstanding, {age(D, 'min(event_received_at)')} AS oldest_outstanding_s FROM fx_generations WHERE completed_generation < generation")
def _(spark, sf):
    return m.delivery_metrics(fx(spark, sf, "deliveries"), fx(spark, sf, "generations"), NOW)


CLASSES = {"pulls": "SELECT last_checked_at, tombstoned_at FROM fx_pulls", "open": "SELECT last_checked_at, tombstoned_at FROM fx_pulls WHERE state = 'open'", "none": "SELECT last_checked_at, tombstoned_at FROM fx_pulls WHERE number < 0"}
STALENESS = " UNION ALL ".join(f"SELECT '{k}' AS entity_class, coalesce(max({age(P, 'last_checked_at')}), 0) AS staleness_s FROM ({s}) WHERE tombstoned_at IS NULL" for k, s in CLASSES.items())


def _staleness(spark, sf):
    return m.staleness({k: run_sql(spark, sf, s) for k, s in CLASSES.items()}, PULL_NOW)


@query("j2_staleness", STALENESS)
def _(spark, sf):
    return _staleness(spark, sf)


@query("j3_staleness_breaches", f"SELECT entity_class, staleness_s, CAST(600 AS DOUBLE) AS bound_s FROM ({STALENESS}) WHERE entity_class = 'pulls' AND staleness_s > 600")
def _(spark, sf):
    bounds = spark.createDataFrame([("pulls", 600.0), ("pulls", 900.0), ("pulls", 0.0), ("none", 10.0)], "entity_class string, bound_s double")
    return m.staleness_breaches(_staleness(spark, sf), bounds)


@query("j4_tombstones", "SELECT 'pulls' AS kind, count(tombstoned_at) AS tombstones FROM fx_pulls UNION ALL SELECT 'repos', count(tombstoned_at) FROM fx_repos")
def _(spark, sf):
    return m.tombstones({"pulls": fx(spark, sf, "pulls"), "repos": fx(spark, sf, "repos")})


PASSES = "SELECT o_orderpriority AS kind, o_orderdate AS started_at, CASE WHEN o_orderkey % 50 > 0 OR o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN o_orderdate + INTERVAL 3 HOUR END AS finished_at FROM orders"


@query("j5_sweep_durations", f"SELECT kind, max(greatest({age(f'coalesce(finished_at, {P})', 'started_at')}, 0)) AS duration_s FROM ({PASSES}) GROUP BY kind")
def _(spark, sf):
    return m.sweep_durations(run_sql(spark, sf, PASSES), PULL_NOW)


FINDINGS = "SELECT CASE number % 3 WHEN 0 THEN 'stack' WHEN 1 THEN 'checks' ELSE 'pull_request' END AS entity_kind, number, repo_id, CASE WHEN number % 5 > 0 THEN gh_updated_at END AS resolved_at FROM fx_pulls"


@query("j6_drift_counts", f"WITH f AS (SELECT entity_kind, CASE WHEN resolved_at IS NULL THEN 'open' ELSE 'resolved' END AS state FROM ({FINDINGS})) SELECT state, entity_kind, count(*) AS n FROM f GROUP BY state, entity_kind UNION ALL SELECT state, 'all', count(*) FROM f GROUP BY state")
def _(spark, sf):
    return m.drift_counts(run_sql(spark, sf, FINDINGS))


STREAMS = f"SELECT e.stream, count(*) FILTER (WHERE seq > safe_seq) AS lag, count(*) FILTER (WHERE occurred_at < TIMESTAMP '2024-01-10 00:00:00' AND seq <= safe_seq) AS prunable FROM fx_change_events e JOIN ({SAFE}) s ON s.stream = e.stream GROUP BY e.stream"


@query("j7_stream_metrics", f"WITH t AS ({STREAMS}) SELECT stream, lag, prunable FROM t UNION ALL SELECT 'all', CAST(sum(lag) AS BIGINT), CAST(sum(prunable) AS BIGINT) FROM t")
def _(spark, sf):
    e = fx(spark, sf, "change_events")
    return m.stream_metrics(e, changes.safe_seq(e), "2024-01-10 00:00:00")


@query("j8_consumer_lag", f"SELECT c.consumer, c.stream, count(e.seq) AS outstanding, coalesce({age(D, 'min(e.occurred_at)')}, 0) AS oldest_s FROM fx_consumers c LEFT JOIN (SELECT x.stream, seq, occurred_at FROM fx_change_events x JOIN ({SAFE}) s ON s.stream = x.stream WHERE seq <= safe_seq) e ON e.stream = c.stream AND e.seq > c.cursor_seq GROUP BY c.consumer, c.stream")
def _(spark, sf):
    e = fx(spark, sf, "change_events")
    return m.consumer_lag(fx(spark, sf, "consumers"), e, changes.safe_seq(e), NOW)


QUEUED = "SELECT CASE user_id % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'sweep' ELSE 'drift' END AS queue, CASE event_id % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'retryable' END AS state FROM events"


@query("j9_backlogs", f"SELECT 'queue:' || queue AS backlog, count(*) AS n FROM ({QUEUED}) WHERE state IN ('available', 'retryable') GROUP BY queue UNION ALL SELECT 'dirty', count(*) FROM fx_pulls")
def _(spark, sf):
    return m.backlogs(fx(spark, sf, "pulls"), run_sql(spark, sf, QUEUED))


BEATS = "SELECT event_type AS component, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS operation, ts AS succeeded_at, event_id % 3 AS successes FROM events"


@query("j10_heartbeats", f"SELECT v.component, v.operation, coalesce({age(D, 'max(succeeded_at)')}, -1) AS age_s, CAST(coalesce(sum(successes), 0) AS BIGINT) AS successes FROM (VALUES ('view', 'a'), ('click', 'b'), ('nobody', 'a')) v(component, operation) LEFT JOIN ({BEATS}) b ON b.component = v.component AND b.operation = v.operation GROUP BY v.component, v.operation")
def _(spark, sf):
    expected = spark.createDataFrame([("view", "a"), ("click", "b"), ("nobody", "a")], "component string, operation string")
    return m.heartbeats(expected, run_sql(spark, sf, BEATS), NOW)


BUDGETS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 > 0 THEN o_custkey END AS remaining, CASE WHEN o_orderkey % 7 > 0 THEN 5000 END AS limit_n, 10 AS cost, o_orderkey % 100 AS waited_s, 60 AS max_wait_s FROM orders"


@query("j11_budget_audit", f"SELECT id, coalesce(remaining, -1) AS remaining, coalesce(limit_n, -1) AS limit_n, coalesce(remaining - cost < 1000 AND limit_n IS NOT NULL, FALSE) AS gate_closed, waited_s > max_wait_s AS starved FROM ({BUDGETS})")
def _(spark, sf):
    return m.budget_audit(run_sql(spark, sf, BUDGETS)).select("id", "remaining", "limit_n", "gate_closed", "starved")


LAT = "SELECT arrival, received_at, CASE WHEN arrival % 43 = 0 THEN received_at - INTERVAL 1 SECOND ELSE received_at + CAST(number % 70 AS INT) * INTERVAL 1 SECOND END AS committed_at, CASE WHEN arrival % 11 = 0 THEN 'superseded' ELSE 'committed' END AS outcome FROM fx_deliveries"


@query("j12_latency", f"SELECT arrival, CASE WHEN committed_at >= received_at THEN {age('committed_at', 'received_at')} END AS latency_s, committed_at < received_at AS invalid FROM ({LAT}) WHERE outcome = 'committed'")
def _(spark, sf):
    return m.latency(run_sql(spark, sf, LAT)).select("arrival", "latency_s", "invalid")


BOUNDS = [1, 5, 10, 20, 30, 60]
HIST = f"WITH l AS (SELECT {age('committed_at', 'received_at')} AS s FROM ({LAT}) WHERE outcome = 'committed' AND committed_at >= received_at) SELECT CAST(b AS DOUBLE) AS le, (SELECT count(*) FROM l WHERE s <= b) AS n FROM (VALUES {', '.join(f'({b}.0)' for b in BOUNDS)}, (100000.0)) v(b)"


def _hist(spark, sf, where="true"):
    return m.histogram(m.latency(run_sql(spark, sf, LAT)).where(where), "latency_s", BOUNDS)


@query("j13_histogram", HIST)
def _(spark, sf):
    return _hist(spark, sf).withColumn("le", F.when(F.col("le") == float("inf"), 100000.0).otherwise(F.col("le")))


@query("j14_hist_quantile", f"WITH h AS ({HIST}), t AS (SELECT max(n) AS total FROM h) SELECT CAST(q AS DOUBLE) AS q, min(le) AS value FROM (VALUES (0.5), (0.9), (0.95)) v(q), t, h WHERE n >= ceil(total * q) GROUP BY q")
def _(spark, sf):
    whole = m.hist_merge(_hist(spark, sf, "arrival % 2 = 0"), m.hist_delta(_hist(spark, sf, "arrival % 2 = 0"), _hist(spark, sf)))
    out = m.hist_quantile(whole, [0.5, 0.9, 0.95])
    return out.withColumn("value", F.when(F.col("value") == float("inf"), 100000.0).otherwise(F.col("value")))


@query("j15_slo_check", f"WITH l AS (SELECT {age('committed_at', 'received_at')} AS s FROM ({LAT}) WHERE outcome = 'committed' AND committed_at >= received_at) SELECT CAST(q AS DOUBLE) AS q, CASE WHEN q < 0.96 THEN quantile_cont(s, 0.95) ELSE quantile_cont(s, 0.99) END AS value_s, CAST(b AS DOUBLE) AS bound_s, CASE WHEN q < 0.96 THEN quantile_cont(s, 0.95) ELSE quantile_cont(s, 0.99) END <= b AS met FROM l, (VALUES (0.95, 20.0), (0.99, 60.0)) v(q, b) GROUP BY q, b")
def _(spark, sf):
    return m.slo_check(m.latency(run_sql(spark, sf, LAT)), "latency_s", {0.95: 20.0, 0.99: 60.0})


REQUESTS = "SELECT CASE user_id % 2 WHEN 0 THEN 'app' ELSE 'installation' END AS auth_context, CASE event_type WHEN 'view' THEN '/repos/a/b/pulls/' || CAST(user_id AS STRING) || '/files?page=1' WHEN 'click' THEN '/repos/a/b/commits/abc/check-runs' WHEN 'error' THEN '/graphql' WHEN 'signup' THEN '/repos/a/b' ELSE '/user' END AS path, CASE event_id % 6 WHEN 0 THEN 304 WHEN 1 THEN 429 WHEN 2 THEN 404 WHEN 3 THEN 502 ELSE 200 END AS status, ts AS requested_at, event_id % 4 > 0 AS conditional, event_type FROM events"


@query("j16_attribute_requests", f"SELECT auth_context, CASE event_type WHEN 'view' THEN 'pull_files' WHEN 'click' THEN 'checks' WHEN 'error' THEN 'graphql' WHEN 'signup' THEN 'repository' ELSE 'other' END AS family, CASE status WHEN 304 THEN 'not_modified' WHEN 429 THEN 'limited' WHEN 404 THEN 'client_error' WHEN 502 THEN 'server_error' ELSE 'ok' END AS outcome, count(*) AS n FROM ({REQUESTS}) GROUP BY ALL")
def _(spark, sf):
    return m.attribute_requests(run_sql(spark, sf, REQUESTS))


@query("j17_hit_ratio", f"SELECT 'sweep' AS class, auth_context AS resource, epoch_us(time_bucket(INTERVAL 15 MINUTE, requested_at)) AS start_us, count(*) AS requests, count(*) FILTER (WHERE status = 304) / count(*) AS ratio FROM ({REQUESTS}) WHERE conditional GROUP BY ALL")
def _(spark, sf):
    df = run_sql(spark, sf, REQUESTS).select(F.lit("sweep").alias("class"), F.col("auth_context").alias("resource"), F.col("requested_at").alias("at"), "conditional", "status")
    return m.hit_ratio(df).withColumn("start_us", us("start")).drop("start")


@query("j18_reject_ratio", "SELECT event_type AS entity_kind, count(*) AS writes, avg(CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE 0.0 END) AS ratio FROM events GROUP BY event_type")
def _(spark, sf):
    return m.reject_ratio(run_sql(spark, sf, "SELECT event_type AS entity_kind, event_id % 7 = 0 AS rejected FROM events"))


@query("j19_count_label", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 40 = 0 THEN '0' WHEN o_orderkey % 40 <= 5 THEN '1_5' WHEN o_orderkey % 40 <= 25 THEN '6_25' ELSE '26_plus' END AS label FROM orders")
def _(spark, sf):
    return run_sql(spark, sf, "SELECT o_orderkey AS id, o_orderkey % 40 AS n FROM orders").select("id", count_label(F.col("n")).alias("label"))




@query("j20_evaluate_alerts", "WITH s AS (SELECT DISTINCT epoch_us(ts) // 3600000000 AS slot FROM events), h AS (SELECT slot, slot - row_number() OVER (ORDER BY slot) AS island FROM s WHERE slot % 12 < 5), r AS (SELECT min(slot) AS a, max(slot) AS b FROM h GROUP BY island) SELECT 'backlog' AS rule, (a + 2) * 3600000000 AS from_us, b * 3600000000 AS to_us FROM r WHERE b - a >= 2")
def _(spark, sf):
    hours = run_sql(spark, sf, "SELECT ts AS at FROM events")
    slot = F.floor(us("at") / 3_600_000_000)
    samples = hours.select("at", F.lit("depth").alias("name"), F.create_map(F.lit("queue"), F.lit("event")).alias("labels"), F.when(slot % 12 < 5, 2000.0).otherwise(1.0).alias("value"))
    rules = [("backlog", 120, "warning", [{"metric": "depth", "labels": {"queue": "event"}, "op": ">", "value": 1000}])]
    return alerts.evaluate_alerts(samples, rules, 3600).select("rule", "from_us", "to_us")


@query("j21_trust_verdict", f"WITH c AS (SELECT 'correctness' AS aspect, count(*) FILTER (WHERE resolved_at IS NULL) = 0 AS good FROM ({FINDINGS}) UNION ALL SELECT 'staleness', max(staleness_s) < 1e12 FROM ({STALENESS}) UNION ALL SELECT 'stream', CAST(sum(lag) AS BIGINT) = 0 FROM ({STREAMS})) SELECT string_agg(aspect, ',' ORDER BY aspect) FILTER (WHERE NOT good) AS failing, bool_and(good) AS trusted FROM c")
def _(spark, sf):
    e = fx(spark, sf, "change_events")
    a = run_sql(spark, sf, FINDINGS).agg(F.lit("correctness").alias("aspect"), (F.count_if(F.col("resolved_at").isNull()) == 0).alias("good"))
    b = _staleness(spark, sf).agg(F.lit("staleness").alias("aspect"), (F.max("staleness_s") < 1e12).alias("good"))
    s = m.stream_metrics(e, changes.safe_seq(e), "2024-01-10 00:00:00").where("stream = 'all'").select(F.lit("stream").alias("aspect"), (F.col("lag") == 0).alias("good"))
    return m.trust_verdict(a.unionByName(b).unionByName(s))


DROPPED = "SELECT DISTINCT delivery_guid, received_at - INTERVAL 1 MINUTE * CAST(arrival % 3 AS INT) AS dropped_at FROM fx_deliveries WHERE arrival % 13 = 0 AND arrival % 10 <> 9"


@query("j22_heal_audit", f"SELECT d.delivery_guid, CASE WHEN f.delivery_guid IS NULL THEN 'not healed' WHEN f.status <> 'processed' THEN 'not processed' WHEN {age('f.received_at', 'd.dropped_at')} > 90 THEN 'late' ELSE 'healed' END AS verdict FROM ({DROPPED}) d LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delivery_guid ORDER BY received_at, arrival) AS k FROM fx_deliveries WHERE arrival % 37 <> 0) WHERE k = 1) f ON f.delivery_guid = d.delivery_guid")
def _(spark, sf):
    return m.heal_audit(run_sql(spark, sf, DROPPED), fx(spark, sf, "deliveries").where("arrival % 37 <> 0"), 90)


@query("j23_run_status", "WITH g AS (SELECT DISTINCT delivery_guid FROM fx_deliveries), l AS (SELECT delivery_guid, max(CASE WHEN status = 'processed' THEN 1 ELSE 0 END) AS done FROM fx_deliveries WHERE arrival % 37 <> 0 GROUP BY delivery_guid) SELECT count(*) AS total, count(done) AS arrived, CAST(coalesce(sum(done), 0) AS BIGINT) AS processed, (SELECT count(*) FROM fx_generations WHERE completed_generation < generation) AS outstanding, FALSE AS drained FROM g LEFT JOIN l ON l.delivery_guid = g.delivery_guid")
def _(spark, sf):
    df = fx(spark, sf, "deliveries")
    return m.run_status(df.select("delivery_guid").distinct(), df.where("arrival % 37 <> 0"), fx(spark, sf, "generations"))
