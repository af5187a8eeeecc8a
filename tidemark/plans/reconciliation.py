"""Queries on sweeps, gaps and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fx, run_sql
from ..operators import reconcile as r
from .registry import query, us

SHOWN = "SELECT *, CASE WHEN number % 3 > 0 THEN last_checked_at + INTERVAL 900 DAY END AS display_until FROM fx_pulls"


@query("h1_stale", f"SELECT 'open' AS kind, repo_id, number FROM fx_pulls WHERE tombstoned_at IS NULL AND state = 'open' AND last_checked_at < TIMESTAMP '1998-01-01 00:00:00' UNION ALL SELECT 'closed', repo_id, number FROM ({SHOWN}) WHERE tombstoned_at IS NULL AND state <> 'open' AND last_checked_at < TIMESTAMP '1998-01-01 00:00:00' AND display_until > TIMESTAMP '1999-06-01 00:00:00'")
def _(spark, sf):
    p = run_sql(spark, sf, SHOWN)
    cut, now = "1998-01-01 00:00:00", "1999-06-01 00:00:00"
    a, b = r.stale(p, cut), r.stale(p, cut, now, displayed=True)
    return a.select(F.lit("open").alias("kind"), "repo_id", "number").unionByName(b.select(F.lit("closed").alias("kind"), "repo_id", "number"))


BOUNDS = "SELECT s_suppkey AS id, CAST(900 * (1 + s_suppkey % 8) AS DOUBLE) AS bound_s, TIMESTAMP '2001-12-01 00:00:00' AS now FROM supplier"


@query("h2_schedule_plan", f"SELECT id, bound_s * 3 / 4 AS cadence_s, bound_s / 5 AS headroom_s, epoch_us(now) - CAST(bound_s * 750000 AS BIGINT) AS due_before_us FROM ({BOUNDS})")
def _(spark, sf):
    return r.schedule_plan(run_sql(spark, sf, BOUNDS)).select("id", "cadence_s", "headroom_s", "due_before_us")


SPREAD = "SELECT repo_id, number, CAST(1000000 AS BIGINT) AS now_us, CAST(7000000 AS BIGINT) AS cadence_us, CAST(1000000 + number % 9000000 AS BIGINT) AS deadline_us, CAST(500000 AS BIGINT) AS headroom_us FROM fx_pulls"


@query("h3_spread", f"WITH s AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY number) - 1 AS i, count(*) OVER (PARTITION BY repo_id) AS n FROM ({SPREAD})) SELECT repo_id, number, greatest(now_us, least(now_us + CASE WHEN n > 1 THEN CAST(floor(cadence_us * i / (n - 1)) AS BIGINT) ELSE 0 END, deadline_us - headroom_us)) AS at_us FROM s")
def _(spark, sf):
    return r.spread(run_sql(spark, sf, SPREAD), ["repo_id"], ["number"]).select("repo_id", "number", "at_us")


@query("h4_missing_keys", "SELECT repo_id, number FROM fx_pulls WHERE tombstoned_at IS NULL AND number % 6 = 1")
def _(spark, sf):
    p = fx(spark, sf, "pulls")
    return r.missing_keys(p, p.where("number % 6 <> 1").select("repo_id", "number"), ["repo_id", "number"])


@query("h5_accumulate_seen", "SELECT count(*) AS seen, count(*) FILTER (WHERE number % 4 = 1 AND number % 3 <> 1) AS added FROM fx_pulls WHERE number % 3 = 1 OR number % 4 = 1")
def _(spark, sf):
    p = fx(spark, sf, "pulls").select("repo_id", "number")
    page = p.where("number % 4 = 1")
    seen, new = r.accumulate_seen(p.where("number % 3 = 1"), page.unionByName(page), ["repo_id", "number"])
    return seen.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1))).agg(F.count_if(F.col("new") == 0).alias("seen"), F.sum("new").alias("added"))


@query("h6_reap_scopes", "SELECT 'acme/' || lower(n_name) || CASE WHEN n_nationkey % 4 = 0 THEN 'x' ELSE '' END AS scope FROM nation WHERE n_nationkey % 4 = 0 OR n_nationkey % 7 = 6")
def _(spark, sf):
    cursors = run_sql(spark, sf, "SELECT 'acme/' || lower(n_name) || CASE WHEN n_nationkey % 4 = 0 THEN 'x' ELSE '' END AS scope FROM nation")
    return r.reap_scopes(cursors, fx(spark, sf, "repos")).select("scope")


@query("h7_delivery_gaps", "WITH l AS (SELECT DISTINCT delivery_guid FROM fx_deliveries WHERE received_at >= TIMESTAMP '2024-01-05 00:00:00') SELECT delivery_guid FROM l WHERE NOT EXISTS (SELECT 1 FROM fx_deliveries g WHERE g.delivery_guid = l.delivery_guid AND g.arrival % 37 <> 0)")
def _(spark, sf):
    df = fx(spark, sf, "deliveries")
    return r.delivery_gaps(df.withColumnRenamed("received_at", "delivered_at"), df.where("arrival % 37 <> 0"), "2024-01-05 00:00:00")


LISTED = "SELECT CAST(floor((SELECT max(arrival) FROM fx_deliveries) / 100) AS BIGINT) - CAST(floor(arrival / 100) AS BIGINT) AS page, arrival AS delivery_id, received_at AS delivered_at FROM fx_deliveries"


@query("h8_gap_pass_extent", f"WITH p AS (SELECT page, max(delivered_at) AS newest, bool_or(delivery_id = 450) AS b FROM ({LISTED}) GROUP BY page) SELECT min(page) FILTER (WHERE b) AS boundary_page, min(page) FILTER (WHERE newest < TIMESTAMP '2024-01-15 00:00:00') AS deep_page, coalesce(min(page) FILTER (WHERE b), min(page) FILTER (WHERE newest < TIMESTAMP '2024-01-15 00:00:00'), max(page)) AS stop_page, epoch_us(max(newest)) AS high_us FROM p")
def _(spark, sf):
    out = r.gap_pass_extent(run_sql(spark, sf, LISTED), 450, "2024-01-15 00:00:00")
    return out.select("boundary_page", "deep_page", "stop_page", us("high_watermark").alias("high_us"))


JOBS = "SELECT kind, refresh_key, generation * 10 AS job_id, CASE WHEN generation % 3 = 0 THEN 'running' WHEN generation % 3 = 1 THEN 'discarded' ELSE 'completed' END AS state FROM fx_generations WHERE generation % 5 > 0"


@query("h9_orphans", f"SELECT g.refresh_key, j.state AS last_state FROM fx_generations g LEFT JOIN ({JOBS}) j ON j.refresh_key = g.refresh_key WHERE g.completed_generation < g.generation AND g.updated_at < TIMESTAMP '2024-01-28 00:00:00' AND coalesce(j.state, '') <> 'running'")
def _(spark, sf):
    return r.orphans(fx(spark, sf, "generations"), run_sql(spark, sf, JOBS), "2024-01-28 00:00:00").select("refresh_key", "last_state")


TRIED = "SELECT kind, refresh_key, generation * 10 AS job_id, 'discarded' AS state FROM fx_generations WHERE generation % 5 > 0 UNION ALL SELECT kind, refresh_key, generation * 10 + 1, CASE WHEN generation % 4 = 0 THEN 'running' WHEN generation % 2 = 0 THEN 'cancelled' ELSE 'completed' END FROM fx_generations WHERE generation % 3 > 0"


@query("h9_orphan_states", f"SELECT g.refresh_key, j.last_state FROM fx_generations g LEFT JOIN (SELECT kind, refresh_key, arg_max(state, job_id) AS last_state, bool_or(state = 'running') AS runs FROM ({TRIED}) GROUP BY kind, refresh_key) j ON j.kind = g.kind AND j.refresh_key = g.refresh_key WHERE g.completed_generation < g.generation AND g.updated_at < TIMESTAMP '2024-02-01 00:00:00' AND NOT coalesce(j.runs, FALSE)")
def _(spark, sf):
    return r.orphans(fx(spark, sf, "generations"), run_sql(spark, sf, TRIED), "2024-02-01 00:00:00").select("refresh_key", "last_state")


CHILDREN = "SELECT repo_id, number AS child_key, 3 AS generation, CASE WHEN number % 11 = 0 THEN NULL WHEN number % 7 = 0 THEN 2 ELSE 3 END AS completed_generation FROM fx_pulls WHERE repo_id % 3 > 0 OR number % 11 > 0 AND number % 7 > 0"


@query("h10_backfill_status", f"SELECT repo_id, count(*) AS children, count(*) FILTER (WHERE coalesce(completed_generation < generation, TRUE)) AS pending, bool_and(coalesce(completed_generation >= generation, FALSE)) AS settled FROM ({CHILDREN}) GROUP BY repo_id")
def _(spark, sf):
    return r.backfill_status(run_sql(spark, sf, CHILDREN))


BODIES = "SELECT arrival, status, received_at, 'body' AS body, CASE WHEN arrival % 100 = 0 THEN received_at END AS payload_pruned_at FROM fx_deliveries"


@query("h11_prune_payloads", f"SELECT arrival, CASE WHEN status = 'processed' AND received_at < TIMESTAMP '2024-01-12 00:00:00' AND payload_pruned_at IS NULL THEN NULL ELSE body END AS body, payload_pruned_at IS NOT NULL OR (status = 'processed' AND received_at < TIMESTAMP '2024-01-12 00:00:00') AS pruned FROM ({BODIES})")
def _(spark, sf):
    out = r.prune_payloads(run_sql(spark, sf, BODIES), "2024-01-12 00:00:00", "2024-02-01 00:00:00")
    return out.select("arrival", "body", F.col("payload_pruned_at").isNotNull().alias("pruned"))


@query("h12_prune_rows", "SELECT gh_id, tie FROM fx_check_observations WHERE gh_updated_at IS NULL OR gh_updated_at >= TIMESTAMP '1996-01-01 00:00:00'")
def _(spark, sf):
    return r.prune_rows(fx(spark, sf, "check_observations"), "gh_updated_at", "1996-01-01 00:00:00").select("gh_id", "tie")
