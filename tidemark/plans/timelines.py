"""Queries on timelines and stacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fx, run_sql
from ..operators import timeline as t
from .registry import query, us

LINE = "SELECT ts AS at, CASE event_type WHEN 'view' THEN 'pull_request' WHEN 'click' THEN 'check_run' WHEN 'error' THEN 'push' WHEN 'signup' THEN 'review' ELSE 'commit' END AS kind, 'a' || CAST(event_id % 3 AS STRING) AS action, user_id AS number, 'k' || CAST(event_id AS STRING) AS stable_key FROM events"
RANK = "CASE kind WHEN 'commit' THEN 0 WHEN 'push' THEN 1 WHEN 'pull_request' THEN 2 WHEN 'review' THEN 4 ELSE 9 END"


@query("k1_normalize_timeline", f"SELECT stable_key, row_number() OVER (ORDER BY tt, {RANK}, kind, action, number, stable_key) AS seq, (epoch_us(tt) - epoch_us(min(tt) OVER ())) // 1000 AS at_ms FROM ({LINE.replace('ts AS at', 'ts AS tt')})")
def _(spark, sf):
    return t.normalize_timeline(run_sql(spark, sf, LINE)).select("stable_key", "seq", "at_ms")


@query("k2_dedupe_timeline", "SELECT count(*) AS n FROM (SELECT DISTINCT event_id - event_id % 2 AS k, user_id % 5 AS i FROM events)")
def _(spark, sf):
    df = run_sql(spark, sf, "SELECT CAST(event_id - event_id % 2 AS STRING) AS stable_key, user_id % 5 AS at FROM events")
    return t.dedupe_timeline(df).agg(F.count(F.lit(1)).alias("n"))


STEPS = "SELECT user_id % 25 AS repo_id, user_id AS number, ts AS {at}, event_id AS node, CASE WHEN event_type = 'purchase' THEN 'closed' WHEN event_type = 'signup' THEN 'open' END AS state, CASE WHEN event_type = 'view' THEN md5(CAST(event_id AS STRING)) END AS head_sha, CASE WHEN event_type = 'error' THEN 'b' || CAST(event_id % 7 AS STRING) END AS base_ref, CASE WHEN event_type = 'click' THEN 'approved' END AS decision FROM events"
PROBE = "SELECT user_id % 25 AS repo_id, user_id AS number, ts + INTERVAL 3 HOUR AS {at}, event_id AS probe_id FROM events"
S_SPARK, S_DUCK = STEPS.format(at="at"), STEPS.format(at="tt")


@query(
    "k3_pull_state_at",
    f"WITH s AS ({S_DUCK}), p AS ({PROBE.format(at='tt')}) SELECT p.probe_id, a.state, h.head_sha, b.base_ref, d.decision FROM p "
    + " ".join(f"ASOF LEFT JOIN (SELECT number, tt, arg_max({f}, node) AS {f} FROM s WHERE {f} IS NOT NULL GROUP BY ALL) {x} ON {x}.number = p.number AND p.tt >= {x}.tt" for x, f in (("a", "state"), ("h", "head_sha"), ("b", "base_ref"), ("d", "decision"))),
)
def _(spark, sf):
    return t.pull_state_at(run_sql(spark, sf, S_SPARK), run_sql(spark, sf, PROBE.format(at="at"))).select("probe_id", "state", "head_sha", "base_ref", "decision")


HISTORY = "SELECT user_id % 25 AS repo_id, user_id AS number, ts AS {at}, event_id AS node, CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'force_push' WHEN event_type = 'view' THEN 'commit' WHEN event_type = 'error' THEN 'base_changed' WHEN event_type = 'click' THEN 'review' WHEN event_type = 'signup' THEN 'dismissed' WHEN event_id % 3 = 0 THEN 'closed' WHEN event_id % 3 = 1 THEN 'merged' ELSE 'reopened' END AS kind, CASE WHEN event_type = 'view' THEN 's' || CAST(event_id AS STRING) END AS sha, CASE WHEN event_type = 'error' THEN 'b' || CAST(event_id % 3 AS STRING) END AS ref, CASE WHEN event_type = 'error' THEN 'b' || CAST(event_id % 7 AS STRING) END AS previous_ref, CASE WHEN event_type IN ('click', 'signup') THEN user_id * 3 + event_id % 3 END AS review_id, CASE WHEN event_type IN ('click', 'signup') THEN CASE event_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'changes_requested' WHEN 2 THEN 'commented' ELSE '' END END AS verdict FROM events"
ENDED = "SELECT DISTINCT user_id % 25 AS repo_id, user_id AS number, TIMESTAMP '2024-01-03 00:00:00' AS created_at, 'b' || CAST(user_id % 3 AS STRING) AS base_ref, 'end' || CAST(user_id AS STRING) AS base_sha FROM events"


def _asof(name: str, field: str, where: str) -> str:
    return f"ASOF LEFT JOIN (SELECT number, tt, arg_max({field}, node) AS v, TRUE AS hit FROM e WHERE {where} GROUP BY number, tt) {name} ON {name}.number = p.number AND p.tt >= {name}.tt"


@query(
    "k3_pull_history_at",
    f"""WITH t AS ({HISTORY.format(at="tt")}), x AS ({ENDED}), p AS ({PROBE.format(at="tt")}),
g AS (SELECT number, review_id, arg_min(verdict, (tt, node)) AS was FROM t WHERE kind = 'dismissed' GROUP BY ALL),
e AS (SELECT t.*, upper(coalesce(nullif(g.was, ''), t.verdict)) AS counted FROM t LEFT JOIN g ON g.number = t.number AND g.review_id = t.review_id),
f AS (SELECT number, arg_min(sha, (tt, node)) FILTER (WHERE kind = 'commit') AS head, arg_min(previous_ref, (tt, node)) FILTER (WHERE kind = 'base_changed') AS base FROM t GROUP BY number)
SELECT p.probe_id, CASE WHEN l.v IS NULL OR l.v = 'reopened' THEN 'open' ELSE 'closed' END AS state, m.hit IS NOT NULL AS merged, CASE WHEN l.v <> 'reopened' THEN epoch_us(l.tt) END AS closed_us, epoch_us(m.tt) AS merged_us,
       coalesce(h.v, f.head) AS head_sha, coalesce(b.v, f.base, x.base_ref) AS base_ref,
       CASE WHEN b.v = x.base_ref OR b.v IS NULL AND f.base IS NULL THEN x.base_sha ELSE '' END AS base_sha, CASE WHEN d.v IN ('APPROVED', 'CHANGES_REQUESTED') THEN d.v ELSE '' END AS decision,
       epoch_us(greatest(x.created_at, coalesce(u.tt, x.created_at))) AS updated_us
FROM p JOIN x ON x.number = p.number LEFT JOIN f ON f.number = p.number
{_asof("l", "kind", "kind IN ('closed', 'merged', 'reopened')")} {_asof("m", "kind", "kind = 'merged'")} {_asof("h", "sha", "sha IS NOT NULL")} {_asof("b", "ref", "kind = 'base_changed'")}
{_asof("d", "CASE WHEN kind = 'dismissed' THEN '' ELSE counted END", "kind = 'dismissed' OR kind = 'review' AND counted IN ('APPROVED', 'CHANGES_REQUESTED')")} {_asof("u", "kind", "kind NOT IN ('review', 'dismissed')")}""",
)
def _(spark, sf):
    out = t.pull_history_at(run_sql(spark, sf, ENDED), run_sql(spark, sf, HISTORY.format(at="at")), run_sql(spark, sf, PROBE.format(at="at")))
    return out.select("probe_id", "state", "merged", us("closed_at").alias("closed_us"), us("merged_at").alias("merged_us"), "head_sha", "base_ref", "base_sha", "decision", us("updated_at").alias("updated_us"))


@query("k4_pull_events", f"WITH s AS ({S_DUCK}) SELECT node, CASE WHEN row_number() OVER w = 1 THEN 'opened' WHEN head_sha IS NOT NULL THEN 'synchronize' WHEN base_ref IS NOT NULL THEN 'edited' ELSE coalesce(state, 'updated') END AS action, last_value(head_sha IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_head FROM s WINDOW w AS (PARTITION BY number ORDER BY tt, node)")
def _(spark, sf):
    return t.pull_events(run_sql(spark, sf, S_SPARK)).select("node", "action", "previous_head")


C = "SELECT conv_id AS thread_id, conv_id % 2 = 0 AS resolved, turn AS id, TIMESTAMP '2024-01-01 00:00:00' + CAST(turn AS INT) * INTERVAL 1 HOUR AS created_at, TIMESTAMP '2024-01-01 00:00:00' + CAST(turn + CASE WHEN length(text) % 2 = 0 THEN 1 ELSE 0 END AS INT) * INTERVAL 1 HOUR AS updated_at FROM conversations"


@query("k5_thread_events", f"WITH c AS ({C}) SELECT thread_id, id AS comment_id, 'created' AS action, epoch_us(created_at) AS at_us FROM c UNION ALL SELECT thread_id, id, 'edited', epoch_us(updated_at) FROM c WHERE updated_at > created_at UNION ALL SELECT thread_id, NULL, CASE WHEN resolved THEN 'resolved' ELSE 'unresolved' END, epoch_us(max(updated_at)) FROM c GROUP BY thread_id, resolved")
def _(spark, sf):
    threads = run_sql(spark, sf, C).groupBy("thread_id", "resolved").agg(F.collect_list(F.struct("id", "created_at", "updated_at")).alias("comments"))
    return t.thread_events(threads).select("thread_id", "comment_id", "action", us("at").alias("at_us"))


COMMITS = "SELECT user_id % 25 AS repo_id, md5(CAST(event_id AS STRING)) AS sha, CASE WHEN event_id % 3 = 0 THEN md5('p' || CAST(event_id AS STRING)) END AS parent_sha, ts AS committed_at FROM events"


@query("k6_pushes", f"SELECT repo_id, coalesce(parent_sha, lag(sha) OVER (PARTITION BY repo_id ORDER BY committed_at, sha), '') AS before_sha, sha AS after_sha FROM ({COMMITS})")
def _(spark, sf):
    return t.pushes(run_sql(spark, sf, COMMITS)).select("repo_id", "before_sha", "after_sha")


EDGES = "SELECT c.repo_id, c.number, min(p.number) AS parent FROM fx_pulls c JOIN fx_pulls p ON p.repo_id = c.repo_id AND p.head_ref = c.base_ref WHERE c.base_ref <> 'main' AND p.number <> c.number GROUP BY c.repo_id, c.number"
# chains of the fixture: each pull request stands on the one with the number before
CHAIN = f"WITH RECURSIVE e AS ({EDGES}), m AS (SELECT repo_id, number FROM e UNION SELECT repo_id, parent FROM e), r AS (SELECT m.repo_id, m.number, m.number AS root FROM m WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.repo_id = m.repo_id AND e.number = m.number) UNION ALL SELECT e.repo_id, e.number, r.root FROM r JOIN e ON e.repo_id = r.repo_id AND e.parent = r.number)"


@query("k7_stack_edges", EDGES)
def _(spark, sf):
    return t.stack_edges(fx(spark, sf, "pulls"))


@query("k8_stack_components", f"{CHAIN} SELECT repo_id, number, root FROM r")
def _(spark, sf):
    return t.stack_components(t.stack_edges(fx(spark, sf, "pulls")))


@query("k9_order_stacks", f"{CHAIN} SELECT repo_id, root AS stack_number, row_number() OVER (PARTITION BY repo_id, root ORDER BY number) AS position, number FROM r")
def _(spark, sf):
    pulls = fx(spark, sf, "pulls")
    return t.order_stacks(pulls, t.stack_edges(pulls)).select("repo_id", "stack_number", "position", "number")


REC = "SELECT event_id + 1 + CASE WHEN event_id >= 500 THEN 1 ELSE 0 END AS seq, event_id * 10 - CASE WHEN event_id % 100 = 50 THEN 500 ELSE 0 END AS at_ms, CASE event_type WHEN 'view' THEN 'pull_request' WHEN 'click' THEN 'check_run' WHEN 'error' THEN 'push' WHEN 'signup' THEN 'review' ELSE 'mystery' END AS kind, CASE WHEN user_id % 5 > 0 THEN user_id END AS number, 'x' AS sha, CASE WHEN user_id % 7 > 0 THEN 'r' END AS ref, user_id AS stack_number FROM events"


@query("k10_validate_recording", f"WITH r AS ({REC}), l AS (SELECT *, lag(at_ms) OVER (ORDER BY seq) AS last_ms, lag(seq) OVER (ORDER BY seq) AS last_seq FROM r) SELECT seq, 'sequence gap' AS problem FROM l WHERE seq <> 1 AND last_seq <> seq - 1 UNION ALL SELECT seq, 'time goes back' FROM l WHERE at_ms < last_ms AND last_seq = seq - 1 UNION ALL SELECT seq, 'unknown kind' FROM r WHERE kind = 'mystery' UNION ALL SELECT seq, 'missing field' FROM r WHERE kind IN ('pull_request', 'review') AND number IS NULL OR kind = 'push' AND ref IS NULL")
def _(spark, sf):
    return t.validate_recording(run_sql(spark, sf, REC))


@query("k11_arrival_profile", "WITH g AS (SELECT event_type, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts))) / 1000000.0 AS gap FROM events), b AS (SELECT event_type, max(n) AS peak FROM (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type) SELECT g.event_type, count(*) AS events, round(quantile_cont(gap, 0.5), 3) AS p50_s, round(max(gap), 3) AS max_s, any_value(peak) AS peak FROM g JOIN b ON b.event_type = g.event_type GROUP BY g.event_type")
def _(spark, sf):
    out = t.arrival_profile(run_sql(spark, sf, "SELECT event_type, ts AS at FROM events"), "event_type")
    return out.withColumns({"p50_s": F.round("p50_s", 3), "max_s": F.round("max_s", 3)})
