"""Queries on the delivery log and on dispatch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import NOW, fx, run_sql
from ..functions.scalars import actor_kind
from ..functions.session import scratch
from ..operators import dispatch as d
from ..sources.deliveries import conformance_report, decode_payload, project_envelope, read_deliveries, split_poison
from ..sources.recordings import read_recording
from ..sources.snapshots import append_events, read_snapshot, write_snapshot
from .registry import query, us

# payloads of the fixture deliveries; every 40th is a form, every 77th broken
PAYLOADS = """
SELECT delivery_guid, event, action, received_at, arrival, number, repo, head_sha, ref,
       CASE WHEN arrival % 40 = 0 THEN 'application/x-www-form-urlencoded' WHEN arrival % 61 = 0 THEN 'text/plain' WHEN arrival % 3 = 0 THEN 'application/json' END AS content_type,
       CASE WHEN arrival % 40 = 0 THEN 'payload=%7B%22action%22%3A%22' || action || '%22%2C%22number%22%3A' || CAST(number AS STRING) || '%2C%22repository%22%3A%7B%22full_name%22%3A%22' || replace(repo, '/', '%2F') || '%22%7D%7D'
            WHEN arrival % 77 = 0 THEN '[1]'
            ELSE '{"action":"' || action || '","number":' || CAST(number AS STRING) || ',"ref":"' || ref || '","before":"' || CASE WHEN arrival % 9 = 0 THEN '0000000000' ELSE head_sha END || '","after":"' || md5(head_sha)
                 || '","repository":{"full_name":"' || repo || '","default_branch":"b' || CAST(number % 50 AS STRING) || '"},"issue":{"number":' || CAST(number AS STRING) || CASE WHEN issue_is_pr THEN ',"pull_request":{"url":"x"}' ELSE '' END || '}'
                 || ',"commits":[{"added":[],"modified":["' || CASE WHEN arrival % 6 = 0 THEN 'CODEOWNERS' ELSE 'a.txt' END || '"],"removed":[]}],"check_run":{"head_sha":"' || head_sha || '"}'
                 || CASE WHEN arrival % 4 = 1 THEN ',"pull_request":{"number":' || CAST(number AS STRING) || ',"stack":{"id":7,"number":' || CAST(number % 10 AS STRING) || ',"size":3,"position":' || CAST(arrival % 5 AS STRING) || ',"base":{"ref":"main","sha":"' || CASE WHEN arrival % 8 = 1 THEN '' ELSE 'abc' END || '"}}}' ELSE '' END || '}' END AS body
FROM fx_deliveries"""


def payloads(spark, sf):
    return run_sql(spark, sf, PAYLOADS)


def envelopes(spark, sf):
    return project_envelope(split_poison(decode_payload(payloads(spark, sf)))[0])


def intents(spark, sf):
    matched = d.expand_targets(d.match_rules(envelopes(spark, sf), d.load_rules(spark)))
    return d.intent_key(matched).withColumn("priority", F.lit("event"))


# what the payloads above mean, written without parsing them
GOOD = "arrival % 61 <> 0 AND arrival % 77 <> 0 OR arrival % 40 = 0"
FULL = "arrival % 40 <> 0"
EXPECTED = f"""
e AS (SELECT *, {FULL} AS is_full, {FULL} AND arrival % 4 = 1 AS stacked FROM fx_deliveries WHERE {GOOD}),
i AS (
  SELECT *, 'refresh_pr' AS kind, 'pr:' || repo || ':' || CAST(number AS STRING) AS key FROM e WHERE event IN ('pull_request', 'pull_request_review') OR event = 'issue_comment' AND is_full AND issue_is_pr
  UNION ALL SELECT *, 'resolve_stack_membership', 'pr:' || repo || ':' || CAST(number AS STRING) FROM e WHERE event = 'pull_request'
  UNION ALL SELECT *, 'refresh_stack', 'stack:' || repo || ':' || CAST(number % 10 AS STRING) FROM e WHERE event = 'pull_request' AND stacked AND number % 10 > 0
  UNION ALL SELECT *, 'refresh_checks', 'checks:' || repo || ':' || head_sha FROM e WHERE event = 'check_run' AND is_full
  UNION ALL SELECT *, 'refresh_branch', 'branch:' || repo || ':' || substr(ref, 12) FROM e WHERE event = 'push' AND is_full
)
"""


@query("a1_read_deliveries", "SELECT event, count(*) AS n, epoch_us(min(received_at)) AS first_us FROM fx_deliveries GROUP BY event")
def _(spark, sf):
    return fx(spark, sf, "deliveries").groupBy("event").agg(F.count(F.lit(1)).alias("n"), us(F.min("received_at")).alias("first_us"))


@query("a1_read_log", "SELECT event_type AS event, count(*) AS n, epoch_us(max(ts)) AS last_us FROM events GROUP BY event_type")
def _(spark, sf):
    log = read_deliveries(spark, f"{sf}/events.parquet", schema="event_type string, ts timestamp_ntz")
    return log.groupBy(F.col("event_type").alias("event")).agg(F.count(F.lit(1)).alias("n"), us(F.max("ts")).alias("last_us"))


@query("a2_decode_payload", f"SELECT arrival, CASE WHEN {GOOD} THEN NULL WHEN arrival % 61 = 0 THEN 'unsupported content type' ELSE 'payload is not a JSON object' END AS decode_error FROM fx_deliveries")
def _(spark, sf):
    return decode_payload(payloads(spark, sf)).select("arrival", "decode_error")


@query("a3_project_envelope", f"SELECT arrival, action, number, repo, CASE WHEN {FULL} THEN ref END AS ref FROM fx_deliveries WHERE {GOOD}")
def _(spark, sf):
    return envelopes(spark, sf).select("arrival", "p.action", "p.number", F.col("p.repository.full_name").alias("repo"), "p.ref")


@query("a4_read_recording", "SELECT CASE event_type WHEN 'view' THEN 'pull_request' ELSE 'push' END AS kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS seqs FROM events GROUP BY 1")
def _(spark, sf):
    path = scratch(spark, "recording")
    body = "SELECT '{\"seq\":' || CAST(event_id AS STRING) || ',\"at_ms\":' || CAST(event_id * 10 AS STRING) || ',\"kind\":\"' || CASE event_type WHEN 'view' THEN 'pull_request' ELSE 'push' END || '\"}' AS value FROM events"
    lines = run_sql(spark, sf, body).unionByName(spark.createDataFrame([('{"type":"recording","version":1}',)], "value string"))
    lines.write.text(path)
    _, events = read_recording(spark, path)
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


@query("a5_rules", "SELECT * FROM (VALUES ('check_run', 1), ('check_suite', 1), ('issue_comment', 1), ('pull_request', 2), ('pull_request_review', 1), ('pull_request_review_comment', 1), ('pull_request_review_thread', 1), ('push', 2)) v(event, n)")
def _(spark, sf):
    return d.load_rules(spark).groupBy(F.col("r_event").alias("event")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("a6_live", "SELECT p.repo_id, number FROM fx_pulls p JOIN fx_repos r ON p.repo_id = r.repo_id WHERE p.tombstoned_at IS NULL AND r.tombstoned_at IS NULL")
def _(spark, sf):
    from ..operators.reads import live

    return live(fx(spark, sf, "pulls"), fx(spark, sf, "repos")).select("repo_id", "number")


@query("a7_conformance", f"""
WITH e AS (SELECT event, action, {FULL} AS is_full, arrival FROM fx_deliveries WHERE {GOOD})
SELECT event, action, '$.number' AS path, count(*) AS checked, 0 AS bad_missing, 0 AS bad_null, 0 AS bad_type, 0 AS bad_enum FROM e GROUP BY event, action
UNION ALL SELECT event, action, '$.ref', count(*), count(*) FILTER (WHERE NOT is_full), 0, 0, 0 FROM e WHERE event = 'push' GROUP BY event, action
UNION ALL SELECT event, action, '$.action', count(*), 0, 0, 0, count(*) FILTER (WHERE action = 'closed') FROM e GROUP BY event, action
UNION ALL SELECT event, action, '$.repository', count(*), 0, 0, count(*), 0 FROM e WHERE event = 'check_run' GROUP BY event, action""")
def _(spark, sf):
    schema = "event string, action string, path string, type string, required boolean, nullable boolean, allowed array<string>"
    every = [(e, "*", p, t, True, False, a) for e in ("pull_request", "check_run", "push", "pull_request_review", "issue_comment") for p, t, a in (("$.number", "integer", None), ("$.action", "string", ["opened", "synchronize"]))]
    rules = spark.createDataFrame([*every, ("push", "*", "$.ref", "string", True, False, None), ("check_run", "*", "$.repository", "string", True, False, None)], schema)
    return conformance_report(split_poison(decode_payload(payloads(spark, sf)))[0], rules)


@query("a8_write_snapshot", "SELECT state, count(*) AS n FROM fx_pulls WHERE number % 2 = 0 GROUP BY state")
def _(spark, sf):
    path, pulls = scratch(spark, "snapshot"), fx(spark, sf, "pulls")
    write_snapshot(pulls, path, 1)
    write_snapshot(pulls.where("number % 2 = 0"), path, 2)
    return read_snapshot(spark, path).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("a9_append_events", "SELECT stream, count(*) AS n, max(seq) AS last FROM fx_change_events GROUP BY stream")
def _(spark, sf):
    path, events = scratch(spark, "events"), fx(spark, sf, "change_events")
    append_events(events.where("seq % 2 = 0"), path, 0)
    append_events(events.where("seq % 2 = 1"), path, 1)
    append_events(events.where("seq % 2 = 1"), path, 1)  # a batch that comes again
    return spark.read.parquet(path).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))


@query("a10_dead_letters", f"SELECT event, count(*) AS n FROM fx_deliveries WHERE NOT ({GOOD}) GROUP BY event")
def _(spark, sf):
    return split_poison(decode_payload(payloads(spark, sf)))[1].groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query("b1_dedupe", "SELECT delivery_guid, event, arrival FROM (SELECT *, row_number() OVER (PARTITION BY delivery_guid ORDER BY received_at, arrival) AS k FROM fx_deliveries) WHERE k = 1")
def _(spark, sf):
    return d.dedupe_deliveries(fx(spark, sf, "deliveries")).select("delivery_guid", "event", "arrival")


@query("b2_match_rules", "SELECT event, CASE event WHEN 'check_run' THEN 'checks' ELSE 'pull_request' END AS target, count(*) AS n FROM fx_deliveries WHERE event <> 'push' GROUP BY event UNION ALL SELECT 'pull_request', 'resolve_stack_membership', count(*) FROM fx_deliveries WHERE event = 'pull_request' UNION ALL SELECT 'push', t, count(*) FROM fx_deliveries, (VALUES ('branch'), ('codeowners')) v(t) WHERE event = 'push' GROUP BY t")
def _(spark, sf):
    return d.match_rules(fx(spark, sf, "deliveries"), d.load_rules(spark)).groupBy("event", "target").agg(F.count(F.lit(1)).alias("n"))


@query("b3_intent_key", f"WITH {EXPECTED} SELECT DISTINCT arrival, kind, key FROM i")
def _(spark, sf):
    return intents(spark, sf).where("key is not null").select("arrival", "kind", "key").distinct()


@query("b4_expand_targets", f"WITH {EXPECTED}, s AS (SELECT count(*) AS n FROM e WHERE event = 'pull_request' AND stacked) SELECT 'stack' AS target, n FROM s")
def _(spark, sf):
    out = d.expand_targets(d.match_rules(envelopes(spark, sf), d.load_rules(spark)))
    return out.where("target = 'stack'").groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("b5_touches_codeowners", f"SELECT arrival FROM fx_deliveries WHERE ({GOOD}) AND {FULL} AND event = 'push' AND arrival % 6 = 0")
def _(spark, sf):
    return envelopes(spark, sf).where(F.col("event") == "push").where(d.touches_codeowners()).select("arrival")


@query("b6_push_hint", f"SELECT arrival, repo AS push_repo, substr(ref, 12) AS branch, CASE WHEN arrival % 9 = 0 THEN '' ELSE head_sha END AS before_sha, md5(head_sha) AS after_sha, TRUE AS transition_known FROM fx_deliveries WHERE ({GOOD}) AND {FULL} AND event = 'push'")
def _(spark, sf):
    return d.push_hint(envelopes(spark, sf).where("event = 'push'").select("arrival", "p")).select("arrival", "push_repo", "branch", "before_sha", "after_sha", "transition_known")


@query("b7_stack_hint", f"SELECT arrival, number AS pr_number, number % 10 AS stack_number, arrival % 5 AS stack_position FROM fx_deliveries WHERE ({GOOD}) AND {FULL} AND arrival % 4 = 1 AND number % 10 > 0 AND arrival % 5 BETWEEN 1 AND 3 AND arrival % 8 <> 1")
def _(spark, sf):
    return d.stack_hint(envelopes(spark, sf).select("arrival", "p")).select("arrival", "pr_number", "stack_number", "stack_position")


@query("b8_suppress_matching", f"""WITH {EXPECTED}, told AS (SELECT DISTINCT delivery_guid, key FROM i WHERE kind = 'refresh_stack' AND arrival % 5 BETWEEN 1 AND 3 AND arrival % 8 <> 1 AND number % 3 = 0)
SELECT kind, count(*) AS n FROM (SELECT DISTINCT delivery_guid, kind, key FROM i) x WHERE NOT EXISTS (SELECT 1 FROM told WHERE told.delivery_guid = x.delivery_guid AND told.key = x.key AND x.kind = 'refresh_stack') GROUP BY kind""")
def _(spark, sf):
    found = intents(spark, sf).where("key is not null").select("delivery_guid", "kind", "key").distinct()
    hints = d.stack_hint(envelopes(spark, sf).where("event = 'pull_request'").select("delivery_guid", "p"))
    # a cached stack for each summary of a number divisible by 3: the position that it names holds the number
    member = hints.where("pr_number % 3 = 0").select("hint_repo", "stack_number", "stack_position", "pr_number").distinct()
    entries = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(F.when(i == F.col("stack_position"), F.col("pr_number")).otherwise(F.lit(-1).cast("long")).alias("number")))
    stacks = member.select(F.col("hint_repo").alias("full_name"), F.col("stack_number").alias("number"), F.lit(7).cast("long").alias("gh_id"), F.lit("main").alias("base_ref"), F.lit("abc").alias("base_sha"), entries.alias("entries"))
    return d.suppress_matching(found, hints, stacks).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


COALESCED = f"WITH {EXPECTED} SELECT kind, key, 'event' AS priority, epoch_us(min(received_at)) AS received_us, count(DISTINCT delivery_guid) AS deliveries FROM i"


@query("b9_coalesce", f"{COALESCED} GROUP BY kind, key")
def _(spark, sf):
    return d.coalesce_intents(intents(spark, sf)).withColumn("received_us", us("received_at")).drop("received_at")


@query("b11_coalesce_checks", f"{COALESCED} WHERE kind = 'refresh_checks' GROUP BY kind, key")
def _(spark, sf):
    return d.coalesce_checks(intents(spark, sf)).withColumn("received_us", us("received_at")).drop("received_at")


@query("b10_debounce", """WITH RECURSIVE t AS (SELECT DISTINCT event AS key, epoch_us(received_at) AS us FROM fx_deliveries),
w AS (SELECT key, min(us) AS opened FROM t GROUP BY key UNION ALL SELECT w.key, (SELECT min(t.us) FROM t WHERE t.key = w.key AND t.us >= w.opened + 21600000000) FROM w WHERE EXISTS (SELECT 1 FROM t WHERE t.key = w.key AND t.us >= w.opened + 21600000000))
SELECT 'k' AS kind, w.key, opened AS opened_us, opened + 21600000000 AS due_us, count(*) AS instants FROM w JOIN t ON t.key = w.key AND t.us >= opened AND t.us < opened + 21600000000 GROUP BY w.key, opened""")
def _(spark, sf):
    return d.debounce(fx(spark, sf, "deliveries").select(F.lit("k").alias("kind"), F.col("event").alias("key"), "received_at"), 21_600)


GEN_STATE = "SELECT kind, refresh_key, generation, completed_generation, CASE WHEN generation % 2 = 0 THEN updated_at END AS deadline, event_received_at FROM fx_generations"
GEN_BATCH = "SELECT 'refresh_pr' AS kind, 'pr:' || repo || ':' || CAST(number + CASE WHEN arrival % 5 = 0 THEN 1000000 ELSE 0 END AS STRING) AS key, received_at, CASE WHEN arrival % 3 > 0 THEN received_at END AS deadline FROM fx_deliveries WHERE arrival % 7 = 0"


@query("b12_bump_generations", f"""WITH s AS ({GEN_STATE}), b AS (SELECT kind, key, min(received_at) AS r, min(deadline) AS d FROM ({GEN_BATCH}) GROUP BY kind, key)
SELECT coalesce(s.kind, b.kind) AS kind, coalesce(s.refresh_key, b.key) AS refresh_key, coalesce(generation, 0) + CASE WHEN b.key IS NULL THEN 0 ELSE 1 END AS generation, coalesce(completed_generation, 0) AS completed_generation,
       epoch_us(least(deadline, d)) AS deadline_us, epoch_us(least(event_received_at, r)) AS received_us FROM s FULL JOIN b ON s.kind = b.kind AND s.refresh_key = b.key""")
def _(spark, sf):
    out = d.bump_generations(run_sql(spark, sf, GEN_STATE), run_sql(spark, sf, GEN_BATCH))
    return out.select("kind", "refresh_key", "generation", "completed_generation", us("deadline").alias("deadline_us"), us("event_received_at").alias("received_us"))


GEN_DONE = "SELECT kind, refresh_key, CASE WHEN generation % 3 = 0 THEN generation ELSE generation - 1 END AS generation FROM fx_generations WHERE generation > 1"


@query("b13_complete_generations", f"""WITH s AS ({GEN_STATE}), dn AS ({GEN_DONE})
SELECT s.kind, s.refresh_key, s.generation, greatest(completed_generation, coalesce(dn.generation, completed_generation)) AS completed_generation, CASE WHEN coalesce(dn.generation >= s.generation, FALSE) THEN NULL ELSE epoch_us(deadline) END AS deadline_us
FROM s LEFT JOIN dn ON s.refresh_key = dn.refresh_key""")
def _(spark, sf):
    out = d.complete_generations(run_sql(spark, sf, GEN_STATE), run_sql(spark, sf, GEN_DONE))
    return out.select("kind", "refresh_key", "generation", "completed_generation", us("deadline").alias("deadline_us"))


@query("b14_delivery_outcome", "SELECT arrival, CASE WHEN arrival % 4 > 0 THEN 'processed' WHEN attempts >= 5 THEN 'parked' ELSE 'retry' END AS outcome, CASE WHEN arrival % 4 = 0 AND attempts < 5 THEN least(pow(2.0, greatest(attempts - 1, 0)), 60.0) END AS retry_after_s FROM fx_deliveries")
def _(spark, sf):
    df = fx(spark, sf, "deliveries").withColumn("error", F.when(F.col("arrival") % 4 == 0, "boom"))
    return d.delivery_outcome(df).select("arrival", "outcome", "retry_after_s")


DUE = "SELECT *, received_at + INTERVAL 1 HOUR AS next_attempt_at FROM fx_deliveries"


@query("b15_claim_due", f"SELECT arrival, 'processing' AS status, attempts + 1 AS attempts FROM ({DUE}) WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY received_at, delivery_guid LIMIT 50")
def _(spark, sf):
    return d.claim_due(run_sql(spark, sf, DUE), "2024-01-20 00:00:00", 50).select("arrival", "status", "attempts")


PARKED = "SELECT *, CASE WHEN arrival % 3 = 0 THEN 'timeout in fetch' ELSE 'bad payload' END AS last_error, CASE WHEN arrival % 7 = 0 THEN received_at END AS payload_pruned_at FROM fx_deliveries"


@query("b16_requeue_parked", f"SELECT delivery_guid, CASE WHEN payload_pruned_at IS NULL THEN 'pending' ELSE 'parked' END AS status, CASE WHEN payload_pruned_at IS NOT NULL THEN 'payload was pruned' END AS refused FROM ({PARKED}) WHERE status = 'parked' AND event = 'pull_request' AND last_error LIKE '%timeout%' ORDER BY received_at, delivery_guid LIMIT 100")
def _(spark, sf):
    return d.requeue_parked(run_sql(spark, sf, PARKED), event="pull_request", error="timeout").select("delivery_guid", "status", "refused")


@query("b17_delivery_counts", "SELECT status AS name, count(*) AS n FROM fx_deliveries GROUP BY status UNION ALL SELECT event, count(*) FROM fx_deliveries WHERE event = 'push' GROUP BY event")
def _(spark, sf):
    df = fx(spark, sf, "deliveries")
    some = d.load_rules(spark).where("r_event <> 'push'")
    return d.delivery_counts(df).withColumnRenamed("status", "name").unionByName(d.unmatched_counts(df, some).withColumnRenamed("event", "name"))


@query("c29_actor_kind", "SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'deleted' WHEN c_custkey % 6 = 0 THEN 'user' WHEN c_custkey % 6 = 1 THEN 'bot' WHEN c_custkey % 6 = 2 THEN 'mannequin' WHEN c_custkey % 6 = 3 THEN 'organization' WHEN c_custkey % 6 = 4 THEN 'enterprise_user_account' ELSE 'unknown' END AS kind FROM customer")
def _(spark, sf):
    df = run_sql(spark, sf, "SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'u' END AS login, element_at(array('User', 'Bot', 'Mannequin', 'Organization', 'EnterpriseUserAccount', 'Robot'), CAST(c_custkey % 6 + 1 AS INT)) AS type FROM customer")
    return df.select("id", actor_kind(F.col("type"), F.col("login")).alias("kind"))


@query("flagship_refresh_intents", f"""WITH {EXPECTED}, c AS (SELECT kind, key, min(received_at) AS received_at, count(DISTINCT delivery_guid) AS deliveries FROM i GROUP BY kind, key)
SELECT kind, count(*) AS intents, CAST(sum(deliveries) AS BIGINT) AS deliveries, max(epoch_us(TIMESTAMP '{NOW}') - epoch_us(received_at)) // 1000000 AS oldest_s FROM c GROUP BY kind""")
def flagship(spark, sf):
    out = d.coalesce_intents(intents(spark, sf))
    age = (us(F.lit(NOW).cast("timestamp_ntz")) - us("received_at")).alias("age")
    return out.select("kind", "deliveries", age).groupBy("kind").agg(F.count(F.lit(1)).alias("intents"), F.sum("deliveries").alias("deliveries"), F.floor(F.max("age") / 1_000_000).alias("oldest_s"))
