"""Queries on merges, owners, branch pushes and derivation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..fixtures import fx, run_sql
from ..functions.keys import parse_scope, scope_key
from ..operators import branch as b
from ..operators import derive as dv
from ..operators import merge as m
from ..operators import owners as o
from ..operators.merge import Spec
from .registry import QUERIES, query, us


def merge_sql(state: str, batch: str, spec: Spec, extra_accept: str = "") -> str:
    """The merge in plain SQL: which rows change and how many tombstones are left, per key."""
    keys = ", ".join(spec.keys)
    on = " AND ".join(f"s.{k} = i.{k}" for k in spec.keys)
    v = spec.version

    def value(c: str) -> str:
        if c in spec.keep_if_empty:
            return f"CASE WHEN s.{spec.keys[0]} IS NOT NULL AND i.{c} = '' THEN s.{c} ELSE i.{c} END"
        if c in spec.flagged:
            return f"CASE WHEN i.{spec.known_flag} THEN i.{c} ELSE s.{c} END"
        return f"i.{c}"

    differs = " OR ".join(f"({value(c)}) IS DISTINCT FROM s.{c}" for c in spec.payload)
    void = f"(s.{v} IS NULL AND i.{v} IS NOT NULL)" if spec.needs_version else f"s.{v} IS NULL"
    newer, equal = f"coalesce(i.{v} > s.{v}, FALSE)", f"i.{v} IS NOT DISTINCT FROM s.{v}"
    if spec.order:
        low = "TIMESTAMP '0001-01-01 00:00:00'"
        void = "FALSE"
        a = [f"i.{c}" if c == "lifecycle" else f"coalesce(i.{c}, {low})" for c in spec.order]
        z = [x.replace("i.", "s.", 1) if x.startswith("i.") else x.replace("(i.", "(s.") for x in a]
        newer, equal = f"({', '.join(a)}) > ({', '.join(z)})", f"({', '.join(a)}) = ({', '.join(z)})"
    accept = f"({void} OR {newer} OR ({equal} AND ({differs})) OR (s.tombstoned_at IS NOT NULL AND i.last_checked_at > s.tombstoned_at){extra_accept})"
    out = ", ".join(f"coalesce(s.{k}, i.{k}) AS {k}" for k in spec.keys)
    pick = ", ".join(f"CAST(CASE WHEN i.{spec.keys[0]} IS NOT NULL AND (s.{spec.keys[0]} IS NULL OR {accept}) THEN {value(c)} ELSE s.{c} END AS VARCHAR) AS {c}" for c in spec.payload)
    rank = ", ".join(f"{c} DESC NULLS LAST" for c in (*(spec.order or (v,)), "last_checked_at"))
    return f"""s AS ({state}), i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {rank}) AS k FROM ({batch})) WHERE k = 1),
merged AS (SELECT {out}, {pick}, CASE WHEN i.{spec.keys[0]} IS NULL THEN 'kept' WHEN s.{spec.keys[0]} IS NULL THEN 'inserted' WHEN {accept} THEN 'updated' ELSE 'kept' END AS change,
  CASE WHEN i.{spec.keys[0]} IS NOT NULL AND (s.{spec.keys[0]} IS NULL OR {accept}) THEN NULL ELSE s.tombstoned_at END AS tombstoned_at,
  CASE WHEN i.{spec.keys[0]} IS NOT NULL AND (s.{spec.keys[0]} IS NULL OR {accept}) THEN i.last_checked_at ELSE s.last_checked_at END AS last_checked_at, i.{spec.keys[0]} IS NOT NULL AS seen FROM s FULL JOIN i ON {on})"""


def merge_query(name: str, state: str, batch: str, spec: Spec, extra_accept: str = "") -> None:
    cols = ", ".join((*spec.keys, *spec.payload, "change"))

    @query(name, f"WITH {merge_sql(state, batch, spec, extra_accept)} SELECT {cols}, tombstoned_at IS NOT NULL AS dead FROM merged")
    def _(spark, sf):
        out = m.merge_if_newer(run_sql(spark, sf, state), run_sql(spark, sf, batch), spec)
        return out.select(*spec.keys, *[F.col(c).cast("string").alias(c) for c in spec.payload], "change", F.col("tombstoned_at").isNotNull().alias("dead"))


def replace_query(name: str, state: str, batch: str, parents: str, spec: Spec) -> None:
    cols = ", ".join(spec.keys)
    p_on = " AND ".join(f"p.{c} = {{0}}.{c}" for c in spec.parent)
    allowed = f"SELECT i.* FROM ({batch}) i WHERE EXISTS (SELECT 1 FROM ({parents}) p WHERE {p_on.format('i')})"
    gone = "seen IS FALSE AND tombstoned_at IS NULL AND o.observed_at IS NOT NULL AND last_checked_at <= o.observed_at"
    # a parent column that isn't a key was cast to text above
    join = " AND ".join(f"CAST(o.{c} AS VARCHAR) = CAST(merged.{c} AS VARCHAR)" for c in spec.parent)

    @query(name, f"WITH {merge_sql(state, allowed, spec)}, o AS (SELECT {', '.join(spec.parent)}, max(observed_at) AS observed_at FROM ({parents}) GROUP BY {', '.join(spec.parent)}) SELECT {', '.join(f'merged.{c}' for c in spec.keys)}, CASE WHEN {gone} THEN 'tombstoned' ELSE change END AS change, (tombstoned_at IS NOT NULL) OR ({gone}) AS dead FROM merged LEFT JOIN o ON {join}")
    def _(spark, sf):
        out = m.replace_set(run_sql(spark, sf, state), run_sql(spark, sf, batch), run_sql(spark, sf, parents), spec)
        return out.select(*[c.strip() for c in cols.split(",")], "change", F.col("tombstoned_at").isNotNull().alias("dead"))


PULL_STATE = "SELECT *, CASE WHEN number % 3 = 0 THEN number % 50 END AS stack_number, CASE WHEN number % 3 = 0 THEN number % 4 END AS stack_position, 'e' || CAST(number AS STRING) AS etag, CAST(NULL AS TIMESTAMP) AS display_until FROM fx_pulls"
PULL_BATCH = "SELECT *, number % 60 AS stack_number, number % 5 AS stack_position FROM fx_pull_batch"

T0 = "TIMESTAMP '2001-01-01 00:00:00'"
REPO_STATE = f"SELECT gh_id, owner, name, full_name, default_branch, archived, head_sha, CASE WHEN gh_id % 5 > 0 THEN {T0} END AS gh_updated_at, {T0} AS last_checked_at, tombstoned_at FROM fx_repos"
REPO_BATCH = f"SELECT CASE WHEN gh_id % 8 = 0 THEN gh_id + 500 ELSE gh_id END AS gh_id, owner, name, full_name, CASE WHEN gh_id % 2 = 0 THEN 'trunk' ELSE default_branch END AS default_branch, archived, CASE WHEN gh_id % 3 = 0 THEN '' ELSE md5(full_name) END AS head_sha, CASE WHEN gh_id % 4 = 1 THEN {T0} - INTERVAL 1 DAY ELSE {T0} END AS gh_updated_at, {T0} + INTERVAL 30 DAY AS last_checked_at FROM fx_repos"
STACK_STATE = "SELECT repo_id, number, state, base_ref, base_sha, 1 AS size, gh_updated_at, last_checked_at, tombstoned_at, CASE WHEN number % 4 = 0 THEN '' ELSE 'e' END AS etag FROM fx_pulls WHERE base_ref = 'main'"
STACK_BATCH = "SELECT repo_id, number, state, base_ref, base_sha, 1 + number % 2 AS size, gh_updated_at, last_checked_at, CASE WHEN number % 6 = 0 THEN '' ELSE 'f' END AS etag FROM fx_pull_batch WHERE base_ref = 'main'"
SNAP_STATE = "SELECT repo_id, number AS pr_number, number % 9 AS files_total, number % 5 = 0 AS files_truncated, 'present' AS codeowners_state, gh_updated_at, last_checked_at, tombstoned_at FROM fx_pulls"
SNAP_BATCH = "SELECT repo_id, number AS pr_number, number % 7 AS files_total, number % 5 = 0 AS files_truncated, 'present' AS codeowners_state, gh_updated_at, last_checked_at FROM fx_pull_batch"

merge_query("c1_merge_if_newer", "SELECT * FROM fx_pulls", "SELECT * FROM fx_pull_batch", Spec(("repo_id", "number"), ("title", "state", "head_sha")))
merge_query("c2_merge_repos", REPO_STATE, REPO_BATCH, m.REPOS)
merge_query("c3_merge_pulls", PULL_STATE, PULL_BATCH, m.PULL_REQUESTS)
merge_query("c4_merge_stacks", STACK_STATE, STACK_BATCH, m.STACKS, " OR (i.gh_updated_at IS NOT DISTINCT FROM s.gh_updated_at AND s.etag = '' AND i.etag <> '')")
merge_query("c12_merge_snapshots", SNAP_STATE, SNAP_BATCH, m.CHANGE_SNAPSHOTS)

CHILD = "SELECT thread_id * 100 + position AS {key}, repo_id, pr_number, author_login, body_chars, {more} {t} + CAST(position AS INT) * INTERVAL 1 DAY AS gh_updated_at, {t} + INTERVAL 40 DAY AS last_checked_at, CASE WHEN thread_id % 6 = 5 THEN {t} + INTERVAL 60 DAY END AS tombstoned_at FROM fx_thread_comments"
COMMENT_STATE = CHILD.format(key="node_id", more="", t=T0)
COMMENT_BATCH = f"SELECT node_id, repo_id, pr_number, author_login, body_chars + CASE WHEN node_id % 3 = 0 THEN 1 ELSE 0 END AS body_chars, CASE WHEN node_id % 5 = 0 THEN gh_updated_at - INTERVAL 1 DAY ELSE gh_updated_at END AS gh_updated_at, {T0} + INTERVAL 80 DAY AS last_checked_at FROM ({COMMENT_STATE}) WHERE node_id % 4 <> 1"
PARENTS = f"SELECT DISTINCT repo_id, pr_number, {T0} + INTERVAL 80 DAY AS observed_at FROM fx_thread_comments WHERE thread_id % 3 <> 2"
replace_query("c6_replace_set", COMMENT_STATE, COMMENT_BATCH, PARENTS, Spec(("node_id",), ("body_chars", "repo_id", "pr_number"), parent=("repo_id", "pr_number")))
replace_query("c11_comments", COMMENT_STATE, COMMENT_BATCH, PARENTS, m.COMMENTS)
THREAD_STATE = f"SELECT thread_id, repo_id, pr_number, max(position) % 2 = 0 AS resolved, count(*) AS n_comments, {T0} + CAST(count(*) AS INT) * INTERVAL 1 DAY AS gh_updated_at, {T0} AS last_checked_at, CASE WHEN thread_id % 6 = 5 THEN {T0} END AS tombstoned_at FROM fx_thread_comments GROUP BY thread_id, repo_id, pr_number"
THREAD_BATCH = f"SELECT thread_id, repo_id, pr_number, NOT resolved AS resolved, n_comments, gh_updated_at, {T0} + INTERVAL 9 DAY AS last_checked_at FROM ({THREAD_STATE}) WHERE thread_id % 5 <> 1"
replace_query("c8_review_threads", THREAD_STATE, THREAD_BATCH, PARENTS, m.REVIEW_THREADS)
REQUEST_STATE = f"SELECT repo_id, pr_number, 'user' AS reviewer_kind, position AS reviewer_id, author_login AS reviewer_login, {T0} AS gh_updated_at, {T0} AS last_checked_at, CASE WHEN position % 4 = 3 THEN {T0} END AS tombstoned_at, {T0} AS first_seen_at, CASE WHEN position = 1 THEN {T0} END AS requested_at FROM fx_thread_comments"
REQUEST_BATCH = f"SELECT repo_id, pr_number, reviewer_kind, reviewer_id, CASE WHEN reviewer_id = 2 THEN 'x' ELSE reviewer_login END AS reviewer_login, gh_updated_at, {T0} + INTERVAL 9 DAY AS last_checked_at, CAST(NULL AS TIMESTAMP) AS requested_at FROM ({REQUEST_STATE}) WHERE reviewer_id % 5 <> 1"
replace_query("c9_review_requests", REQUEST_STATE, REQUEST_BATCH, PARENTS, m.REVIEW_REQUESTS)
REVIEW_STATE = CHILD.format(key="node_id", more="CASE WHEN position % 3 = 0 THEN 'PENDING' ELSE 'APPROVED' END AS state, CASE WHEN position % 3 = 0 THEN 0 ELSE 1 END AS lifecycle, CASE WHEN position % 3 > 0 THEN TIMESTAMP '2001-01-01 00:00:00' END AS submitted_at,", t=T0)
REVIEW_BATCH = f"SELECT node_id, repo_id, pr_number, author_login, CASE WHEN node_id % 4 = 0 THEN 'DISMISSED' ELSE state END AS state, CASE WHEN node_id % 4 = 0 THEN 2 WHEN node_id % 4 = 1 THEN 0 ELSE lifecycle END AS lifecycle, submitted_at, gh_updated_at, {T0} + INTERVAL 80 DAY AS last_checked_at FROM ({REVIEW_STATE}) WHERE node_id % 7 <> 1"
replace_query("c10_reviews", REVIEW_STATE, REVIEW_BATCH, PARENTS, m.REVIEWS)
FILE_STATE = f"SELECT DISTINCT repo_id, pr_number, path, change_type, previous_path, {T0} AS gh_updated_at, {T0} AS last_checked_at, CAST(NULL AS TIMESTAMP) AS tombstoned_at FROM fx_changed_files"
FILE_BATCH = f"SELECT repo_id, pr_number, CASE WHEN pr_number % 4 = 0 THEN path || '.new' ELSE path END AS path, 'modified' AS change_type, previous_path, {T0} + INTERVAL 1 DAY AS gh_updated_at, {T0} + INTERVAL 1 DAY AS last_checked_at FROM ({FILE_STATE}) WHERE pr_number % 3 > 0"
FILE_PARENTS = f"SELECT DISTINCT repo_id, pr_number, {T0} + INTERVAL 1 DAY AS observed_at FROM fx_changed_files WHERE pr_number % 5 > 0"
replace_query("c13_changed_files", FILE_STATE, FILE_BATCH, FILE_PARENTS, m.CHANGED_FILES)
OWNER_STATE = FILE_STATE.replace("change_type, previous_path,", "'@acme/t' || CAST(pr_number % 3 AS STRING) AS owner_token, 'team' AS owner_type, CAST(pr_number % 9 AS INT) AS line,")
OWNER_BATCH = f"SELECT repo_id, pr_number, path, CASE WHEN pr_number % 4 = 0 THEN '@bob' ELSE owner_token END AS owner_token, owner_type, line + 1 AS line, {T0} + INTERVAL 1 DAY AS gh_updated_at, {T0} + INTERVAL 1 DAY AS last_checked_at FROM ({OWNER_STATE})"
replace_query("c14_file_owners", OWNER_STATE, OWNER_BATCH, FILE_PARENTS, m.FILE_OWNERS)
CHECK_KEYS = "SELECT DISTINCT gh_id, repo_id, head_sha, name FROM fx_check_observations"
CHECK_STATE = f"SELECT gh_id, repo_id, head_sha, name, 'in_progress' AS status, '' AS conclusion, CASE WHEN gh_id % 3 > 0 THEN {T0} END AS gh_updated_at, {T0} AS last_checked_at, CASE WHEN gh_id % 11 = 0 THEN {T0} END AS tombstoned_at FROM ({CHECK_KEYS})"
CHECK_BATCH = f"SELECT gh_id, repo_id, head_sha, name, 'completed' AS status, CASE WHEN gh_id % 2 = 0 THEN 'success' ELSE 'failure' END AS conclusion, CASE WHEN gh_id % 4 = 0 THEN NULL WHEN gh_id % 4 = 1 THEN {T0} - INTERVAL 1 DAY ELSE {T0} + INTERVAL 1 DAY END AS gh_updated_at, {T0} + INTERVAL 2 DAY AS last_checked_at FROM ({CHECK_KEYS}) WHERE gh_id % 10 <> 4"
CHECK_PARENTS = f"SELECT DISTINCT repo_id, head_sha, {T0} + INTERVAL 2 DAY AS observed_at FROM fx_check_observations WHERE repo_id % 2 = 0"
replace_query("c15_check_runs", CHECK_STATE, CHECK_BATCH, CHECK_PARENTS, m.CHECK_RUNS)
RULE_STATE = f"SELECT CAST(p_partkey % 25 AS BIGINT) AS repo_id, CAST(p_partkey AS STRING) AS rule_key, 'type' AS rule_type, '{{}}' AS parameters, CASE WHEN p_partkey % 4 > 0 THEN {T0} END AS gh_updated_at, {T0} AS last_checked_at, CAST(NULL AS TIMESTAMP) AS tombstoned_at FROM part"
RULE_BATCH = f"SELECT repo_id, CASE WHEN repo_id % 3 = 0 THEN rule_key || 'x' ELSE rule_key END AS rule_key, rule_type, '{{1}}' AS parameters, gh_updated_at + INTERVAL 1 DAY AS gh_updated_at, {T0} + INTERVAL 2 DAY AS last_checked_at FROM ({RULE_STATE})"
replace_query("c17_repo_rules", RULE_STATE, RULE_BATCH, f"SELECT DISTINCT repo_id, {T0} + INTERVAL 2 DAY AS observed_at FROM fx_repos WHERE repo_id % 4 > 0", m.REPO_RULES)

RULE_SYNC = "SELECT repo_id, CASE WHEN repo_id % 2 = 0 THEN 's' || CAST(repo_id AS STRING) ELSE '' END AS etag, TIMESTAMP '1997-01-01 00:00:00' AS last_checked_at FROM fx_repos WHERE repo_id % 5 > 0"
RULE_CHECKS = "SELECT repo_id, CASE WHEN number % 3 = 0 OR repo_id % 4 = 0 THEN '' ELSE 'e' || CAST(number AS STRING) END AS etag, last_checked_at AS checked_at, number AS arrival FROM fx_pulls WHERE repo_id % 7 > 0"


@query("c17_rule_sync", f"SELECT coalesce(s.repo_id, c.repo_id) AS repo_id, coalesce(c.etag, s.etag, '') AS etag, epoch_us(greatest(s.last_checked_at, c.checked_at)) AS checked_us FROM ({RULE_SYNC}) s FULL JOIN (SELECT repo_id, arg_max(etag, arrival) FILTER (WHERE etag <> '') AS etag, max(checked_at) AS checked_at FROM ({RULE_CHECKS}) GROUP BY repo_id) c ON c.repo_id = s.repo_id")
def _(spark, sf):
    return m.merge_rule_sync(run_sql(spark, sf, RULE_SYNC), run_sql(spark, sf, RULE_CHECKS)).select("repo_id", "etag", us("last_checked_at").alias("checked_us"))


ALIASES = "SELECT 'acme/old' || CAST(o_custkey % 40 AS STRING) AS full_name, o_orderkey % 25 AS repo_id, o_orderdate AS last_seen_at FROM orders"


@query("c5_merge_aliases", f"SELECT full_name, repo_id, epoch_us(last_seen_at) AS last_us FROM (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY last_seen_at DESC, repo_id DESC) AS k FROM ({ALIASES})) WHERE k = 1")
def _(spark, sf):
    return m.merge_aliases(run_sql(spark, sf, ALIASES)).select("full_name", "repo_id", us("last_seen_at").alias("last_us"))


GATED = "SELECT repo_id, pr_number, position, TIMESTAMP '1996-01-01 00:00:00' AS parent_gh_updated_at FROM fx_thread_comments"


@query("c7_parent_gate", f"SELECT g.repo_id, g.pr_number, g.position FROM ({GATED}) g JOIN fx_pulls p ON p.repo_id = g.repo_id AND p.number = g.pr_number WHERE p.tombstoned_at IS NULL AND (p.gh_updated_at IS NULL OR p.gh_updated_at <= g.parent_gh_updated_at)")
def _(spark, sf):
    return m.parent_gate(run_sql(spark, sf, GATED), fx(spark, sf, "pulls")).select("repo_id", "pr_number", "position")


OBS = "SELECT gh_id, status, conclusion, 'v' || status AS semantic_version, gh_updated_at, observed_at, tie FROM fx_check_observations"


@query("c16_check_history", f"WITH o AS ({OBS}), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gh_id ORDER BY gh_updated_at DESC NULLS LAST, tie DESC) AS k FROM o) WHERE k = 1) SELECT o.gh_id, o.tie FROM o WHERE EXISTS (SELECT 1 FROM a WHERE a.gh_id = o.gh_id AND a.status = o.status AND a.conclusion = o.conclusion AND a.gh_updated_at IS NOT DISTINCT FROM o.gh_updated_at)")
def _(spark, sf):
    o_ = run_sql(spark, sf, OBS)
    accepted = o_.groupBy("gh_id").agg(F.max_by(F.struct("status", "conclusion", "semantic_version", "gh_updated_at"), F.struct("gh_updated_at", "tie")).alias("r")).select("gh_id", "r.*")
    return m.append_check_history(accepted, o_).select("gh_id", "tie")


TOUCHED = "SELECT repo_id, number, last_checked_at + INTERVAL 5 DAY AS checked_at, CASE WHEN number % 2 = 0 THEN 'e' || CAST(number AS STRING) ELSE 'other' END AS etag FROM fx_pulls WHERE number % 3 = 0"


@query("c18_touch", f"SELECT s.repo_id, s.number, epoch_us(CASE WHEN t.etag = s.etag AND s.tombstoned_at IS NULL THEN greatest(s.last_checked_at, t.checked_at) ELSE s.last_checked_at END) AS checked_us FROM ({PULL_STATE}) s LEFT JOIN ({TOUCHED}) t ON s.repo_id = t.repo_id AND s.number = t.number")
def _(spark, sf):
    out = m.touch(run_sql(spark, sf, PULL_STATE), run_sql(spark, sf, TOUCHED), ["repo_id", "number"], require_etag=True)
    return out.select("repo_id", "number", us("last_checked_at").alias("checked_us"))


MISSING = "SELECT repo_id, number, TIMESTAMP '1995-06-01 00:00:00' AS observed_at FROM fx_pulls WHERE number % 4 = 0"


@query("c19_tombstone", f"SELECT s.repo_id, s.number, s.tombstoned_at IS NOT NULL OR (x.number IS NOT NULL AND s.last_checked_at <= x.observed_at) AS dead, CASE WHEN s.tombstoned_at IS NULL AND x.number IS NOT NULL AND s.last_checked_at <= x.observed_at THEN 'closed' ELSE s.state END AS state FROM fx_pulls s LEFT JOIN ({MISSING}) x ON s.repo_id = x.repo_id AND s.number = x.number")
def _(spark, sf):
    out = m.tombstone(fx(spark, sf, "pulls"), run_sql(spark, sf, MISSING), ["repo_id", "number"], close=True)
    return out.select("repo_id", "number", F.col("tombstoned_at").isNotNull().alias("dead"), "state")


LIVE_CHILD = f"SELECT node_id, o_orderkey % 25 AS x, repo_id, pr_number, tombstoned_at FROM (SELECT o_orderkey, o_orderkey * 3 AS node_id, CAST(floor(o_orderkey / 5) AS BIGINT) % 25 AS repo_id, o_orderkey + 1 AS pr_number, CASE WHEN o_orderkey % 50 = 0 THEN {T0} END AS tombstoned_at FROM orders)"


@query("c20_cascade_tombstone", f"SELECT c.node_id, epoch_us(coalesce(c.tombstoned_at, p.tombstoned_at)) AS dead_us FROM ({LIVE_CHILD}) c LEFT JOIN fx_pulls p ON p.repo_id = c.repo_id AND p.number = c.pr_number")
def _(spark, sf):
    return m.cascade_tombstone(run_sql(spark, sf, LIVE_CHILD), fx(spark, sf, "pulls")).select("node_id", us("tombstoned_at").alias("dead_us"))


VERSIONS = "SELECT 'k' || CAST(user_id AS STRING) AS entity_key, count(*) AS version FROM events GROUP BY user_id"
WRITES = "SELECT 'k' || CAST(user_id + CASE WHEN event_id % 19 = 0 THEN 100000 ELSE 0 END AS STRING) AS entity_key, event_id % 3 + CASE WHEN event_id % 2 = 0 THEN 60 ELSE 0 END AS start_version, event_id AS arrival FROM events"


@query("c21_cas_observations", f"WITH v AS ({VERSIONS}), w AS (SELECT entity_key, start_version, count(*) AS writers FROM ({WRITES}) GROUP BY entity_key, start_version) SELECT w.entity_key, start_version, start_version = coalesce(version, 0) AS accepted, coalesce(version, 0) + CASE WHEN start_version = coalesce(version, 0) THEN 1 ELSE 0 END AS version, writers - CASE WHEN start_version = coalesce(version, 0) THEN 1 ELSE 0 END AS rejected FROM w LEFT JOIN v ON w.entity_key = v.entity_key")
def _(spark, sf):
    return m.cas_observations(run_sql(spark, sf, VERSIONS), run_sql(spark, sf, WRITES))


@query("c22_emit_events", "SELECT entity_key, kind, 700 + row_number() OVER (ORDER BY entity_key, kind) AS seq FROM (SELECT DISTINCT entity_key, kind FROM fx_change_events)")
def _(spark, sf):
    return m.emit_events(fx(spark, sf, "change_events"), 701)


SCOPED = "SELECT repo_id, number, gh_updated_at AS marked_at, CASE WHEN number % 3 = 0 THEN number % 50 END AS stack_number, CASE WHEN number % 4 = 0 THEN number % 60 END AS old_stack FROM fx_pulls"


@query("c23_mark_dirty", f"WITH c AS ({SCOPED}), k AS (SELECT 'repo:' || CAST(repo_id AS STRING) || CASE WHEN stack_number IS NOT NULL THEN ':stack:' || CAST(stack_number AS STRING) ELSE ':pr:' || CAST(number AS STRING) END AS scope_key, marked_at FROM c UNION ALL SELECT 'repo:' || CAST(repo_id AS STRING) || CASE WHEN old_stack IS NOT NULL THEN ':stack:' || CAST(old_stack AS STRING) ELSE ':pr:' || CAST(number AS STRING) END, marked_at FROM c) SELECT scope_key, epoch_us(max(marked_at)) AS marked_us FROM k GROUP BY scope_key")
def _(spark, sf):
    c = run_sql(spark, sf, SCOPED)
    new, old = (c.select(scope_key(F.col("repo_id"), F.col(s), F.col("number")).alias("scope_key"), "marked_at") for s in ("stack_number", "old_stack"))
    return m.mark_dirty(new, old).select("scope_key", us("marked_at").alias("marked_us"))


@query("c24_scopes_of_heads", f"SELECT DISTINCT o.head_sha, 'repo:' || CAST(c.repo_id AS STRING) || CASE WHEN stack_number IS NOT NULL THEN ':stack:' || CAST(stack_number AS STRING) ELSE ':pr:' || CAST(c.number AS STRING) END AS scope_key FROM fx_check_observations o JOIN fx_pulls p ON p.repo_id = o.repo_id AND p.head_sha = o.head_sha JOIN ({SCOPED}) c ON c.repo_id = p.repo_id AND c.number = p.number")
def _(spark, sf):
    heads = fx(spark, sf, "check_observations").select("repo_id", "head_sha").distinct()
    stack = F.when(F.col("number") % 3 == 0, F.col("number") % 50)
    return fx(spark, sf, "pulls").join(heads, ["repo_id", "head_sha"]).select("head_sha", scope_key(F.col("repo_id"), stack, F.col("number")).alias("scope_key")).distinct()


LIVE_STACKS = f"SELECT repo_id, stack_number, CASE WHEN stack_number % 9 = 4 THEN {T0} END AS tombstoned_at FROM (SELECT DISTINCT repo_id, stack_number FROM ({SCOPED}) WHERE stack_number IS NOT NULL)"
OF_PULL = "CASE WHEN stack_number IS NOT NULL THEN 'repo:' || CAST(repo_id AS STRING) || ':stack:' || CAST(stack_number AS STRING) ELSE 'repo:' || CAST(repo_id AS STRING) || ':pr:' || CAST(number AS STRING) END"


def _members(spark, sf):
    return run_sql(spark, sf, f"SELECT repo_id, number, stack_number FROM ({SCOPED}) WHERE stack_number IS NOT NULL")


@query("c24_scopes_of_pulls", f"SELECT repo_id, number, {OF_PULL} AS scope_key FROM ({SCOPED}) WHERE number % 2 = 0")
def _(spark, sf):
    return m.scopes_for_pulls(fx(spark, sf, "pulls").where("number % 2 = 0"), _members(spark, sf))


@query("c24_scopes_of_checks", f"SELECT DISTINCT o.head_sha, c.scope_key FROM fx_check_observations o JOIN fx_pulls p ON p.repo_id = o.repo_id AND p.head_sha = o.head_sha AND p.tombstoned_at IS NULL JOIN (SELECT repo_id, number, {OF_PULL} AS scope_key FROM ({SCOPED})) c ON c.repo_id = p.repo_id AND c.number = p.number")
def _(spark, sf):
    return m.scopes_for_heads(fx(spark, sf, "check_observations"), fx(spark, sf, "pulls"), _members(spark, sf))


@query("c24_scopes_of_stacks", f"""WITH n AS (SELECT repo_id, number, stack_number FROM ({SCOPED}) WHERE stack_number IS NOT NULL), o AS (SELECT repo_id, number, old_stack AS stack_number FROM ({SCOPED}) WHERE old_stack IS NOT NULL)
SELECT 'repo:' || CAST(repo_id AS STRING) || ':stack:' || CAST(stack_number AS STRING) AS scope_key FROM ((SELECT * FROM n EXCEPT SELECT * FROM o) UNION (SELECT * FROM o EXCEPT SELECT * FROM n)) UNION SELECT 'repo:' || CAST(o.repo_id AS STRING) || ':pr:' || CAST(o.number AS STRING) FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.repo_id = o.repo_id AND n.number = o.number)""")
def _(spark, sf):
    old = run_sql(spark, sf, f"SELECT repo_id, number, old_stack AS stack_number FROM ({SCOPED}) WHERE old_stack IS NOT NULL")
    return m.scopes_for_stacks(_members(spark, sf), old)


@query("c24_scopes_of_repos", f"SELECT s.repo_id, 'repo:' || CAST(s.repo_id AS STRING) || ':stack:' || CAST(stack_number AS STRING) AS scope_key FROM ({LIVE_STACKS}) s JOIN fx_repos r ON r.repo_id = s.repo_id AND NOT r.archived WHERE s.tombstoned_at IS NULL UNION ALL SELECT p.repo_id, 'repo:' || CAST(p.repo_id AS STRING) || ':pr:' || CAST(p.number AS STRING) FROM fx_pulls p JOIN fx_repos r ON r.repo_id = p.repo_id AND NOT r.archived WHERE p.tombstoned_at IS NULL AND p.number % 3 <> 0")
def _(spark, sf):
    return m.scopes_for_repos(fx(spark, sf, "repos").where("not archived"), run_sql(spark, sf, LIVE_STACKS), fx(spark, sf, "pulls"), _members(spark, sf))


# snapshots of pull requests, of which some are of another commit than the parent's or older than it
FENCED_BATCH = "SELECT repo_id, number AS pr_number, number % 7 AS files_total, number % 5 = 0 AS files_truncated, 'present' AS codeowners_state, CASE WHEN number % 4 = 0 THEN 'other' ELSE head_sha END AS head_sha, base_sha, CASE WHEN number % 6 = 0 THEN gh_updated_at - INTERVAL 1 DAY ELSE gh_updated_at END AS parent_gh_updated_at, gh_updated_at + INTERVAL 1 DAY AS gh_updated_at, last_checked_at + INTERVAL 2 DAY AS last_checked_at FROM fx_pulls"
FENCED = f"SELECT i.repo_id, i.pr_number, i.files_total, i.files_truncated, i.codeowners_state, i.gh_updated_at, i.last_checked_at FROM ({FENCED_BATCH}) i JOIN fx_pulls p ON p.repo_id = i.repo_id AND p.number = i.pr_number AND p.head_sha = i.head_sha AND p.base_sha = i.base_sha WHERE i.head_sha <> '' AND i.base_sha <> '' AND p.tombstoned_at IS NULL AND p.gh_updated_at <= i.parent_gh_updated_at"


@query("c12_merge_fenced", f"WITH {merge_sql(SNAP_STATE, FENCED, m.CHANGE_SNAPSHOTS, '')} SELECT repo_id, pr_number, files_total, files_truncated, codeowners_state, change, tombstoned_at IS NOT NULL AS dead FROM merged")
def _(spark, sf):
    out = m.merge_fenced(run_sql(spark, sf, SNAP_STATE), run_sql(spark, sf, FENCED_BATCH), fx(spark, sf, "pulls"), m.CHANGE_SNAPSHOTS)
    return out.select("repo_id", "pr_number", *[F.col(c).cast("string").alias(c) for c in m.CHANGE_SNAPSHOTS.payload], "change", F.col("tombstoned_at").isNotNull().alias("dead"))


COMMITTED = "SELECT *, CASE WHEN pr_number % 7 = 3 THEN 'old' ELSE 'head' END AS head_sha, 'base' AS base_sha FROM"
SNAPSHOTS = "SELECT DISTINCT repo_id, pr_number, 'head' AS head_sha, 'base' AS base_sha FROM fx_changed_files WHERE pr_number % 8 <> 5"


def fenced_query(name: str, state: str, batch: str, spec: Spec) -> None:
    """The replace-set of ``batch`` that the snapshots' commits let through, against the SQL of the replace-set on what passes."""
    pass_ = "pr_number % 7 <> 3 AND pr_number % 8 <> 5"
    replace_query(name, state, f"SELECT * FROM ({batch}) WHERE {pass_}", f"SELECT * FROM ({FILE_PARENTS}) WHERE {pass_}", spec)

    def fenced(spark, sf):
        out = m.replace_fenced(run_sql(spark, sf, state), run_sql(spark, sf, f"{COMMITTED} ({batch})"), run_sql(spark, sf, f"{COMMITTED} ({FILE_PARENTS})"), run_sql(spark, sf, SNAPSHOTS), spec)
        return out.select(*spec.keys, "change", F.col("tombstoned_at").isNotNull().alias("dead"))

    QUERIES[name] = fenced


fenced_query("c13_replace_fenced", FILE_STATE, FILE_BATCH, m.CHANGED_FILES)
fenced_query("c14_replace_fenced", OWNER_STATE, OWNER_BATCH, m.FILE_OWNERS)

GATED_CHILDREN = "SELECT repo_id, number AS pr_number, number % 3 AS position, CASE WHEN number % 4 = 0 THEN gh_updated_at - INTERVAL 1 DAY ELSE gh_updated_at + CAST(number % 2 AS INT) * INTERVAL 1 DAY END AS parent_gh_updated_at FROM fx_pulls"


@query("c7_parent_gate_versions", f"SELECT repo_id, number AS pr_number, number % 3 AS position FROM fx_pulls WHERE number % 4 <> 0 AND tombstoned_at IS NULL")
def _(spark, sf):
    return m.parent_gate(run_sql(spark, sf, GATED_CHILDREN), fx(spark, sf, "pulls")).select("repo_id", "pr_number", "position")


@query("c25_semantic_version", "SELECT sha256(status || chr(31) || conclusion || chr(31) || name) AS version, count(*) AS n FROM fx_check_observations GROUP BY 1")
def _(spark, sf):
    out = m.check_semantic_version(fx(spark, sf, "check_observations"), ("status", "conclusion", "name"))
    return out.groupBy(F.col("semantic_version").alias("version")).agg(F.count(F.lit(1)).alias("n"))


MEMBERS = "SELECT repo_id, CAST(floor((number - 1) / 5) AS BIGINT) AS stack_number, (number - 1) % 5 + 1 AS position, number, head_ref, CASE WHEN number % 10 = 5 THEN '' ELSE head_sha END AS head_sha, gh_updated_at AS updated_at, base_ref, base_sha, tombstoned_at FROM fx_pulls"


@query("c26_shape_stacks", f"WITH t AS ({MEMBERS}) SELECT repo_id, stack_number, string_agg(CAST(number AS VARCHAR), ',' ORDER BY position) AS numbers, epoch_us(max(updated_at)) AS updated_us, coalesce(nullif(arg_max(head_sha, position), ''), arg_min(base_sha, position)) AS head_sha FROM t GROUP BY repo_id, stack_number")
def _(spark, sf):
    out = m.shape_stacks(run_sql(spark, sf, MEMBERS))
    return out.select("repo_id", "stack_number", F.array_join(F.transform("entries", lambda e: e["number"].cast("string")), ",").alias("numbers"), us("updated_at").alias("updated_us"), "head_sha")


NEW_MEMBERS = "SELECT repo_id, stack_number + CASE WHEN number % 7 = 0 THEN 1 ELSE 0 END AS stack_number, position + CASE WHEN number % 11 = 0 THEN 1 ELSE 0 END AS position, number + CASE WHEN number % 13 = 0 THEN 900000000 ELSE 0 END AS number FROM (" + MEMBERS + ")"


@query("c27_membership_diff", f"SELECT coalesce(o.repo_id, n.repo_id) AS repo_id, coalesce(o.number, n.number) AS number, CASE WHEN o.number IS NULL THEN 'joined' WHEN n.number IS NULL THEN 'left' ELSE 'moved' END AS change FROM ({MEMBERS}) o FULL JOIN ({NEW_MEMBERS}) n ON o.repo_id = n.repo_id AND o.number = n.number WHERE o.number IS NULL OR n.number IS NULL OR o.stack_number <> n.stack_number OR o.position <> n.position")
def _(spark, sf):
    return m.membership_diff(run_sql(spark, sf, MEMBERS), run_sql(spark, sf, NEW_MEMBERS)).select("repo_id", "number", "change")


FOLLOW = "SELECT 'acme/r' || CAST(repo_id AS STRING) AS full_name, number, head_sha AS old_head, CASE WHEN number % 3 = 0 THEN md5(head_sha) ELSE head_sha END AS new_head, CASE WHEN number % 4 > 0 THEN number % 20 END AS old_stack, CASE WHEN number % 6 > 0 THEN number % 20 END AS new_stack FROM fx_pulls"


@query("c28_followups", f"WITH f AS ({FOLLOW}) SELECT 'refresh_checks' AS kind, 'checks:' || full_name || ':' || new_head AS key FROM f WHERE new_head <> old_head UNION SELECT 'refresh_stack', 'stack:' || full_name || ':' || CAST(s AS STRING) FROM (SELECT full_name, unnest([old_stack, new_stack]) AS s FROM f WHERE old_stack IS DISTINCT FROM new_stack) WHERE s IS NOT NULL UNION SELECT 'resolve_stack_membership', 'pr:' || full_name || ':' || CAST(number AS STRING) FROM f WHERE old_stack IS DISTINCT FROM new_stack")
def _(spark, sf):
    return m.followups(run_sql(spark, sf, FOLLOW))


FOLD = Spec(("gh_id",), ("status", "conclusion"), "gh_updated_at")
FOLD_OBS = "SELECT gh_id, max(tie) AS tie, status, conclusion, gh_updated_at, observed_at AS last_checked_at FROM fx_check_observations GROUP BY gh_id, status, conclusion, gh_updated_at, observed_at"


@query("c30_fold_batch", f"SELECT gh_id, epoch_us(max(gh_updated_at)) AS version_us, count(*) AS folded FROM ({FOLD_OBS}) GROUP BY gh_id")
def _(spark, sf):
    obs = run_sql(spark, sf, FOLD_OBS)
    n = obs.groupBy("gh_id").agg(F.count(F.lit(1)).alias("folded"))
    return m.fold_batch(obs, FOLD).join(n, "gh_id").select("gh_id", us("gh_updated_at").alias("version_us"), "folded")


OWNERS_TEXT = "# owners\n*  @acme/all\n/fr/  @claire claire@example.com\nen/*  @acme/english @bob\n**/de/  @acme/german\n!x @no\n/es/\n"


def _rules(spark):
    return o.parse_codeowners(spark.createDataFrame([("s", OWNERS_TEXT)], "source_id string, content string"))


OWNED = """SELECT repo_id, pr_number, path, CASE WHEN path LIKE 'es/%' THEN NULL WHEN regexp_matches(path, '(^|/)de/.*') OR regexp_matches(path, '(^|/)de$') THEN '@acme/german' WHEN regexp_matches(path, '^en/[^/]*$') THEN '@acme/english,@bob'
WHEN path LIKE 'fr/%' OR path = 'fr' THEN '@claire,claire@example.com' ELSE '@acme/all' END AS owners FROM (SELECT DISTINCT repo_id, pr_number, path FROM fx_changed_files)"""


@query("d1_parse_rules", "SELECT * FROM (VALUES (2, '*', 1), (3, '/fr/', 2), (4, 'en/*', 2), (5, '**/de/', 1), (7, '/es/', 0)) v(line, pattern, owners)")
def _(spark, sf):
    return _rules(spark).select("line", "pattern", F.size("tokens").alias("owners"))


@query("d2_compile_patterns", """WITH f AS (SELECT DISTINCT path FROM fx_changed_files) SELECT line, count(*) AS n FROM f JOIN (VALUES (2, '.*'), (3, '^fr(/.*)?$'), (4, '^en/[^/]*$'), (5, '^(.*/)?de(/.*)?$'), (7, '^es(/.*)?$')) v(line, regex) ON regexp_matches(path, regex) GROUP BY line""")
def _(spark, sf):
    files = fx(spark, sf, "changed_files").select("path").distinct().withColumn("source_id", F.lit("s"))
    return files.join(F.broadcast(_rules(spark)), "source_id").where(F.regexp_like("path", F.col("regex"))).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("d3_resolve_owners", OWNED)
def _(spark, sf):
    files = fx(spark, sf, "changed_files").select(F.lit("s").alias("source_id"), "repo_id", "pr_number", "path")
    out = o.resolve_owners(files, F.broadcast(_rules(spark)))
    joined = out.groupBy("repo_id", "pr_number", "path").agg(F.array_join(F.array_sort(F.collect_list("owner_token")), ",").alias("owners"))
    return joined.withColumn("owners", F.nullif("owners", F.lit("")))


@query("d4_classify_owner", "SELECT * FROM (VALUES ('@acme/all', 'team'), ('@acme/english', 'team'), ('@acme/german', 'team'), ('@bob', 'user'), ('@claire', 'user'), ('claire@example.com', 'email')) v(token, type)")
def _(spark, sf):
    from ..functions.scalars import owner_type

    return _rules(spark).select(F.explode("tokens").alias("token")).distinct().select("token", owner_type(F.col("token")).alias("type"))


# rule files of repositories, written from the paths of their changed files and the names of suppliers
RULE_LINES = "SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS line FROM (SELECT DISTINCT repo_id, path FROM fx_changed_files)"
RULE_LINE = "CASE line % 4 WHEN 0 THEN '# ' || path WHEN 1 THEN '/' || path || ' @acme/t' || CAST(line AS STRING) WHEN 2 THEN path || ' @u' || CAST(line AS STRING) || ' who' || CAST(line AS STRING) || '@example.com # who' ELSE path || ' bad@ @ok' END"


def _written(spark, sf):
    lines = run_sql(spark, sf, f"SELECT CAST(repo_id AS STRING) AS source_id, line, {RULE_LINE} AS text FROM ({RULE_LINES})")
    return lines.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("content"))


@query("d1_parse_written_rules", f"SELECT CAST(repo_id AS STRING) AS source_id, line, CASE line % 4 WHEN 1 THEN '/' || path ELSE path END AS pattern, CASE line % 4 WHEN 1 THEN 1 ELSE 2 END AS owners FROM ({RULE_LINES}) WHERE line % 4 > 0")
def _(spark, sf):
    return o.parse_codeowners(_written(spark, sf)).select("source_id", "line", "pattern", F.size("tokens").alias("owners"))


@query("d4_classify_written_owners", f"SELECT DISTINCT unnest(CASE line % 4 WHEN 1 THEN ['@acme/t' || line] WHEN 2 THEN ['@u' || line, 'who' || line || '@example.com'] ELSE ['bad@', '@ok'] END) AS token, unnest(CASE line % 4 WHEN 1 THEN ['team'] WHEN 2 THEN ['user', 'email'] ELSE ['malformed', 'user'] END) AS type FROM ({RULE_LINES}) WHERE line % 4 > 0")
def _(spark, sf):
    from ..functions.scalars import owner_type

    rules = o.parse_codeowners(_written(spark, sf))
    return rules.select(F.explode("tokens").alias("token")).distinct().select("token", owner_type(F.col("token")).alias("type"))


SEEN = "SELECT 'user' AS identity_type, CASE WHEN user_id % 2 = 0 THEN 'U' ELSE 'u' END || CAST(user_id % 100 AS STRING) AS login, CASE WHEN event_id % 3 = 0 THEN user_id END AS gh_id, ts AS seen_at, 'n' || CAST(event_id AS STRING) AS node_id FROM events"


@query("d5_known_identities", f"SELECT identity_type, lower(login) AS login_key, gh_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY identity_type, lower(login) ORDER BY gh_id IS NOT NULL DESC, seen_at DESC, node_id DESC) AS k FROM ({SEEN})) WHERE k = 1")
def _(spark, sf):
    s = run_sql(spark, sf, SEEN)
    return o.known_identities(s.where("gh_id is null"), s.where("gh_id is not null")).select("identity_type", "login_key", "gh_id", "node_id")


@query("d6_resolve_identities", """WITH o AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '@U' || CAST(c_custkey % 50 AS STRING) WHEN c_custkey % 3 = 1 THEN '@Acme/t' || CAST(c_custkey % 5 AS STRING) ELSE '@other/t1' END AS t FROM customer)
SELECT id, CASE WHEN id % 3 = 0 AND id % 50 < 30 THEN id % 50 WHEN id % 3 = 1 AND id % 5 < 3 THEN 1000 + id % 5 END AS identity_id FROM o""")
def _(spark, sf):
    owners = run_sql(spark, sf, "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '@U' || CAST(c_custkey % 50 AS STRING) WHEN c_custkey % 3 = 1 THEN '@Acme/t' || CAST(c_custkey % 5 AS STRING) ELSE '@other/t1' END AS owner_token, CASE WHEN c_custkey % 3 = 0 THEN 'user' ELSE 'team' END AS owner_type, 'acme' AS repo_owner FROM customer")
    users = spark.range(30).select(F.lit("user").alias("identity_type"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("login_key"), F.col("id").alias("gh_id"))
    teams = spark.range(3).select(F.lit("team").alias("identity_type"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("login_key"), (F.col("id") + 1000).alias("gh_id"))
    return o.resolve_identities(owners, users.unionByName(teams)).select("id", "identity_id")


CANDIDATES = "SELECT CAST(p_partkey AS BIGINT) AS repo_id, l AS path, CASE WHEN p_partkey % (k + 2) = 0 THEN 'x' || CAST(k AS STRING) END AS content, p_partkey % 17 = k AS unavailable FROM part CROSS JOIN (SELECT '.github/CODEOWNERS' AS l, 0 AS k UNION ALL SELECT 'CODEOWNERS', 1 UNION ALL SELECT 'docs/CODEOWNERS', 2) v"


@query("d7_effective_source", f"WITH c AS ({CANDIDATES}), f AS (SELECT repo_id, path, CASE WHEN unavailable THEN 'unavailable' ELSE 'present' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY CASE path WHEN '.github/CODEOWNERS' THEN 0 WHEN 'CODEOWNERS' THEN 1 ELSE 2 END) AS k FROM c WHERE content IS NOT NULL OR unavailable) WHERE k = 1) SELECT a.repo_id, coalesce(f.state, 'missing') AS state, coalesce(f.path, '') AS path FROM (SELECT DISTINCT repo_id FROM c) a LEFT JOIN f ON f.repo_id = a.repo_id")
def _(spark, sf):
    return o.effective_source(run_sql(spark, sf, CANDIDATES)).select("repo_id", "state", "path")


@query("d8_flag_truncated", "WITH t AS (SELECT DISTINCT repo_id, pr_number FROM fx_changed_files), g AS (SELECT repo_id, pr_number, count(*) AS n, count(*) FILTER (WHERE change_type = 'renamed' AND previous_path IS NULL) AS blind FROM fx_changed_files GROUP BY repo_id, pr_number) SELECT t.repo_id, t.pr_number, n <> 1 + t.pr_number % 2 OR blind > 0 AS files_truncated FROM t JOIN g ON t.repo_id = g.repo_id AND t.pr_number = g.pr_number")
def _(spark, sf):
    files = fx(spark, sf, "changed_files")
    totals = files.select("repo_id", "pr_number").distinct().withColumn("files_total", 1 + F.col("pr_number") % 2)
    return o.flag_truncated(files, totals).select("repo_id", "pr_number", "files_truncated")


PUSHES = "SELECT delivery_guid, CAST(floor((number * 7) / 5) AS BIGINT) % 25 AS repo_id, CASE WHEN arrival % 4 = 0 THEN 'main' ELSE 'b' || CAST(number * 7 AS STRING) END AS branch, CASE WHEN arrival % 3 = 0 THEN 'zz' WHEN arrival % 4 = 0 THEN md5('main') ELSE md5('h' || CAST(number * 7 AS STRING)) END AS before_sha, md5('after' || CAST(number AS STRING)) AS after_sha, arrival % 5 > 0 AS transition_known, received_at FROM (SELECT * FROM fx_deliveries WHERE event = 'push' AND arrival % 10 <> 9)"
ON_BRANCH = f"SELECT DISTINCT p.delivery_guid, p.repo_id, x.number FROM ({PUSHES}) p JOIN fx_pulls x ON x.repo_id = p.repo_id AND (x.head_ref = p.branch OR x.base_ref = p.branch) WHERE x.state = 'open' AND x.tombstoned_at IS NULL"
ENTRY = "SELECT repo_id, stack_number, position, number, head_ref, head_sha, base_ref, base_sha FROM (" + MEMBERS + ")"
ON_STACK = f"SELECT DISTINCT p.delivery_guid, p.repo_id, t.stack_number FROM ({PUSHES}) p JOIN (SELECT repo_id, stack_number, head_ref AS r FROM ({ENTRY}) UNION SELECT repo_id, stack_number, arg_min(base_ref, position) FROM ({ENTRY}) GROUP BY repo_id, stack_number) t ON t.repo_id = p.repo_id AND t.r = p.branch"


def _stacks(spark, sf):
    return m.shape_stacks(run_sql(spark, sf, MEMBERS)).withColumn("tombstoned_at", F.lit(None).cast("timestamp_ntz"))


@query("e1_prs_on_branch", ON_BRANCH)
def _(spark, sf):
    return b.prs_on_branch(run_sql(spark, sf, PUSHES), fx(spark, sf, "pulls"))


@query("e2_stacks_on_branch", ON_STACK)
def _(spark, sf):
    return b.stacks_on_branch(run_sql(spark, sf, PUSHES), _stacks(spark, sf))


TARGETS = f"SELECT delivery_guid, 'pr' AS kind, repo_id, number FROM ({ON_BRANCH}) UNION SELECT delivery_guid, 'stack', repo_id, stack_number FROM ({ON_STACK}) UNION SELECT a.delivery_guid, 'stack', a.repo_id, t.stack_number FROM ({ON_BRANCH}) a JOIN ({ENTRY}) t ON t.repo_id = a.repo_id AND t.number = a.number UNION SELECT p.delivery_guid, 'repo', p.repo_id, 0 FROM ({PUSHES}) p JOIN fx_repos r ON r.repo_id = p.repo_id AND r.default_branch = p.branch WHERE r.tombstoned_at IS NULL"


def _reconciled(spark, sf):
    return run_sql(spark, sf, PUSHES), fx(spark, sf, "pulls"), _stacks(spark, sf), fx(spark, sf, "repos")


@query("e3_branch_targets", TARGETS)
def _(spark, sf):
    return b.branch_targets(*_reconciled(spark, sf))


MOVES = f"SELECT repo_id, branch, before_sha, arg_min(after_sha, (received_at, delivery_guid)) AS after_sha FROM ({PUSHES}) WHERE transition_known GROUP BY repo_id, branch, before_sha"


@query("e4_apply_push", f"SELECT p.repo_id, p.number, CASE WHEN p.state = 'open' AND p.tombstoned_at IS NULL AND h.after_sha IS NOT NULL THEN h.after_sha ELSE p.head_sha END AS head_sha, CASE WHEN p.state = 'open' AND p.tombstoned_at IS NULL AND s.after_sha IS NOT NULL THEN s.after_sha ELSE p.base_sha END AS base_sha, p.state = 'open' AND p.tombstoned_at IS NULL AND (h.after_sha IS NOT NULL OR s.after_sha IS NOT NULL) AS moved FROM fx_pulls p LEFT JOIN ({MOVES}) h ON h.repo_id = p.repo_id AND h.branch = p.head_ref AND h.before_sha = p.head_sha LEFT JOIN ({MOVES}) s ON s.repo_id = p.repo_id AND s.branch = p.base_ref AND s.before_sha = p.base_sha")
def _(spark, sf):
    return b.push_pulls(fx(spark, sf, "pulls"), run_sql(spark, sf, PUSHES)).select("repo_id", "number", "head_sha", "base_sha", "moved")


@query("e4_push_stacks", f"SELECT repo_id, stack_number, string_agg(h, ',' ORDER BY position) AS heads FROM (SELECT e.repo_id, e.stack_number, e.position, coalesce(v.after_sha, e.head_sha) AS h FROM ({ENTRY}) e LEFT JOIN ({MOVES}) v ON v.repo_id = e.repo_id AND v.branch = e.head_ref AND v.before_sha = e.head_sha) GROUP BY repo_id, stack_number")
def _(spark, sf):
    return b.push_stacks(_stacks(spark, sf), run_sql(spark, sf, PUSHES)).select("repo_id", "stack_number", F.array_join("entries.head_sha", ",").alias("heads"))

# pushes that lead from commit to commit of a branch, there and back; the SQL applies them one by one
CHAINED = "SELECT 'e' || CAST(event_id AS STRING) AS delivery_guid, CAST(floor((user_id * 7) / 5) AS BIGINT) % 25 AS repo_id, CASE WHEN event_id % 3 = 0 THEN 'main' ELSE 'b' || CAST(user_id * 7 AS STRING) END AS branch, 's' || CAST(event_id % 4 AS STRING) AS before_sha, 's' || CAST(CAST(floor(event_id / 4) AS BIGINT) % 4 AS STRING) AS after_sha, event_id % 11 > 0 AS transition_known, ts AS received_at FROM events"
CHAINED_PULLS = "SELECT repo_id, number, state, tombstoned_at, head_ref, 's' || CAST(number % 3 AS STRING) AS head_sha, base_ref, 's' || CAST(number % 5 AS STRING) AS base_sha FROM fx_pulls"
CHAINED_REPOS = "SELECT repo_id, default_branch, 's' || CAST(repo_id % 6 AS STRING) AS head_sha, tombstoned_at FROM fx_repos"
ENDS = f"p AS (SELECT repo_id, branch, before_sha, after_sha, row_number() OVER (PARTITION BY repo_id, branch ORDER BY received_at, delivery_guid) AS i FROM ({CHAINED}) WHERE transition_known AND before_sha <> after_sha), w AS (SELECT repo_id, branch, before_sha AS start, before_sha AS stood, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS hops FROM (SELECT DISTINCT repo_id, branch, before_sha FROM p) UNION ALL SELECT w.repo_id, w.branch, w.start, CASE WHEN p.before_sha = w.stood THEN p.after_sha ELSE w.stood END, p.i, w.hops + CASE WHEN p.before_sha = w.stood THEN 1 ELSE 0 END FROM w JOIN p ON p.repo_id = w.repo_id AND p.branch = w.branch AND p.i = w.i + 1), v AS (SELECT repo_id, branch, start AS before_sha, arg_max(stood, i) AS after_sha, max(hops) AS hops FROM w GROUP BY 1, 2, 3)"
MOVED_PULLS = f"mp AS (SELECT x.repo_id, x.number, coalesce(h.after_sha, x.head_sha) AS head_sha, coalesce(s.after_sha, x.base_sha) AS base_sha, h.hops IS NOT NULL OR s.hops IS NOT NULL AS moved FROM ({CHAINED_PULLS}) x LEFT JOIN v h ON h.repo_id = x.repo_id AND h.branch = x.head_ref AND h.before_sha = x.head_sha AND x.state = 'open' AND x.tombstoned_at IS NULL LEFT JOIN v s ON s.repo_id = x.repo_id AND s.branch = x.base_ref AND s.before_sha = x.base_sha AND x.state = 'open' AND x.tombstoned_at IS NULL)"
MOVED_REPOS = f"mr AS (SELECT r.repo_id, CASE WHEN r.tombstoned_at IS NULL THEN coalesce(v.after_sha, r.head_sha) ELSE r.head_sha END AS head_sha, r.tombstoned_at IS NULL AND v.hops IS NOT NULL AS moved FROM ({CHAINED_REPOS}) r LEFT JOIN v ON v.repo_id = r.repo_id AND v.branch = r.default_branch AND v.before_sha = r.head_sha)"
CHAINED_ENTRY = "SELECT repo_id, stack_number, position, number, head_ref, 's' || CAST(number % 3 AS STRING) AS head_sha, base_ref, 's' || CAST(number % 5 AS STRING) AS base_sha, updated_at FROM (" + MEMBERS + ")"
MOVED_STACKS = f"en AS (SELECT e.repo_id, e.stack_number, e.number, h.hops IS NOT NULL OR e.position = min(e.position) OVER (PARTITION BY e.repo_id, e.stack_number) AND s.hops IS NOT NULL AS moved FROM ({CHAINED_ENTRY}) e LEFT JOIN v h ON h.repo_id = e.repo_id AND h.branch = e.head_ref AND h.before_sha = e.head_sha LEFT JOIN v s ON s.repo_id = e.repo_id AND s.branch = e.base_ref AND s.before_sha = e.base_sha), ms AS (SELECT repo_id, stack_number, bool_or(moved) AS moved FROM en GROUP BY 1, 2)"


def _chained(spark, sf):
    """Pull requests, stacks and repositories after the pushes."""
    moves = b.branch_transitions(run_sql(spark, sf, CHAINED))
    stacks = m.shape_stacks(run_sql(spark, sf, CHAINED_ENTRY)).withColumn("tombstoned_at", F.lit(None).cast("timestamp_ntz"))
    return b.push_pulls(run_sql(spark, sf, CHAINED_PULLS), None, moves), b.push_stacks(stacks, None, moves), b.push_repos(run_sql(spark, sf, CHAINED_REPOS), None, moves)


@query("e4_branch_transitions", f"WITH RECURSIVE {ENDS} SELECT * FROM v")
def _(spark, sf):
    return b.branch_transitions(run_sql(spark, sf, CHAINED))


@query("e4_push_chains", f"WITH RECURSIVE {ENDS}, {MOVED_PULLS} SELECT * FROM mp")
def _(spark, sf):
    return _chained(spark, sf)[0].select("repo_id", "number", "head_sha", "base_sha", "moved")


@query("e4_push_repos", f"WITH RECURSIVE {ENDS}, {MOVED_REPOS} SELECT * FROM mr")
def _(spark, sf):
    return _chained(spark, sf)[2].select("repo_id", "head_sha", "moved")


@query("e4_push_scopes", f"WITH RECURSIVE {ENDS}, {MOVED_PULLS}, {MOVED_STACKS} SELECT DISTINCT CASE WHEN e.stack_number IS NULL THEN 'repo:' || mp.repo_id || ':pr:' || mp.number ELSE 'repo:' || e.repo_id || ':stack:' || e.stack_number END AS scope_key FROM mp LEFT JOIN en e ON e.repo_id = mp.repo_id AND e.number = mp.number WHERE mp.moved UNION SELECT 'repo:' || repo_id || ':stack:' || stack_number FROM ms WHERE moved")
def _(spark, sf):
    return b.push_effects(*_chained(spark, sf))[0]


@query("e4_push_events", f"WITH RECURSIVE {ENDS}, {MOVED_PULLS}, {MOVED_STACKS}, {MOVED_REPOS} SELECT 'repository.changed' AS kind, 'repo:' || repo_id AS entity_key FROM mr WHERE moved UNION ALL SELECT 'pull_request.changed', 'pr:' || repo_id || ':' || number FROM mp WHERE moved UNION ALL SELECT 'stack.changed', 'stack:' || repo_id || ':' || stack_number FROM ms WHERE moved")
def _(spark, sf):
    return b.push_effects(*_chained(spark, sf))[1]


@query("e5_begin_reconciliation", f"WITH s AS (SELECT repo_id, branch, count(*) AS generation, min(delivery_guid) AS g FROM ({PUSHES}) WHERE branch = 'main' GROUP BY repo_id, branch), n AS (SELECT p.repo_id, p.branch, count(DISTINCT delivery_guid) AS n, arg_max(delivery_guid, (received_at, delivery_guid)) AS g FROM ({PUSHES}) p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.repo_id = p.repo_id AND s.branch = p.branch AND s.g = p.delivery_guid) GROUP BY p.repo_id, p.branch) SELECT coalesce(s.repo_id, n.repo_id) AS repo_id, coalesce(s.branch, n.branch) AS branch, coalesce(s.generation, 0) + coalesce(n.n, 0) AS generation, coalesce(n.g, s.g) AS delivery_guid FROM s FULL JOIN n ON s.repo_id = n.repo_id AND s.branch = n.branch")
def _(spark, sf):
    p = run_sql(spark, sf, PUSHES)
    state = p.where("branch = 'main'").groupBy("repo_id", "branch").agg(F.count(F.lit(1)).alias("generation"), F.min("delivery_guid").alias("delivery_guid"))
    return b.begin_reconciliation(state, p).select("repo_id", "branch", "generation", "delivery_guid")


@query("e6_page_targets", f"SELECT delivery_guid, (row_number() OVER (PARTITION BY delivery_guid ORDER BY kind, repo_id, number) - 1) // 25 AS page, kind, number FROM ({TARGETS})")
def _(spark, sf):
    return b.paged_branch_targets(*_reconciled(spark, sf)).select("delivery_guid", "page", "kind", "number")


PAGES = "SELECT repo, ref, user_id % 3 AS generation, event_id AS page, user_id % 25 AS targets, event_id % 4 > 0 AS done FROM (SELECT 'r' || CAST(user_id % 25 AS STRING) AS repo, 'b' || CAST(user_id AS STRING) AS ref, user_id, event_id FROM events)"


@query("e7_reconciliation_status", f"WITH p AS ({PAGES}), c AS (SELECT *, max(generation) OVER (PARTITION BY repo, ref) AS last FROM p) SELECT repo AS repo_id, ref AS branch, count(*) FILTER (WHERE NOT done) AS pending_pages, CAST(coalesce(sum(targets) FILTER (WHERE NOT done), 0) AS BIGINT) AS pending_targets, bool_and(done) AS complete FROM c WHERE generation = last GROUP BY repo, ref")
def _(spark, sf):
    return b.reconciliation_status(run_sql(spark, sf, PAGES).withColumnsRenamed({"repo": "repo_id", "ref": "branch"}))


@query("e8_claim_targets", "WITH t AS (SELECT DISTINCT 'refresh_pr' AS kind, 'pr:' || repo || ':' || CAST(number AS STRING) AS k FROM fx_deliveries WHERE arrival % 4 = 0) SELECT s.kind, s.refresh_key, s.generation + CASE WHEN t.k IS NULL THEN 0 ELSE 1 END AS generation, CASE WHEN t.k IS NULL THEN s.completed_generation ELSE s.generation + 1 END AS completed_generation FROM fx_generations s LEFT JOIN t ON t.k = s.refresh_key")
def _(spark, sf):
    targets = run_sql(spark, sf, "SELECT 'refresh_pr' AS kind, 'pr:' || repo || ':' || CAST(number AS STRING) AS refresh_key FROM fx_deliveries WHERE arrival % 4 = 0")
    return b.claim_targets(fx(spark, sf, "generations"), targets)


DIRTY = "SELECT 'repo:' || CAST(repo_id AS STRING) || CASE WHEN number % 3 = 0 THEN ':stack:' || CAST(number % 50 + 1 AS STRING) ELSE ':pr:' || CAST(number AS STRING) END AS scope_key, max(gh_updated_at) AS marked_at FROM fx_pulls GROUP BY 1"
IN_SCOPE = "SELECT repo_id, number, state, head_sha, 'repo:' || CAST(repo_id AS STRING) || CASE WHEN number % 3 = 0 THEN ':stack:' || CAST(number % 50 + 1 AS STRING) ELSE ':pr:' || CAST(number AS STRING) END AS scope_key FROM fx_pulls WHERE tombstoned_at IS NULL"


@query("f1_claim_dirty", f"SELECT scope_key, epoch_us(marked_at) AS marked_us FROM ({DIRTY}) ORDER BY marked_at, scope_key LIMIT 500")
def _(spark, sf):
    return dv.claim_dirty(run_sql(spark, sf, DIRTY)).select("scope_key", us("marked_at").alias("marked_us"))


def _snapshots(spark, sf):
    pulls = fx(spark, sf, "pulls").withColumn("stack_number", F.when(F.col("number") % 3 == 0, F.col("number") % 50 + 1))
    threads = pulls.select("repo_id", F.col("number").alias("pr_number"), "head_sha", (F.col("number") % 2 == 0).alias("resolved"), "tombstoned_at")
    checks = fx(spark, sf, "check_observations").select("repo_id", "head_sha", "conclusion", F.lit(None).cast("timestamp_ntz").alias("tombstoned_at"))
    return dv.scope_snapshots(run_sql(spark, sf, DIRTY), fx(spark, sf, "repos"), pulls, threads, checks)


SNAP = f"WITH c AS (SELECT repo_id, head_sha, count(*) AS n, count(*) FILTER (WHERE conclusion = 'failure') AS bad FROM fx_check_observations GROUP BY repo_id, head_sha), p AS ({IN_SCOPE}) SELECT d.scope_key, count(p.number) AS pulls, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS checks, CAST(coalesce(sum(c.bad), 0) AS BIGINT) AS failures FROM ({DIRTY}) d LEFT JOIN p ON p.scope_key = d.scope_key LEFT JOIN c ON c.repo_id = p.repo_id AND c.head_sha = p.head_sha GROUP BY d.scope_key"


@query("f2_scope_snapshots", SNAP)
def _(spark, sf):
    def total(c: str):
        return F.aggregate("pulls", F.lit(0).cast("long"), lambda a, p: a + p[c])

    return _snapshots(spark, sf).select("scope_key", F.size("pulls").cast("long").alias("pulls"), total("checks").alias("checks"), total("failures").alias("failures"))


def _failing(rows: pd.DataFrame) -> pd.DataFrame:
    """Example derivation: one item per scope with failing checks."""
    bad = [(r.scope_key, r.scope_key, f'{{"failures": {sum(p["failures"] for p in r.pulls)}}}') for r in rows.itertuples() if any(p["failures"] for p in r.pulls)]
    return pd.DataFrame(bad, columns=["scope_key", "identity_key", "payload"])


@query("f3_derive", f"SELECT scope_key, '{{\"failures\": ' || CAST(failures AS VARCHAR) || '}}' AS payload FROM ({SNAP}) WHERE failures > 0")
def _(spark, sf):
    return dv.derive(_snapshots(spark, sf), _failing).select("scope_key", "payload")


ITEMS = f"SELECT scope_key, CASE WHEN number % 20 = 0 THEN 'dup' ELSE scope_key || ':' || CAST(number AS STRING) END AS identity_key, CASE WHEN number % 7 = 0 THEN 'oops' ELSE '{{}}' END AS payload, CASE WHEN number % 9 = 0 THEN repo_id + 1 ELSE repo_id END AS repo_id, number FROM ({IN_SCOPE})"


@query("f4_validate_results", f"WITH i AS ({ITEMS}), n AS (SELECT identity_key, count(*) AS n FROM i GROUP BY identity_key) SELECT i.scope_key, i.identity_key, CASE WHEN i.repo_id % 5 = 4 AND number % 9 <> 0 THEN 'foreign scope' WHEN number % 9 = 0 AND i.repo_id % 5 = 0 THEN 'foreign scope' WHEN n > 1 THEN 'duplicate identity' WHEN number % 9 = 0 THEN 'wrong repository' ELSE 'payload is not JSON' END AS problem FROM i JOIN n ON n.identity_key = i.identity_key WHERE n > 1 OR number % 9 = 0 OR number % 7 = 0 OR i.repo_id % 5 = 4")
def _(spark, sf):
    scopes = run_sql(spark, sf, DIRTY).where(parse_scope(F.col("scope_key"))["repo_id"] % 5 != 4)
    return dv.validate_results(scopes, run_sql(spark, sf, ITEMS))


OWNERS = f"SELECT identity_key, min(scope_key) AS scope_key FROM ({ITEMS}) WHERE number % 6 = 0 GROUP BY identity_key"


@query("f4_validate_owners", f"WITH i AS ({ITEMS}), w AS ({OWNERS}), d AS (SELECT DISTINCT scope_key FROM ({DIRTY})) SELECT i.scope_key, i.identity_key, 'identity of another scope' AS problem FROM i JOIN w ON w.identity_key = i.identity_key WHERE w.scope_key <> i.scope_key UNION ALL SELECT d.scope_key, NULL, 'no result' FROM d WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.scope_key = d.scope_key)")
def _(spark, sf):
    out = dv.validate_results(run_sql(spark, sf, DIRTY), run_sql(spark, sf, ITEMS), run_sql(spark, sf, OWNERS), complete=True)
    return out.where("problem in ('identity of another scope', 'no result')")


WORK = f"SELECT scope_key || ':w' AS identity_key, scope_key, 'p' || CAST(length(scope_key) AS STRING) AS payload FROM ({DIRTY}) WHERE length(scope_key) % 2 = 0"
DERIVED = f"SELECT scope_key || ':w' AS identity_key, scope_key, CASE WHEN scope_key LIKE '%7' THEN 'new' ELSE 'p' || CAST(length(scope_key) AS STRING) END AS payload FROM ({DIRTY}) WHERE scope_key NOT LIKE '%3' AND scope_key NOT LIKE 'repo:4:%'"


@query("f5_reconcile_items", f"SELECT coalesce(s.identity_key, i.identity_key) AS identity_key, CASE WHEN s.identity_key IS NULL THEN 'inserted' WHEN i.identity_key IS NULL AND s.scope_key NOT LIKE 'repo:4:%' THEN 'removed' WHEN i.identity_key IS NULL THEN 'kept' WHEN s.payload <> i.payload THEN 'updated' ELSE 'kept' END AS change FROM ({WORK}) s FULL JOIN ({DERIVED}) i ON s.identity_key = i.identity_key")
def _(spark, sf):
    claimed = run_sql(spark, sf, DIRTY).where("scope_key not like 'repo:4:%'")
    return dv.reconcile_items(run_sql(spark, sf, WORK), claimed, run_sql(spark, sf, DERIVED)).select("identity_key", "change")


@query("f6_clear_dirty", f"WITH d AS ({DIRTY}) SELECT scope_key FROM d WHERE scope_key LIKE '%5' OR scope_key NOT LIKE '%1'")
def _(spark, sf):
    dirty = run_sql(spark, sf, DIRTY)
    claimed = dirty.where("scope_key like '%5' or scope_key like '%1'").withColumn("marked_at", F.when(F.col("scope_key").endswith("5"), F.col("marked_at") - F.expr("interval 1 day")).otherwise(F.col("marked_at")))
    return dv.clear_dirty(dirty, claimed).select("scope_key")


@query("f7_identity_key", f"SELECT scope_key, CAST(split_part(scope_key, ':', 2) AS BIGINT) AS repo_id, split_part(scope_key, ':', 3) AS kind, CAST(split_part(scope_key, ':', 4) AS BIGINT) AS number FROM ({DIRTY}) WHERE scope_key NOT LIKE '%:stack:0'")
def _(spark, sf):
    return run_sql(spark, sf, DIRTY).select("scope_key", parse_scope(F.col("scope_key")).alias("s")).where("s is not null").select("scope_key", "s.*")
