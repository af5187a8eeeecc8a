"""Queries on drift between cache and source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fx, run_sql
from ..operators import drift as d
from .registry import query

UP = "SELECT repo_id, CASE WHEN number % 53 = 0 THEN number + 900000000 ELSE number END AS number, CASE WHEN number % 13 = 0 THEN title || ' *' ELSE title END AS title, CASE WHEN number % 19 = 0 THEN 'closed' ELSE state END AS state, CASE WHEN number % 26 = 0 THEN NULL ELSE head_sha END AS head_sha FROM fx_pulls WHERE number % 17 <> 0"
FIELDS = ["title", "state", "head_sha"]
PARTS = {
    "pull_request": "SELECT number AS source_id, 'pr:' || CAST(repo_id AS STRING) || ':' || CAST(number AS STRING) AS entity_key, last_checked_at AS freshness, title, state, tombstoned_at FROM fx_pulls",
    "repository": "SELECT gh_id AS source_id, 'repo:' || CAST(repo_id AS STRING) AS entity_key, TIMESTAMP '2001-01-01 00:00:00' AS freshness, full_name, default_branch, tombstoned_at FROM fx_repos",
    "checks": "SELECT DISTINCT gh_id AS source_id, 'check:' || CAST(gh_id AS STRING) AS entity_key, TIMESTAMP '2001-01-01 00:00:00' AS freshness, name FROM fx_check_observations",
}


def parts(spark, sf):
    return {k: run_sql(spark, sf, s) for k, s in PARTS.items()}


KEYS = " UNION ALL ".join(f"SELECT '{k}' AS entity_kind, source_id, entity_key FROM ({s}){'' if k == 'checks' else ' WHERE tombstoned_at IS NULL'}" for k, s in PARTS.items())


@query("i1_drift_entities", f"SELECT 'pull_request' AS entity_kind, entity_key, '{{\"state\":\"' || state || '\",\"title\":\"' || title || '\"}}' AS document FROM ({PARTS['pull_request']}) WHERE tombstoned_at IS NULL UNION ALL SELECT 'repository', entity_key, '{{\"default_branch\":\"' || default_branch || '\",\"full_name\":\"' || full_name || '\"}}' FROM ({PARTS['repository']}) WHERE tombstoned_at IS NULL UNION ALL SELECT 'checks', entity_key, '{{\"name\":\"' || name || '\"}}' FROM ({PARTS['checks']})")
def _(spark, sf):
    return d.drift_entities(parts(spark, sf)).select("entity_kind", "entity_key", "document")


FACTS = "SELECT repo_id, number AS pr_number, CASE WHEN number % 4 = 0 THEN 'old' ELSE head_sha END AS head_sha, 'c' || CAST(number AS STRING) AS item FROM fx_pulls UNION ALL SELECT repo_id, number, head_sha, 'a' FROM fx_pulls WHERE number % 3 = 0"


@query("i2_fence_children", f"SELECT p.repo_id, p.number, string_agg(f.item, ',' ORDER BY f.item) AS items FROM fx_pulls p LEFT JOIN ({FACTS}) f ON f.repo_id = p.repo_id AND f.pr_number = p.number AND f.head_sha = p.head_sha GROUP BY p.repo_id, p.number")
def _(spark, sf):
    return d.fence_children(fx(spark, sf, "pulls"), run_sql(spark, sf, FACTS)).select("repo_id", "number", F.array_join("items", ",").alias("items"))


@query("i3_drift_keys", KEYS)
def _(spark, sf):
    return d.drift_keys(parts(spark, sf)).select("entity_kind", "source_id", "entity_key")


@query("i4_rotating_sample", f"WITH k AS ({KEYS}), r AS (SELECT *, row_number() OVER (PARTITION BY entity_kind ORDER BY source_id <= CASE entity_kind WHEN 'checks' THEN 700 WHEN 'pull_request' THEN 1490 ELSE 1010 END, source_id) AS n FROM k) SELECT entity_kind, source_id, entity_key FROM r WHERE n <= CASE entity_kind WHEN 'repository' THEN 16 ELSE 17 END")
def _(spark, sf):
    return d.rotating_sample(d.drift_keys(parts(spark, sf)), {"checks": 700, "pull_request": 1490, "repository": 1010}, 50).select("entity_kind", "source_id", "entity_key")


RAW = "SELECT number, repo_id, state, merged, CASE WHEN number % 3 = 0 THEN 'dirty' WHEN number % 3 = 1 THEN 'CLEAN' END AS mergeable_state, CASE WHEN number % 2 = 0 THEN 'APPROVED' ELSE 'odd' END AS review_decision FROM fx_pulls"


@query("i5_canonical_pull", "SELECT number, CASE WHEN merged THEN 'merged' ELSE state END AS state, CASE number % 3 WHEN 0 THEN 'conflicting' WHEN 1 THEN 'mergeable' ELSE 'unknown' END AS mergeable_state, CASE WHEN number % 2 = 0 THEN 'approved' ELSE 'other' END AS review_decision FROM fx_pulls")
def _(spark, sf):
    return d.canonical_pull(run_sql(spark, sf, RAW)).select("number", "state", "mergeable_state", "review_decision")


@query("i6_normalize", "SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN string_agg(role, ',' ORDER BY turn) ELSE string_agg(role, ',' ORDER BY role, turn) END AS roles FROM conversations GROUP BY conv_id")
def _(spark, sf):
    c = run_sql(spark, sf, "SELECT conv_id, turn, role FROM conversations")
    item = F.struct(F.col("role").alias("kind"), F.when(F.col("role") != "system", F.col("turn")).alias("identity"), F.col("turn").alias("t"))
    by_turn = F.array_sort(F.collect_list(F.struct("turn", item.alias("i"))))["i"]
    return c.groupBy("conv_id").agg(by_turn.alias("items")).select("conv_id", F.array_join(d.normalize(F.col("items"))["kind"], ",").alias("roles"))


DIFF = f"""SELECT coalesce(c.repo_id, u.repo_id) AS repo_id, coalesce(c.number, u.number) AS number, '' AS path, CASE WHEN c.number IS NULL THEN 'missing' ELSE 'present' END AS cache_value, CASE WHEN u.number IS NULL THEN 'missing' ELSE 'present' END AS upstream_value FROM fx_pulls c FULL JOIN ({UP}) u ON u.repo_id = c.repo_id AND u.number = c.number WHERE c.number IS NULL OR u.number IS NULL
""" + "".join(f" UNION ALL SELECT c.repo_id, c.number, '{f}', c.{f}, u.{f} FROM fx_pulls c JOIN ({UP}) u ON u.repo_id = c.repo_id AND u.number = c.number WHERE c.{f} IS DISTINCT FROM u.{f}" for f in FIELDS)


def _diff(spark, sf):
    return d.semantic_diff(fx(spark, sf, "pulls"), run_sql(spark, sf, UP), ["repo_id", "number"], FIELDS)


@query("i7_semantic_diff", DIFF)
def _(spark, sf):
    return _diff(spark, sf)


# nested documents of which some leaves differ, with a name that holds a dot, items in another order and items that repeat an identity
DOCUMENT = """SELECT number, '{"title":"' || title || '","head":{"ref":"' || head_ref || '","sha":"' || {sha} || '"},"head.ref":' || {dotted} || ',"reviews":[' || {reviews} || '],"labels":[{"identity":"l","v":1},{"identity":"l","v":' || {label} || '}],"tail":[1' || {tail} || ']}' AS document FROM fx_pulls WHERE {some}"""


def _document(**parts: str) -> str:
    out = DOCUMENT
    for name, text in parts.items():
        out = out.replace("{" + name + "}", text)
    return out


HERE = _document(sha="head_sha", dotted="'1'", reviews="""'{"identity":"p","v":1},{"identity":"q","v":[]}'""", label="'2'", tail="',2'", some="number % 19 <> 0")
THERE = _document(
    sha="CASE WHEN number % 7 = 0 THEN 'moved' ELSE head_sha END", dotted="CASE WHEN number % 3 = 0 THEN '{\"x\":true}' ELSE '1' END",
    reviews="""CASE WHEN number % 5 = 0 THEN '{"identity":"q","v":[]},{"identity":"p","v":1}' ELSE '{"identity":"q","v":[[3]]},{"identity":"p","v":1}' END""",
    label="CASE WHEN number % 4 = 0 THEN '3' ELSE '2' END", tail="CASE WHEN number % 11 = 0 THEN '' ELSE ',2' END", some="number % 17 <> 0",
)
BOTH = "SELECT number, head_sha FROM fx_pulls WHERE number % 19 <> 0 AND number % 17 <> 0"


@query(
    "i7_document_diff",
    f"""WITH b AS ({BOTH})
SELECT number, '' AS path, CASE WHEN number % 19 <> 0 THEN 'present' END AS cache_value, CASE WHEN number % 17 <> 0 THEN 'present' END AS upstream_value FROM fx_pulls WHERE (number % 19 = 0) <> (number % 17 = 0)
UNION ALL SELECT number, 'head.sha', '"' || head_sha || '"', '"moved"' FROM b WHERE number % 7 = 0
UNION ALL SELECT number, '["head.ref"]', '1', NULL FROM b WHERE number % 3 = 0
UNION ALL SELECT number, '["head.ref"].x', NULL, 'true' FROM b WHERE number % 3 = 0
UNION ALL SELECT number, 'reviews[q].v', '[]', NULL FROM b WHERE number % 5 <> 0
UNION ALL SELECT number, 'reviews[q].v[0][0]', NULL, '3' FROM b WHERE number % 5 <> 0
UNION ALL SELECT number, 'labels[l#1].v', '2', '3' FROM b WHERE number % 4 = 0
UNION ALL SELECT number, 'tail[1]', '2', NULL FROM b WHERE number % 11 = 0""",
)
def _(spark, sf):
    return d.document_diff(run_sql(spark, sf, HERE), run_sql(spark, sf, THERE), ["number"])


STATE = "SELECT 'k' || CAST(number AS STRING) AS entity_key, CASE WHEN number % 2 = 0 THEN 'h' ELSE 'g' END AS diff_hash, CAST(1 AS BIGINT) AS occurrence_count, number % 3 = 0 AS heal_completed, gh_updated_at AS first_seen_at, CASE WHEN number % 5 = 0 THEN gh_updated_at END AS resolved_at FROM fx_pulls"
FOUND = "SELECT 'k' || CAST(number AS STRING) AS entity_key, CASE WHEN number % 4 = 0 THEN 'new' ELSE 'h' END AS diff_hash FROM fx_pulls WHERE number % 7 > 0"
CHECKED = "SELECT 'k' || CAST(number AS STRING) AS entity_key FROM fx_pulls WHERE number % 8 > 0"


@query("i8_merge_findings", f"SELECT coalesce(s.entity_key, f.entity_key) AS entity_key, coalesce(s.diff_hash, f.diff_hash) AS diff_hash, CASE WHEN f.entity_key IS NOT NULL AND (s.entity_key IS NULL OR s.resolved_at IS NOT NULL) THEN 1 WHEN f.entity_key IS NOT NULL AND heal_completed THEN 2 ELSE 1 END AS occurrence_count, CASE WHEN f.entity_key IS NOT NULL AND (s.entity_key IS NULL OR s.resolved_at IS NOT NULL) THEN 'opened' WHEN f.entity_key IS NOT NULL AND heal_completed THEN 'escalated' WHEN f.entity_key IS NOT NULL THEN 'touched' WHEN s.resolved_at IS NULL AND c.entity_key IS NOT NULL THEN 'resolved' ELSE 'kept' END AS change FROM ({STATE}) s FULL JOIN ({FOUND}) f ON f.entity_key = s.entity_key AND f.diff_hash = s.diff_hash LEFT JOIN ({CHECKED}) c ON c.entity_key = coalesce(s.entity_key, f.entity_key)")
def _(spark, sf):
    out = d.merge_findings(run_sql(spark, sf, STATE), run_sql(spark, sf, FOUND), run_sql(spark, sf, CHECKED), "2001-12-01 00:00:00")
    return out.select("entity_key", "diff_hash", "occurrence_count", "change")


@query("i9_exclude_in_flight", "SELECT refresh_key FROM fx_generations WHERE NOT completed_generation < generation")
def _(spark, sf):
    g = fx(spark, sf, "generations")
    return d.exclude_in_flight(g.select("refresh_key"), g)


@query("i10_convergence", f"SELECT 'pulls' AS family, count(c.number) AS cached, count(u.number) AS expected, count(*) FILTER (WHERE c.number IS NULL) AS missing, count(*) FILTER (WHERE u.number IS NULL) AS extra, count(*) FILTER (WHERE c.number IS NOT NULL AND u.number IS NOT NULL AND (c.title IS DISTINCT FROM u.title OR c.state IS DISTINCT FROM u.state OR c.head_sha IS DISTINCT FROM u.head_sha)) AS differing FROM fx_pulls c FULL JOIN ({UP}) u ON u.repo_id = c.repo_id AND u.number = c.number UNION ALL SELECT 'repos', count(*), count(*) FILTER (WHERE gh_id % 6 > 0), 0, count(*) FILTER (WHERE gh_id % 6 = 0), count(*) FILTER (WHERE gh_id % 6 > 0 AND gh_id % 4 = 0) FROM fx_repos")
def _(spark, sf):
    repos = fx(spark, sf, "repos")
    truth = repos.where("gh_id % 6 > 0").withColumn("name", F.when(F.col("gh_id") % 4 == 0, "x").otherwise(F.col("name")))
    return d.convergence_report({"pulls": (fx(spark, sf, "pulls"), run_sql(spark, sf, UP), ["repo_id", "number"], FIELDS), "repos": (repos, truth, ["gh_id"], ["name"])})


@query("i11_coverage", "WITH p AS (SELECT repo_id, count(*) AS n FROM fx_pulls GROUP BY repo_id), t AS (SELECT repo_id, count(*) AS n FROM fx_thread_comments WHERE repo_id % 4 > 0 GROUP BY repo_id) SELECT r.repo_id, coalesce(p.n, 0) AS pulls, coalesce(t.n, 0) AS threads, coalesce(p.n, 0) > 0 AND coalesce(t.n, 0) > 0 AS covered FROM fx_repos r LEFT JOIN p ON p.repo_id = r.repo_id LEFT JOIN t ON t.repo_id = r.repo_id")
def _(spark, sf):
    return d.coverage(fx(spark, sf, "repos"), {"pulls": fx(spark, sf, "pulls"), "threads": fx(spark, sf, "thread_comments").where("repo_id % 4 > 0")})
