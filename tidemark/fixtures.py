"""Inputs for the registered queries, derived from the given tables in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The fixed clocks of delivery queries and of queries on pull requests.
NOW, PULL_NOW = "2024-02-01 00:00:00", "2001-12-01 00:00:00"

FX: dict[str, str] = {
    "repos": """
SELECT CAST(n_nationkey AS BIGINT) AS repo_id, CAST(n_nationkey AS BIGINT) + 1000 AS gh_id, 'acme' AS owner, lower(n_name) AS name,
       'acme/' || lower(n_name) AS full_name, 'main' AS default_branch, n_regionkey = 4 AS archived,
       md5('r' || CAST(n_nationkey AS STRING)) AS head_sha, CASE WHEN n_nationkey % 7 = 6 THEN TIMESTAMP '2001-06-01 00:00:00' END AS tombstoned_at
FROM nation""",
    "deliveries": """
SELECT 'g-' || CAST(CASE WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END AS STRING) AS delivery_guid,
       CASE event_type WHEN 'view' THEN 'pull_request' WHEN 'click' THEN 'check_run' WHEN 'error' THEN 'push' WHEN 'signup' THEN 'pull_request_review' ELSE 'issue_comment' END AS event,
       CASE WHEN event_id % 3 = 0 THEN 'opened' WHEN event_id % 3 = 1 THEN 'synchronize' ELSE 'closed' END AS action,
       'acme/nation_' || CAST(user_id % 25 AS STRING) AS repo, user_id + 1 AS number, md5('h' || CAST(user_id AS STRING)) AS head_sha,
       'refs/heads/b' || CAST(user_id AS STRING) AS ref, event_id % 4 = 0 AS issue_is_pr,
       CASE WHEN event_id % 50 = 7 THEN 'parked' WHEN event_id % 20 = 3 THEN 'pending' ELSE 'processed' END AS status,
       CAST(event_id % 6 AS INT) AS attempts, ts AS received_at, event_id AS arrival
FROM events""",
    "pulls": """
SELECT CAST(floor(o_orderkey / 5) AS BIGINT) % 25 AS repo_id, o_orderkey + 1 AS number, o_orderkey + 500000 AS gh_id, 'PR ' || o_orderpriority AS title,
       CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state, o_orderstatus = 'P' AS merged, 'u' || CAST(o_custkey AS STRING) AS author_login,
       'b' || CAST(o_orderkey AS STRING) AS head_ref, md5('h' || CAST(o_orderkey AS STRING)) AS head_sha,
       CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN 'main' ELSE 'b' || CAST(o_orderkey - 1 AS STRING) END AS base_ref,
       CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN md5('main') WHEN o_orderkey % 7 = 0 THEN '' ELSE md5('h' || CAST(o_orderkey - 1 AS STRING)) END AS base_sha,
       o_orderdate AS gh_updated_at, o_orderdate AS last_checked_at, CASE WHEN o_orderkey % 97 = 0 THEN o_orderdate END AS tombstoned_at
FROM orders""",
    "check_observations": """
SELECT l_orderkey * 10 + l_linenumber AS gh_id, CAST(floor(l_orderkey / 5) AS BIGINT) % 25 AS repo_id, md5('h' || CAST(l_orderkey AS STRING)) AS head_sha,
       'check-' || CAST(l_linenumber AS STRING) AS name, CASE WHEN l_linestatus = 'O' THEN 'in_progress' ELSE 'completed' END AS status,
       CASE l_returnflag WHEN 'R' THEN 'failure' WHEN 'A' THEN 'success' ELSE 'neutral' END AS conclusion,
       CASE WHEN l_partkey % 31 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE CAST(l_shipdate AS TIMESTAMP) END AS gh_updated_at,
       CAST(l_shipdate AS TIMESTAMP) AS observed_at, l_partkey AS tie
FROM lineitem""",
    "change_events": """
SELECT event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 'work_items' ELSE 'entities' END AS stream,
       CASE event_type WHEN 'view' THEN 'pull_request.changed' WHEN 'click' THEN 'checks.changed' WHEN 'signup' THEN 'stack.changed' WHEN 'purchase' THEN 'pull_request.tombstoned' ELSE 'work_item.changed' END AS kind,
       'pr:1:' || CAST(1000 + user_id % 25 AS STRING) || ':' || CAST(user_id + 1 AS STRING) AS entity_key, ts AS occurred_at, event_id % 9001 <> 9000 AS committed
FROM events""",
    "changed_files": """
SELECT page_id % 25 AS repo_id, page_id + 1 AS pr_number, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path,
       CASE WHEN page_id % 4 = 0 THEN 'renamed' WHEN page_id % 4 = 1 THEN 'added' ELSE 'modified' END AS change_type,
       CASE WHEN page_id % 8 = 0 THEN 'old/' || CAST(page_id AS STRING) END AS previous_path
FROM pages""",
    "thread_comments": """
SELECT conv_id AS thread_id, conv_id % 25 AS repo_id, conv_id + 1 AS pr_number, turn AS position, CASE WHEN role = 'system' THEN '' ELSE role END AS author_login,
       CAST(length(text) AS INT) AS body_chars
FROM conversations""",
    "consumers": """
SELECT s_name AS consumer, CASE WHEN s_suppkey % 2 = 0 THEN 'entities' ELSE 'work_items' END AS stream, s_suppkey * 90 AS cursor_seq
FROM supplier""",
    # second observations of the same pull requests: some newer, some older, some equal with another title, some new
    "pull_batch": """
SELECT repo_id, CASE WHEN number % 41 = 0 THEN number + 900000000 ELSE number END AS number, gh_id, CASE WHEN number % 13 = 0 THEN title || ' *' ELSE title END AS title,
       CASE WHEN number % 6 = 0 THEN 'closed' ELSE state END AS state, merged, author_login, head_ref,
       CASE WHEN number % 8 = 0 THEN '' ELSE head_sha END AS head_sha, base_ref, base_sha,
       CASE WHEN number % 3 = 0 THEN gh_updated_at + INTERVAL 1 DAY WHEN number % 5 = 0 THEN gh_updated_at - INTERVAL 1 DAY WHEN number % 29 = 0 THEN NULL ELSE gh_updated_at END AS gh_updated_at,
       last_checked_at + INTERVAL 2 DAY AS last_checked_at, number % 2 = 0 AS membership_known, CASE WHEN number % 4 = 0 THEN '' ELSE 'e' || CAST(number AS STRING) END AS etag
FROM fx_pulls WHERE number % 17 <> 0""",
    "generations": """
SELECT 'refresh_pr' AS kind, 'pr:' || repo || ':' || CAST(number AS STRING) AS refresh_key, count(*) AS generation,
       CASE WHEN number % 3 = 0 THEN count(*) ELSE count(*) - 1 END AS completed_generation, min(received_at) AS event_received_at, max(received_at) AS updated_at
FROM fx_deliveries GROUP BY repo, number""",
}

_NEEDS = re.compile(r"\b(?:FROM|JOIN)\s+(\w+)")


def closure(names: list[str]) -> list[str]:
    """``names`` with the fixtures they read, those read first."""
    out: list[str] = []

    def visit(name: str) -> None:
        for found in _NEEDS.findall(FX[name]):
            if found.startswith("fx_"):
                visit(found[3:])
        if name not in out:
            out.append(name)

    for name in names:
        visit(name)
    return out


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark SQL over the given tables and the fixtures that it names as ``fx_...``."""
    named = closure([n[3:] for n in sorted(set(re.findall(r"\bfx_\w+", sql)))])
    ctes = [f"fx_{n} AS ({FX[n]})" for n in named]
    text = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet` AS {m[2]}", with_ctes(ctes, sql))
    return spark.sql(text)


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"SELECT * FROM fx_{name}")


def with_ctes(ctes: list[str], sql: str) -> str:
    sql = sql.strip()
    if not ctes:
        return sql
    if re.match(r"WITH\s+RECURSIVE\s", sql):
        return f"WITH RECURSIVE {', '.join(ctes)}, {sql.split('RECURSIVE', 1)[1].lstrip()}"
    if re.match(r"WITH\s", sql):
        return f"WITH {', '.join(ctes)}, {sql[4:].lstrip()}"
    return f"WITH {', '.join(ctes)} {sql}"


def duck_sql(sql: str) -> str:
    """The same text for DuckDB."""
    named = closure([n[3:] for n in sorted(set(re.findall(r"\bfx_\w+", sql)))])
    return with_ctes([f"fx_{n} AS ({FX[n]})" for n in named], sql)
