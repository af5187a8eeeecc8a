"""Queries on read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import PULL_NOW, fx, run_sql
from ..operators import reads as r
from .registry import query


@query("l1_open_pulls", "SELECT repo_id, number, title FROM fx_pulls WHERE tombstoned_at IS NULL AND state = 'open' ORDER BY gh_updated_at DESC, repo_id, number LIMIT 100")
def _(spark, sf):
    return r.open_pulls(fx(spark, sf, "pulls"), 100).select("repo_id", "number", "title")


ALIAS = "SELECT 'acme/former_' || CAST(repo_id AS STRING) AS full_name, repo_id FROM fx_repos UNION ALL SELECT 'acme/france', 1"


@query("l2_by_alias", "SELECT 'acme/former_' || CAST(repo_id AS STRING) AS full_name, number FROM fx_pulls WHERE repo_id % 2 = 0 UNION ALL SELECT 'acme/france', p.number FROM fx_pulls p JOIN (SELECT coalesce((SELECT repo_id FROM fx_repos WHERE full_name = 'acme/france' AND tombstoned_at IS NULL), 1) AS repo_id) f ON f.repo_id = p.repo_id")
def _(spark, sf):
    names = run_sql(spark, sf, "SELECT 'acme/former_' || CAST(repo_id AS STRING) AS full_name FROM fx_repos WHERE repo_id % 2 = 0 UNION ALL SELECT 'acme/france'")
    return r.by_alias(fx(spark, sf, "pulls"), run_sql(spark, sf, ALIAS), fx(spark, sf, "repos"), names).select("full_name", "number")


REQ = "SELECT repo_id, number AS pr_number, author_login, CASE WHEN number % 3 = 0 THEN gh_updated_at + INTERVAL 1 DAY END AS requested_at, gh_updated_at AS first_seen_at, tombstoned_at FROM fx_pulls"


@query("l3_review_request_age", f"SELECT q.repo_id, q.pr_number, (epoch_us(TIMESTAMP '{PULL_NOW}') - epoch_us(coalesce(q.requested_at, q.first_seen_at))) / 1000000.0 AS age_s, CASE WHEN q.requested_at IS NULL THEN 'first_seen_at' ELSE 'requested_at' END AS age_source FROM ({REQ}) q JOIN fx_pulls p ON p.repo_id = q.repo_id AND p.number = q.pr_number WHERE q.tombstoned_at IS NULL AND p.tombstoned_at IS NULL AND p.state = 'open'")
def _(spark, sf):
    now = F.lit(PULL_NOW).cast("timestamp_ntz")
    return r.review_request_age(run_sql(spark, sf, REQ), fx(spark, sf, "pulls"), now).select("repo_id", "pr_number", "age_s", "age_source")


REVIEWS = "SELECT repo_id, number AS pr_number, 'r' || CAST(number % 9 AS STRING) AS author_login, tombstoned_at FROM fx_pulls"
COMM = "SELECT repo_id, number AS pr_number, CASE WHEN number % 4 = 0 THEN '' ELSE 'c' || CAST(number % 5 AS STRING) END AS author_login, tombstoned_at FROM fx_pulls"


@query("l4_participants", f"SELECT repo_id, number AS pr_number, author_login AS login, 'author' AS role FROM fx_pulls WHERE tombstoned_at IS NULL UNION SELECT repo_id, pr_number, author_login, 'reviewer' FROM ({REVIEWS}) WHERE tombstoned_at IS NULL UNION SELECT repo_id, pr_number, author_login, 'thread' FROM fx_thread_comments WHERE author_login <> '' UNION SELECT repo_id, pr_number, author_login, 'commenter' FROM ({COMM}) WHERE tombstoned_at IS NULL AND author_login <> ''")
def _(spark, sf):
    threads = fx(spark, sf, "thread_comments").groupBy("repo_id", "pr_number", "thread_id").agg(F.collect_list(F.struct("author_login")).alias("comments")).withColumn("tombstoned_at", F.lit(None).cast("timestamp_ntz"))
    return r.participants(fx(spark, sf, "pulls"), run_sql(spark, sf, REVIEWS), threads, run_sql(spark, sf, COMM))


FILES = "SELECT DISTINCT f.repo_id, f.pr_number, p.head_sha, p.base_sha, f.path, f.change_type FROM fx_changed_files f JOIN fx_pulls p ON p.number = f.pr_number"
SNAPS = "SELECT DISTINCT p.repo_id, p.number AS pr_number, CASE WHEN p.number % 6 = 0 THEN 'old' ELSE p.head_sha END AS head_sha, p.base_sha FROM fx_pulls p"
OWN = f"SELECT repo_id, pr_number, head_sha, base_sha, path, '@acme/t' || CAST(pr_number % 3 AS STRING) AS owner_token, 'team' AS owner_type FROM ({FILES}) WHERE pr_number % 5 > 0"


@query("l5_diff_owners", f"SELECT f.repo_id, f.pr_number, f.path, f.change_type, o.owner_token FROM ({FILES}) f JOIN fx_pulls p ON p.repo_id = f.repo_id AND p.number = f.pr_number AND p.head_sha = f.head_sha AND p.base_sha = f.base_sha JOIN ({SNAPS}) s ON s.repo_id = f.repo_id AND s.pr_number = f.pr_number AND s.head_sha = f.head_sha AND s.base_sha = f.base_sha LEFT JOIN ({OWN}) o ON o.repo_id = f.repo_id AND o.pr_number = f.pr_number AND o.path = f.path AND o.head_sha = f.head_sha AND o.base_sha = f.base_sha WHERE p.tombstoned_at IS NULL")
def _(spark, sf):
    return r.diff_owners(fx(spark, sf, "pulls"), run_sql(spark, sf, SNAPS), run_sql(spark, sf, FILES), run_sql(spark, sf, OWN)).select("repo_id", "pr_number", "path", "change_type", "owner_token")


FACTS = "SELECT repo_id, number AS pr_number, CASE WHEN number % 4 = 0 THEN 'old' ELSE head_sha END AS head_sha, CASE WHEN number % 10 = 0 THEN gh_updated_at END AS tombstoned_at FROM fx_pulls"


@query("l6_current_facts", "SELECT repo_id, number AS pr_number FROM fx_pulls WHERE number % 4 <> 0 AND number % 10 <> 0 AND tombstoned_at IS NULL")
def _(spark, sf):
    return r.current_facts(run_sql(spark, sf, FACTS), fx(spark, sf, "pulls")).select("repo_id", "pr_number")


RUNS = "SELECT gh_id, repo_id, head_sha, 'e' || CAST(max(tie) AS STRING) AS etag, max(observed_at) AS last_checked_at, CAST(NULL AS TIMESTAMP) AS tombstoned_at FROM fx_check_observations GROUP BY gh_id, repo_id, head_sha"
OPEN = "SELECT repo_id, number, CASE WHEN number % 2 = 0 THEN gh_updated_at END AS resolved_at FROM fx_pulls WHERE number % 3 = 0"


@query("l7_reuse_metadata", f"SELECT p.repo_id, p.number, 'p' || CAST(p.number AS STRING) AS etag, n.etag AS checks_etag, p.number % 3 = 0 AND p.number % 2 = 1 AS drift_open FROM fx_pulls p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, head_sha ORDER BY last_checked_at DESC, gh_id DESC) AS k FROM ({RUNS})) WHERE k = 1) n ON n.repo_id = p.repo_id AND n.head_sha = p.head_sha WHERE p.tombstoned_at IS NULL")
def _(spark, sf):
    pulls = run_sql(spark, sf, "SELECT *, 'p' || CAST(number AS STRING) AS etag FROM fx_pulls")
    return r.reuse_metadata(pulls, run_sql(spark, sf, RUNS), run_sql(spark, sf, OPEN))


STACKED = "SELECT repo_id, CAST(floor((number - 1) / 5) AS BIGINT) % 40 AS number, max(state = 'open') AS open, CASE WHEN max(number) % 2 = 0 THEN max(gh_updated_at) + INTERVAL 1000 DAY END AS display_until, CASE WHEN max(number) % 9 = 0 THEN max(gh_updated_at) END AS tombstoned_at FROM fx_pulls GROUP BY repo_id, CAST(floor((number - 1) / 5) AS BIGINT) % 40"
ASKED = "SELECT number % 45 AS number, CASE WHEN number % 3 = 0 THEN '' ELSE 'acme/' || CASE WHEN number % 3 = 1 THEN 'france' ELSE 'nowhere' END END AS full_name FROM fx_pulls"
NAMES = "SELECT s.repo_id, s.number, r.full_name FROM ({0}) s JOIN fx_repos r ON r.repo_id = s.repo_id WHERE s.tombstoned_at IS NULL AND r.tombstoned_at IS NULL"


def _answers(asked: str, table: str) -> str:
    return f"SELECT a.number, a.full_name, CASE count(k.repo_id) WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS answer, CASE WHEN count(k.repo_id) = 1 THEN min(k.repo_id) END AS repo_id FROM (SELECT DISTINCT number, full_name FROM ({asked})) a LEFT JOIN ({NAMES.format(table)}) k ON k.number = a.number AND (a.full_name = '' OR a.full_name = k.full_name) GROUP BY a.number, a.full_name"


@query("l1_stacks", f"SELECT repo_id, number, open FROM ({STACKED}) WHERE tombstoned_at IS NULL AND repo_id IN (SELECT repo_id FROM fx_repos WHERE tombstoned_at IS NULL) AND (open OR display_until > TIMESTAMP '{PULL_NOW}') ORDER BY open DESC, repo_id, number LIMIT 100")
def _(spark, sf):
    stacked = run_sql(spark, sf, STACKED)
    return r.stacks(stacked, fx(spark, sf, "repos"), PULL_NOW, 100).select("repo_id", "number", "open")


@query("l1_stack_by_number", _answers(ASKED, STACKED))
def _(spark, sf):
    return r.numbered(run_sql(spark, sf, STACKED), fx(spark, sf, "repos"), run_sql(spark, sf, ASKED))


PULL_NAMES = "SELECT p.number + CASE WHEN p.number % 10 = 0 THEN 900000000 ELSE 0 END AS number, CASE WHEN p.number % 4 = 0 THEN '' ELSE r.full_name END AS full_name FROM fx_pulls p JOIN fx_repos r ON r.repo_id = p.repo_id"


@query("l1_pull_by_number", _answers(PULL_NAMES, "SELECT * FROM fx_pulls"))
def _(spark, sf):
    return r.numbered(fx(spark, sf, "pulls"), fx(spark, sf, "repos"), run_sql(spark, sf, PULL_NAMES))


NAMED_RUNS = "SELECT gh_id, repo_id, head_sha, max(name) AS name, CASE WHEN gh_id % 10 = 2 THEN max(observed_at) END AS tombstoned_at FROM fx_check_observations GROUP BY gh_id, repo_id, head_sha"


@query("l1_checks_of_heads", f"SELECT head_sha, repo_id, name, gh_id FROM ({NAMED_RUNS}) WHERE tombstoned_at IS NULL AND repo_id IN (SELECT repo_id FROM fx_repos WHERE tombstoned_at IS NULL) AND head_sha IN (SELECT head_sha FROM fx_pulls WHERE state = 'open')")
def _(spark, sf):
    heads = fx(spark, sf, "pulls").where("state = 'open'")
    return r.checks_of_heads(run_sql(spark, sf, NAMED_RUNS), fx(spark, sf, "repos"), heads).select("head_sha", "repo_id", "name", "gh_id")
