"""Read models over the mirror."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(df: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Rows without a tombstone, of live repositories."""
    out = df.where("tombstoned_at is null")
    return out if repos is None else out.join(repos.where("tombstoned_at is null").select("repo_id"), "repo_id", "left_semi")


def open_pulls(pulls: DataFrame, limit: int, repo_id: int | None = None) -> DataFrame:
    """Open live pull requests, newest first."""
    out = live(pulls).where("state = 'open'")
    return (out if repo_id is None else out.where(F.col("repo_id") == repo_id)).orderBy(F.desc("gh_updated_at"), "repo_id", "number").limit(limit)


def pull(pulls: DataFrame, number: int, repo_id: int | None = None) -> DataFrame:
    out = live(pulls).where(F.col("number") == number)
    return out if repo_id is None else out.where(F.col("repo_id") == repo_id)


def checks(runs: DataFrame, head_sha: str) -> DataFrame:
    return live(runs).where(F.col("head_sha") == head_sha).orderBy("name", "gh_id")


def stacks(df: DataFrame, repos: DataFrame, now: str, limit: int) -> DataFrame:
    """Stacks of live repositories that are open or still displayed, open ones first."""
    shown = F.col("open") | F.coalesce(F.col("display_until") > F.lit(now).cast("timestamp_ntz"), F.lit(False))
    return live(df, repos).where(shown).orderBy(F.desc("open"), "repo_id", "number").limit(limit)


def numbered(df: DataFrame, repos: DataFrame, wanted: DataFrame) -> DataFrame:
    """Answers to look-ups by number (number, full_name; an empty or missing name stands for any repository): repo_id and whether it was found, is missing, or is ambiguous.

    Of a look-up's matches only their count and least repository are kept, so a number that many repositories use stays one row.
    """
    names = repos.where("tombstoned_at is null").select("repo_id", F.col("full_name").alias("r_name"))
    known = live(df).select("repo_id", "number").join(names, "repo_id")
    any_name = F.coalesce(F.col("full_name"), F.lit("")) == ""
    asked = wanted.select("number", "full_name").distinct()
    wide = known.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.min("repo_id").alias("repo_id"))
    by_number = asked.where(any_name).join(wide, "number", "left")
    narrow = known.groupBy("number", F.col("r_name").alias("full_name")).agg(F.count(F.lit(1)).alias("n"), F.min("repo_id").alias("repo_id"))
    by_name = asked.where(~any_name).join(narrow, ["number", "full_name"], "left")
    answer = F.when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("n") == 1, "found").otherwise("ambiguous")
    return by_number.unionByName(by_name, allowMissingColumns=True).select("number", "full_name", answer.alias("answer"), F.when(F.col("n") == 1, F.col("repo_id")).alias("repo_id"))


def checks_of_heads(runs: DataFrame, repos: DataFrame, heads: DataFrame) -> DataFrame:
    """Live runs of the wanted heads in live repositories, in the order of head, repository, name and identifier."""
    return live(runs, repos).join(heads.select("head_sha").distinct(), "head_sha", "left_semi").orderBy("head_sha", "repo_id", "name", "gh_id")


def by_alias(df: DataFrame, aliases: DataFrame, repos: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of repositories looked up by a current or former name (column full_name); a current name goes before an alias."""
    current = repos.where("tombstoned_at is null").select("full_name", "repo_id", F.lit(0).alias("rank"))
    known = current.unionByName(aliases.select("full_name", "repo_id", F.lit(1).alias("rank")))
    found = names.join(known, "full_name").groupBy("full_name").agg(F.min_by("repo_id", F.struct("rank", "repo_id")).alias("repo_id"))
    return found.join(df, "repo_id")


def review_request_age(requests: DataFrame, pulls: DataFrame, now: Column) -> DataFrame:
    """Current review requests with their age and what it was counted from."""
    p = live(pulls).where("state = 'open'").select("repo_id", F.col("number").alias("pr_number"))
    since = F.coalesce("requested_at", "first_seen_at")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 1_000_000
    return live(requests).join(p, ["repo_id", "pr_number"], "left_semi").withColumns({"age_s": age, "age_source": F.when(F.col("requested_at").isNotNull(), "requested_at").otherwise("first_seen_at")})


def participants(pulls: DataFrame, reviews: DataFrame, threads: DataFrame, comments: DataFrame) -> DataFrame:
    """(repo_id, pr_number, login, role): authors, reviewers, thread commenters, commenters."""
    parts = [
        live(pulls).select("repo_id", F.col("number").alias("pr_number"), F.col("author_login").alias("login"), F.lit("author").alias("role")),
        live(reviews).select("repo_id", "pr_number", F.col("author_login").alias("login"), F.lit("reviewer").alias("role")),
        live(threads).select("repo_id", "pr_number", F.explode("comments").alias("c")).select("repo_id", "pr_number", F.col("c.author_login").alias("login"), F.lit("thread").alias("role")),
        live(comments).select("repo_id", "pr_number", F.col("author_login").alias("login"), F.lit("commenter").alias("role")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.where("login is not null and login <> ''").distinct()


def diff_owners(pulls: DataFrame, snapshots: DataFrame, files: DataFrame, owners: DataFrame) -> DataFrame:
    """Changed files of current heads with their owners; files without one keep a row."""
    at = ["repo_id", "pr_number", "head_sha", "base_sha"]
    p = live(pulls).select("repo_id", F.col("number").alias("pr_number"), "head_sha", "base_sha")
    current = p.join(snapshots.select(*at), at, "left_semi").join(files.select(*at, "path", "change_type"), at)
    return current.join(owners.select(*at, "path", "owner_token", "owner_type"), [*at, "path"], "left")


def current_facts(children: DataFrame, pulls: DataFrame) -> DataFrame:
    """Live children that belong to the head that their pull request has now."""
    p = live(pulls).select("repo_id", F.col("number").alias("pr_number"), "head_sha")
    return live(children).join(p, ["repo_id", "pr_number", "head_sha"], "left_semi")


def reuse_metadata(pulls: DataFrame, runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per live pull request: its etag, the etag of its head's most lately checked run, whether a drift finding is open."""
    newest = live(runs).groupBy("repo_id", "head_sha").agg(F.max_by("etag", F.struct("last_checked_at", "gh_id")).alias("checks_etag"))
    open_ = findings.where("resolved_at is null").select("repo_id", "number").distinct().withColumn("drift_open", F.lit(True))
    out = live(pulls).join(newest, ["repo_id", "head_sha"], "left").join(open_, ["repo_id", "number"], "left")
    return out.select("repo_id", "number", "etag", "checks_etag", F.coalesce("drift_open", F.lit(False)).alias("drift_open"))
