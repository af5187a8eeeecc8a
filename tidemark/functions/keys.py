"""Key grammars: public event keys, refresh keys and scope keys are three namespaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _join(*parts: Column | str) -> Column:
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def pr_event_key(installation: Column, repo_gh_id: Column, number: Column) -> Column:
    return _join("pr", installation, repo_gh_id, number)


def stack_event_key(installation: Column, repo_gh_id: Column, number: Column) -> Column:
    return _join("stack", installation, repo_gh_id, number)


def repo_event_key(installation: Column, repo_gh_id: Column) -> Column:
    return _join("repo", installation, repo_gh_id)


def checks_event_key(installation: Column, repo_gh_id: Column, head_sha: Column) -> Column:
    return _join("checks", installation, repo_gh_id, head_sha)


def pr_refresh_key(full_name: Column, number: Column) -> Column:
    return _join("pr", full_name, number)


def stack_refresh_key(full_name: Column, number: Column) -> Column:
    return _join("stack", full_name, number)


def checks_refresh_key(full_name: Column, head_sha: Column) -> Column:
    return _join("checks", full_name, head_sha)


def branch_refresh_key(full_name: Column, branch: Column) -> Column:
    return _join("branch", full_name, branch)


def scope_key(repo_id: Column, stack_number: Column, number: Column) -> Column:
    """The derivation scope of a pull request: its stack if it has one, else itself."""
    return F.when(stack_number.isNotNull(), _join("repo", repo_id, "stack", stack_number)).otherwise(_join("repo", repo_id, "pr", number))


def parse_scope(key: Column) -> Column:
    """(repo_id, kind, number) of a scope key; null if it isn't one."""
    parts = F.split(key, ":")
    good = key.rlike(r"^repo:[1-9][0-9]*:(stack|pr):[1-9][0-9]*$") | key.rlike(r"^repo:0:(stack|pr):[1-9][0-9]*$")
    return F.when(good, F.struct(parts[1].cast("long").alias("repo_id"), parts[2].alias("kind"), parts[3].cast("long").alias("number")))
