"""Dirty scopes to work items by a user's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import parse_scope, scope_key
from .reads import live


def claim_dirty(df: DataFrame, n: int = 500) -> DataFrame:
    """The ``n`` scopes marked longest ago."""
    return df.orderBy("marked_at", "scope_key").limit(n)


def scope_snapshots(scopes: DataFrame, repos: DataFrame, pulls: DataFrame, threads: DataFrame, checks: DataFrame) -> DataFrame:
    """One row per scope (scope_key): its repository and, ordered by number, its pull requests with the threads and checks of their heads.

    A stack's scope holds the pull requests with its number, another scope the one without a stack. All parts are
    aggregated first and joined then.
    """
    parsed = scopes.select("scope_key", parse_scope(F.col("scope_key")).alias("s")).where("s is not null").select("scope_key", "s.*")
    p = live(pulls).withColumn("scope_key", scope_key(F.col("repo_id"), F.col("stack_number"), F.col("number"))).join(parsed.select("scope_key"), "scope_key", "left_semi")
    t = live(threads).groupBy("repo_id", F.col("pr_number").alias("number"), "head_sha").agg(F.count(F.lit(1)).alias("threads"), F.count_if(~F.col("resolved")).alias("unresolved"))
    c = live(checks).groupBy("repo_id", "head_sha").agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("conclusion") == "failure").alias("failures"))
    each = p.join(t, ["repo_id", "number", "head_sha"], "left").join(c, ["repo_id", "head_sha"], "left")
    zero = F.lit(0).cast("long")
    entry = F.struct("number", "state", "head_sha", *[F.coalesce(x, zero).alias(x) for x in ("threads", "unresolved", "checks", "failures")])
    nested = each.groupBy("scope_key").agg(F.array_sort(F.collect_list(entry)).alias("pulls"))
    r = live(repos).select("repo_id", "full_name")
    none = F.array().cast("array<struct<number:bigint,state:string,head_sha:string,threads:bigint,unresolved:bigint,checks:bigint,failures:bigint>>")
    return parsed.join(nested, "scope_key", "left").join(r, "repo_id", "left").select("scope_key", "repo_id", "kind", "full_name", F.coalesce("pulls", none).alias("pulls"))


def derive(snapshots: DataFrame, fn: Callable, schema: str = "scope_key string, identity_key string, payload string") -> DataFrame:
    """Work items of scopes by a pandas function of their rows, as ``scope_snapshots`` gives them: a row is a whole scope, and ``fn`` is given many at a time."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            yield fn(rows)

    return snapshots.mapInPandas(batches, schema)


#: Lanes over which the items of one identity are dealt.
LANES = 64


def _spread_join(items: DataFrame, side: DataFrame) -> DataFrame:
    """``items`` joined with ``side`` on identity_key; distinct (identity, lane) pairs meet ``side`` and items meet these, so that one identity of very many items is no one task's work."""
    laned = items.withColumn("__lane", F.pmod(F.xxhash64(*items.columns), F.lit(LANES)).cast("int"))
    entries = laned.select("identity_key", "__lane").distinct().join(side, "identity_key")
    return laned.join(entries, ["identity_key", "__lane"]).drop("__lane")


def validate_results(scopes: DataFrame, items: DataFrame, owners: DataFrame | None = None, complete: bool = False) -> DataFrame:
    """Problems of derived items (scope_key, identity_key, payload, repo_id): foreign scope, duplicate identity, wrong repository, payload that isn't JSON.

    With ``owners`` (identity_key, scope_key), items of identities that another scope owns are told of; with ``complete``,
    claimed scopes without any item, by a null identity.
    """
    claimed = scopes.select("scope_key").distinct().withColumn("__claimed", F.lit(True))
    counts = items.groupBy("identity_key").agg(F.count(F.lit(1)).alias("__n"))
    j = _spread_join(items, counts).join(claimed, "scope_key", "left")
    problem = (
        F.when(F.col("__claimed").isNull(), "foreign scope")
        .when(F.col("__n") > 1, "duplicate identity")
        .when(~F.coalesce(parse_scope(F.col("scope_key"))["repo_id"] == F.col("repo_id"), F.lit(False)), "wrong repository")
        .when(F.try_parse_json("payload").isNull(), "payload is not JSON")
    )
    out = j.withColumn("problem", problem).where("problem is not null").select("scope_key", "identity_key", "problem")
    if owners is not None:
        owned = owners.select("identity_key", F.col("scope_key").alias("__owner")).distinct()
        foreign = _spread_join(items.select("scope_key", "identity_key"), owned).where("__owner <> scope_key")
        out = out.unionByName(foreign.select("scope_key", "identity_key", F.lit("identity of another scope").alias("problem")))
    if complete:
        absent = claimed.join(items.select("scope_key").distinct(), "scope_key", "left_anti")
        out = out.unionByName(absent.select("scope_key", F.lit(None).cast("string").alias("identity_key"), F.lit("no result").alias("problem")))
    return out


def reconcile_items(state: DataFrame, scopes: DataFrame, items: DataFrame) -> DataFrame:
    """The next work items with change: inserted, updated, removed or kept; only claimed scopes lose items."""
    s = state.select("identity_key", F.col("scope_key").alias("s_scope"), F.col("payload").alias("s_payload"))
    i = items.select("identity_key", F.col("scope_key").alias("i_scope"), F.col("payload").alias("i_payload"))
    c = scopes.select(F.col("scope_key").alias("s_scope")).distinct().withColumn("__claimed", F.lit(True))
    both = s.join(c, "s_scope", "left").join(i, "identity_key", "full")
    change = (
        F.when(F.col("s_scope").isNull(), "inserted")
        .when(F.col("i_scope").isNull() & F.col("__claimed").isNotNull(), "removed")
        .when(F.col("i_scope").isNull(), "kept")
        .when(~F.col("s_payload").eqNullSafe(F.col("i_payload")) | ~F.col("s_scope").eqNullSafe(F.col("i_scope")), "updated")
        .otherwise("kept")
    )
    return both.select("identity_key", F.coalesce("i_scope", "s_scope").alias("scope_key"), F.coalesce("i_payload", "s_payload").alias("payload"), change.alias("change"))


def clear_dirty(dirty: DataFrame, claimed: DataFrame) -> DataFrame:
    """Scopes that are still dirty: not claimed, or marked again since."""
    c = claimed.select("scope_key", F.col("marked_at").alias("c_marked"))
    return dirty.join(c, "scope_key", "left").where("c_marked is null or marked_at > c_marked").select(*dirty.columns)
