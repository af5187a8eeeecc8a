"""Timelines of pull requests: order, state at a time, expansion, pushes, stacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import checkpoint_dir
from .merge import dense_sequence
from .ordered import exact_quantiles, lag_in_order, scan_in_order

#: fixed values: causal order of kinds at one instant
KIND_ORDER = ("commit", "push", "pull_request", "stack", "review", "review_thread", "review_comment", "issue_comment", "check_suite", "check_run")
#: fixed values: what an event of each kind must have
REQUIRED = {"pull_request": "number", "review": "number", "issue_comment": "number", "review_thread": "number", "review_comment": "number", "check_suite": "sha", "check_run": "sha", "commit": "sha", "push": "ref", "stack": "stack_number"}


def kind_rank(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for i, k in enumerate(KIND_ORDER) for x in (k, i)])[kind], F.lit(len(KIND_ORDER)))


def normalize_timeline(df: DataFrame) -> DataFrame:
    """(at, kind, action, number, stable_key) with dense seq from 1 and at_ms since the first event."""
    ranked = df.withColumn("rank", kind_rank(F.col("kind")))
    first = df.agg(F.min("at").alias("at")).first().at
    out = dense_sequence(ranked, ["at", "rank", "kind", "action", "number", "stable_key"], 1)
    start = F.unix_micros(F.lit(first).cast("timestamp"))
    return out.withColumn("at_ms", F.floor((F.unix_micros(F.col("at").cast("timestamp")) - start) / 1000)).drop("rank")


def dedupe_timeline(df: DataFrame) -> DataFrame:
    """One row per (stable_key, at): the least of the repeats by their other columns in turn, whatever the order of rows."""
    rest = [c for c in df.columns if c not in ("stable_key", "at")]
    least = df.groupBy("stable_key", "at").agg(F.min(F.struct(*rest)).alias("__least"))
    return least.select(*[F.col(c) if c in ("stable_key", "at") else F.col("__least").getField(c).alias(c) for c in df.columns])


def pull_state_at(timeline: DataFrame, probes: DataFrame) -> DataFrame:
    """The state of pull requests (repo_id, number) at probe times: each field's last value at or before the probe.

    An as-of join by one scan over events and probes together; at one instant events go before probes.
    """
    fields = ["state", "head_sha", "base_ref", "decision"]
    e = timeline.select("repo_id", "number", "at", F.lit(0).alias("probe"), *fields, F.lit(None).cast("long").alias("probe_id"))
    p = probes.select("repo_id", "number", "at", F.lit(1).alias("probe"), *[F.lit(None).cast("string").alias(f) for f in fields], "probe_id")
    out = scan_in_order(e.unionByName(p), ["repo_id", "number"], ["at", "probe"], fields)
    return out.where("probe = 1").select("probe_id", "repo_id", "number", "at", *fields)


def pull_history_at(pulls: DataFrame, timeline: DataFrame, probes: DataFrame) -> DataFrame:
    """What pull requests looked like at probe times: probe_id, repo_id, number, state, merged, closed_at, merged_at, head_sha, base_ref, base_sha, decision, updated_at.

    ``pulls`` (repo_id, number, created_at, base_ref, base_sha) tell the end; ``timeline`` (repo_id, number, at, node, kind, sha,
    ref, previous_ref, review_id, verdict) what happened, in order of at and node. Every event is a change that sets some of
    the state, and changes up to the probe compose (``scan_in_order``). At first a pull request is open, its head is its
    first commit, its base what the first change of base left. Commits and forced pushes set the head, so a forced push
    drops what it doesn't hold; a change to the last base brings that one's commit, to others none. A review that
    is dismissed later counts until then by the verdict it had; dismissal clears the decision. Reopening clears the closing,
    not the merge. Reviews don't count as updates.
    """
    key = ["repo_id", "number"]
    gone = timeline.where("kind = 'dismissed' and review_id is not null").groupBy(*key, "review_id").agg(F.min_by(F.coalesce("verdict", F.lit("")), F.struct("at", "node")).alias("__before"))
    reviewed = timeline.join(gone, [*key, "review_id"], "left").join(pulls.select(*key, F.col("base_ref").alias("__ref"), F.col("base_sha").alias("__sha")), key)
    kind, at = F.col("kind"), F.col("at")
    verdict = F.upper(F.coalesce(F.nullif("__before", F.lit("")), "verdict"))
    commit = kind.isin("commit", "force_push") & (F.coalesce("sha", F.lit("")) != "")
    changes = {
        "head": F.when(commit, F.col("sha")),
        "base": F.when(kind == "base_changed", F.struct(F.col("ref").alias("ref"), F.when(F.col("ref") == F.col("__ref"), F.col("__sha")).otherwise("").alias("sha"))),
        "decision": F.when((kind == "review") & verdict.isin("APPROVED", "CHANGES_REQUESTED"), verdict).when(kind == "dismissed", ""),
        "life": F.when(kind.isin("closed", "merged"), F.struct(F.lit("closed").alias("state"), at.alias("closed_at"))).when(kind == "reopened", F.struct(F.lit("open").alias("state"), F.lit(None).cast("timestamp_ntz").alias("closed_at"))),
        "merged_at": F.when(kind == "merged", at),
        "updated_at": F.when(commit | kind.isin("base_changed", "closed", "merged", "reopened"), at),
    }
    events = reviewed.select(*key, "at", F.lit(0).alias("asked"), "node", F.lit(None).cast("long").alias("probe_id"), *[c.alias(f) for f, c in changes.items()])
    asked = probes.select(*key, "at", F.lit(1).alias("asked"), F.col("probe_id").alias("node"), "probe_id", *[F.lit(None).cast(events.schema[f].dataType).alias(f) for f in changes])
    told = scan_in_order(events.unionByName(asked), key, ["at", "asked", "node"], list(changes)).where("asked = 1")
    first = F.struct("at", "node")
    start = timeline.groupBy(*key).agg(F.min_by("sha", F.when((kind == "commit") & (F.coalesce("sha", F.lit("")) != ""), first)).alias("__head"), F.min_by("previous_ref", F.when((kind == "base_changed") & (F.coalesce("previous_ref", F.lit("")) != ""), first)).alias("__base"))
    out = told.join(pulls.select(*key, "created_at", "base_ref", "base_sha"), key).join(start, key, "left")
    return out.select(
        "probe_id", *key, F.coalesce("life.state", F.lit("open")).alias("state"), F.col("merged_at").isNotNull().alias("merged"), "life.closed_at", "merged_at", F.coalesce("head", "__head").alias("head_sha"),
        F.coalesce("base.ref", "__base", "base_ref").alias("base_ref"), F.when(F.col("base").isNotNull(), F.col("base.sha")).when(F.col("__base").isNotNull(), "").otherwise(F.col("base_sha")).alias("base_sha"),
        F.coalesce("decision", F.lit("")).alias("decision"), F.greatest("created_at", F.coalesce("updated_at", "created_at")).alias("updated_at"),
    )


def pull_events(timeline: DataFrame) -> DataFrame:
    """Each timeline row with the state that it leaves, the previous head, and an action: opened for the first."""
    w = Window.partitionBy("repo_id", "number").orderBy("at", "node")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return timeline.select(
        "repo_id", "number", "at", "node",
        F.when(F.row_number().over(w) == 1, "opened").when(F.col("head_sha").isNotNull(), "synchronize").when(F.col("base_ref").isNotNull(), "edited").otherwise(F.coalesce("state", F.lit("updated"))).alias("action"),
        F.last("head_sha", ignorenulls=True).over(so_far).alias("head_sha"), F.last("head_sha", ignorenulls=True).over(before).alias("previous_head"), F.last("state", ignorenulls=True).over(so_far).alias("state"),
    )


def thread_events(threads: DataFrame) -> DataFrame:
    """Threads (thread_id, resolved, comments of id, created_at, updated_at) to events: created, edited where updated later, resolved or unresolved at the last update."""
    c = threads.select("thread_id", F.explode("comments").alias("c"))
    made = c.select("thread_id", F.col("c.id").alias("comment_id"), F.lit("created").alias("action"), F.col("c.created_at").alias("at"))
    edited = c.where("c.updated_at > c.created_at").select("thread_id", F.col("c.id").alias("comment_id"), F.lit("edited").alias("action"), F.col("c.updated_at").alias("at"))
    last = F.array_max(F.transform("comments", lambda x: F.greatest(x["created_at"], x["updated_at"])))
    ended = threads.select("thread_id", F.lit(None).cast("long").alias("comment_id"), F.when(F.col("resolved"), "resolved").otherwise("unresolved").alias("action"), last.alias("at"))
    return made.unionByName(edited).unionByName(ended)


def pushes(commits: DataFrame) -> DataFrame:
    """Commits of a default branch (repo_id, sha, parent_sha, committed_at) as pushes: before is the first parent, else the commit before it."""
    told = lag_in_order(commits.select("repo_id", "sha", "parent_sha", "committed_at"), ["repo_id"], ["committed_at", "sha"], "sha", "__last")
    return told.select("repo_id", F.coalesce("parent_sha", "__last", F.lit("")).alias("before_sha"), F.col("sha").alias("after_sha"), "committed_at")


def stack_edges(pulls: DataFrame, default_branch: str = "main") -> DataFrame:
    """(repo_id, number, parent): the pull request whose head is the child's base. One with the exact commit goes first (lowest number), else open ones, newest, lowest number. Bases on the default branch and forks have none."""
    fork = F.col("head_repo") != F.col("repo") if {"head_repo", "repo"} <= set(pulls.columns) else F.lit(False)
    own = pulls.where(~fork)
    child = own.where(F.col("base_ref") != default_branch).select("repo_id", "number", F.col("base_ref").alias("ref"), "base_sha")
    parent = own.select("repo_id", F.col("number").alias("parent"), F.col("head_ref").alias("ref"), F.col("head_sha").alias("p_sha"), F.col("state").alias("p_state"), F.col("gh_updated_at").alias("p_at"))
    met = child.join(parent, ["repo_id", "ref"]).where("parent <> number")
    exact = (F.col("p_sha") == F.col("base_sha")) & (F.col("base_sha") != "")
    # among exact ones only the number counts
    rank = F.struct((~exact).alias("a"), F.when(exact, F.lit(0)).otherwise((F.col("p_state") != "open").cast("int")).alias("b"), F.when(exact, F.lit(0).cast("long")).otherwise(-F.unix_micros(F.col("p_at").cast("timestamp"))).alias("c"), F.col("parent").alias("d"))
    return met.groupBy("repo_id", "number").agg(F.min_by("parent", rank).alias("parent"))


def _followed(edges: DataFrame) -> DataFrame:
    """(repo_id, number, top, path) of every pull request in ``edges`` (one parent a member): its top, and the numbers from there down to it.

    Parents are followed by pointer doubling, so rounds grow with the logarithm of the longest chain, and a round is one
    join of what hasn't reached its top. A round that ends nowhere leaves cycles and what hangs on them; each cycle is cut
    at its smallest member.
    """
    checkpoint_dir(edges.sparkSession)
    e = edges.select("repo_id", "number", F.when(F.col("parent") != F.col("number"), F.col("parent")).alias("parent"))
    tops = e.select("repo_id", F.col("parent").alias("number")).where("number is not null").join(e, ["repo_id", "number"], "left_anti").distinct()
    path = e.unionByName(tops.withColumn("parent", F.lit(None).cast("long"))).withColumn("path", F.array("number")).checkpoint()

    def count() -> int:
        return path.where("parent is not null").count()

    left = count()
    while left:
        step = path.select("repo_id", F.col("number").alias("parent"), F.col("parent").alias("next"), F.col("path").alias("before"))
        open_, done = path.where("parent is not null"), path.where("parent is null")
        path = done.unionByName(open_.join(step, ["repo_id", "parent"]).select("repo_id", "number", F.col("next").alias("parent"), F.concat("before", "path").alias("path"))).checkpoint()
        was, left = left, count()
        if left == was:
            around = e.join(path.where("parent is not null").select("repo_id", "number"), ["repo_id", "number"], "left_semi").checkpoint()
            cut = around.join(_cycle_bottoms(around), ["repo_id", "number"], "left")
            again = cut.select("repo_id", "number", F.when(F.col("bottom").isNull(), F.col("parent")).alias("parent")).withColumn("path", F.array("number"))
            path = path.where("parent is null").unionByName(again).checkpoint()
            left = count()
    return path.select("repo_id", "number", F.get("path", F.lit(0)).alias("top"), "path")


def _cycle_bottoms(around: DataFrame) -> DataFrame:
    """(repo_id, number, bottom): the smallest member of each cycle that the parents of ``around`` (repo_id, number, parent) end in.

    What is reached in 2 ** k steps is all on cycles once one more round reaches no less; the least number of the steps
    doubles along.
    """
    far = around.select("repo_id", "number", F.col("parent").alias("far"), F.least("number", "parent").alias("low")).checkpoint()
    seen = None
    while True:
        reached = far.select("repo_id", F.col("far").alias("number")).distinct()
        state = (reached.count(), far.agg(F.sum(F.col("low").cast("decimal(38,0)"))).first()[0])
        if state == seen:
            return far.join(reached, ["repo_id", "number"], "left_semi").where("low = number").select("repo_id", "number", F.lit(True).alias("bottom"))
        seen = state
        step = far.select("repo_id", F.col("number").alias("far"), F.col("far").alias("next"), F.col("low").alias("below"))
        far = far.join(step, ["repo_id", "far"]).select("repo_id", "number", F.col("next").alias("far"), F.least("low", "below").alias("low")).checkpoint()


def stack_components(edges: DataFrame) -> DataFrame:
    """(repo_id, number, root): connected pull requests, the smallest number of each as root. Every member of a stack has at most one parent, so a component is what has one top."""
    told = _followed(edges).select("repo_id", "number", "top")
    root = told.groupBy("repo_id", "top").agg(F.min("number").alias("root"))
    return told.join(root, ["repo_id", "top"]).select("repo_id", "number", "root")


def order_stacks(pulls: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, stack_number, position, number, stack_id): members depth first from the root by smallest number; a cycle starts at its smallest member.

    A member's sort key is its path of numbers from the root, made by following parents; the stack's number is that of
    its bottom member, its id the first 15 hex digits of a hash over repository and members, as a number.
    """
    path = _followed(edges).select("repo_id", "number", F.col("top").alias("root"), "path")
    w = Window.partitionBy("repo_id", "root").orderBy("path")
    ordered = path.withColumn("position", F.row_number().over(w))
    facts = ordered.groupBy("repo_id", "root").agg(F.array_sort(F.collect_list(F.struct("position", "number"))).alias("m"))
    name = F.concat_ws(":", F.col("repo_id").cast("string"), F.array_join(F.transform("m", lambda x: x["number"].cast("string")), ","))
    facts = facts.select("repo_id", "root", F.get(F.col("m"), F.lit(0))["number"].alias("stack_number"), F.conv(F.substring(F.sha2(name, 256), 1, 15), 16, 10).cast("long").alias("stack_id"))
    newest = ordered.join(pulls.select("repo_id", "number", "gh_updated_at"), ["repo_id", "number"]).groupBy("repo_id", "root").agg(F.max("gh_updated_at").alias("updated_at"))
    return ordered.join(facts, ["repo_id", "root"]).join(newest, ["repo_id", "root"]).select("repo_id", "stack_number", F.col("position").cast("long").alias("position"), "number", "stack_id", "updated_at")


def validate_recording(df: DataFrame) -> DataFrame:
    """Problems of a recording (seq, at_ms, kind, number, sha, ref, stack_number): gaps in seq, time that starts late or goes back, missing fields, unknown kinds.

    A row is compared with the one whose seq is one less, by a join instead of a window over all.
    """
    before = df.select((F.col("seq") + 1).alias("seq"), F.col("at_ms").alias("last_ms"), F.lit(True).alias("known"))
    j = df.join(before, "seq", "left")
    lacks = reduce(lambda a, b: a | b, [(F.col("kind") == k) & F.col(c).isNull() for k, c in REQUIRED.items()])
    problems = F.array(
        F.when((F.col("seq") != 1) & F.col("known").isNull(), "sequence gap"),
        F.when((F.col("seq") == 1) & (F.col("at_ms") != 0), "starts late"),
        F.when(F.col("at_ms") < F.col("last_ms"), "time goes back"),
        F.when(~F.col("kind").isin(*KIND_ORDER), "unknown kind"),
        F.when(lacks, "missing field"),
    )
    return j.select("seq", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def arrival_profile(df: DataFrame, by: str, window: str = "1 hour") -> DataFrame:
    """Per group: events, gaps' quantiles in seconds, the busiest window."""
    told = lag_in_order(df.select(by, "at"), [by], ["at"], "at", "__last")
    gaps = told.withColumn("gap_s", (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("__last").cast("timestamp"))) / 1_000_000)
    counts = gaps.groupBy(by).agg(F.count(F.lit(1)).alias("events"), F.max("gap_s").alias("max_s"))
    middle = exact_quantiles(gaps, [by], "gap_s", [0.5]).select(by, F.col("gap_s").alias("p50_s"))
    busy = df.groupBy(by, F.window("at", window)).agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.max("n").alias("peak"))
    return counts.join(middle, by, "left").join(busy, by).select(by, "events", "p50_s", "max_s", "peak")
