"""From deliveries to coalesced refresh intents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import known_sha

#: fixed values: event, action, target, target in addition if the payload has a stack
DEFAULT_RULES = [
    ("pull_request", "*", "pull_request", "stack"),
    ("pull_request", "*", "resolve_stack_membership", None),
    ("pull_request_review", "*", "pull_request", None),
    ("pull_request_review_comment", "*", "pull_request", None),
    ("pull_request_review_thread", "*", "pull_request", None),
    ("issue_comment", "*", "pull_request", None),
    ("check_run", "*", "checks", None),
    ("check_suite", "*", "checks", None),
    ("push", "*", "branch", "stack"),
    ("push", "*", "codeowners", None),
]
#: fixed values: job kind of each target
KINDS = {
    "pull_request": "refresh_pr",
    "stack": "refresh_stack",
    "checks": "refresh_checks",
    "branch": "refresh_branch",
    "codeowners": "refresh_branch",
    "resolve_stack_membership": "resolve_stack_membership",
}
CODEOWNERS_PATHS = (".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS")
RULE_FIELDS = ("event", "action", "target", "stacked_target")
HEADS = "refs/heads/"


def load_rules(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    """The rule table; unknown fields, none at all, unknown targets or targets that an event can't have are errors."""
    if rules is None:
        rules = [dict(zip(RULE_FIELDS, r, strict=True)) for r in DEFAULT_RULES]
    if not rules:
        raise ValueError("no rules")
    for rule in rules:
        if extra := set(rule) - set(RULE_FIELDS):
            raise ValueError(f"unknown rule fields: {sorted(extra)}")
        for target in (rule.get("target"), rule.get("stacked_target")):
            if target is not None and target not in KINDS:
                raise ValueError(f"unknown target {target!r}")
        if not rule.get("event") or not rule.get("action") or not rule.get("target"):
            raise ValueError("a rule needs event, action and target")
        if (rule["target"] in ("branch", "codeowners")) != (rule["event"] == "push"):
            raise ValueError(f"target {rule['target']!r} doesn't go with event {rule['event']!r}")
        if (rule["target"] == "checks") != (rule["event"] in ("check_run", "check_suite")):
            raise ValueError(f"target {rule['target']!r} doesn't go with event {rule['event']!r}")
    rows = [(i, *[rule.get(f) for f in RULE_FIELDS]) for i, rule in enumerate(rules)]
    return spark.createDataFrame(rows, "rule int, r_event string, r_action string, target string, stacked_target string")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rule table from JSON lines at ``path``, checked as by ``load_rules``; a line that isn't an object is an error too."""
    lines = [r.value for r in spark.read.text(path).collect() if r.value.strip()]  # a table of rules, not of data
    rules = [json.loads(line) for line in lines]
    if not all(isinstance(rule, dict) for rule in rules):
        raise ValueError("a rule is an object")
    return load_rules(spark, rules)


def dedupe_deliveries(df: DataFrame) -> DataFrame:
    """The first row of each delivery, by received_at and arrival."""
    cols = [c for c in df.columns if c != "delivery_guid"]
    first = df.groupBy("delivery_guid").agg(F.min_by(F.struct(*cols), F.struct("received_at", "arrival")).alias("r"))
    return first.select("delivery_guid", "r.*").select(*df.columns)


def match_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Each delivery with every rule it meets; one that meets none keeps a row without a target."""
    on = (F.col("event") == F.col("r_event")) & ((F.col("r_action") == "*") | (F.col("r_action") == F.col("action")))
    return df.join(F.broadcast(rules), on, "left").drop("r_event", "r_action")


def payload_stack(p: str = "p") -> Column:
    return F.coalesce(F.col(f"{p}.pull_request.stack.number"), F.col(f"{p}.stack.number"))


def has_stack(p: str = "p") -> Column:
    return F.col(f"{p}.pull_request.stack").isNotNull() | F.col(f"{p}.stack").isNotNull()


def expand_targets(df: DataFrame) -> DataFrame:
    """One row per target: the rule's, and its stacked one if the payload has a stack, except for branch rules."""
    stacked = F.when(F.col("stacked_target").isNotNull() & has_stack() & (F.col("target") != "branch"), F.array("target", "stacked_target"))
    return df.withColumn("target", F.explode_outer(F.coalesce(stacked, F.array("target")))).drop("stacked_target")


def touches_codeowners(p: str = "p") -> Column:
    """A commit of the push adds, changes or removes a file that assigns owners."""
    every = F.concat(F.coalesce(F.col(f"{p}.commits"), F.array()), F.when(F.col(f"{p}.head_commit").isNotNull(), F.array(F.col(f"{p}.head_commit"))).otherwise(F.array()))

    def paths(c: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.concat(F.coalesce(c["added"], none), F.coalesce(c["modified"], none), F.coalesce(c["removed"], none))

    return F.exists(F.flatten(F.transform(every, paths)), lambda x: x.isin(*CODEOWNERS_PATHS))


def intent_key(df: DataFrame) -> DataFrame:
    """``df`` (event, target, p) with kind, key and key_error; a row with neither key nor error asks for nothing."""
    repo, ref = F.coalesce(F.col("p.repository.full_name"), F.lit("")), F.coalesce(F.col("p.ref"), F.lit(""))
    comment = F.col("event") == "issue_comment"
    number = F.when(comment, F.col("p.issue.number")).otherwise(F.coalesce(F.nullif(F.col("p.number"), F.lit(0)), F.col("p.pull_request.number")))
    number = F.coalesce(number, F.lit(0))
    stack = F.coalesce(payload_stack(), F.lit(0))
    sha = F.coalesce(F.when(F.col("event") == "check_suite", F.col("p.check_suite.head_sha")).otherwise(F.col("p.check_run.head_sha")), F.lit(""))
    branch = F.substring(ref, len(HEADS) + 1, 1 << 30)
    target = F.col("target")
    is_pull, is_push = target.isin("pull_request", "resolve_stack_membership"), target.isin("branch", "codeowners")
    silent = (is_pull & comment & F.col("p.issue.pull_request").isNull()) | (is_push & ~ref.startswith(HEADS))
    other_branch = (target == "codeowners") & (branch != "") & ((branch != F.coalesce("p.repository.default_branch", F.lit(""))) | ~touches_codeowners())
    error = (
        F.when(target.isNull(), None)
        .when(repo == "", "payload is missing repository.full_name")
        .when(silent, None)
        .when(is_pull & (number <= 0), "payload is missing a number")
        .when((target == "stack") & (stack <= 0), "payload is missing stack.number")
        .when((target == "checks") & (sha == ""), "payload is missing head_sha")
        .when(is_push & (branch == ""), "payload has an empty branch")
    )
    key = (
        F.when(is_pull, F.concat(F.lit("pr:"), repo, F.lit(":"), number.cast("string")))
        .when(target == "stack", F.concat(F.lit("stack:"), repo, F.lit(":"), stack.cast("string")))
        .when(target == "checks", F.concat(F.lit("checks:"), repo, F.lit(":"), sha))
        .when(is_push, F.concat(F.lit("branch:"), repo, F.lit(":"), branch))
    )
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    asks = target.isNotNull() & ~silent & ~F.coalesce(other_branch, F.lit(False))
    out = df.withColumns({"key_error": error, "kind": kinds[target], "key": F.when(asks, key)})
    return out.withColumn("key", F.when(F.col("key_error").isNull(), F.col("key")))


def push_hint(df: DataFrame) -> DataFrame:
    """Pushes to a branch: repo, branch, before_sha, after_sha (unknown ones empty), transition_known, deleted, forced."""
    ref = F.col("p.ref")
    good = df.where((F.coalesce("p.repository.full_name", F.lit("")) != "") & ref.startswith(HEADS) & (F.length(ref) > len(HEADS)))
    known = (F.coalesce("p.before", F.lit("")) != "") & (F.coalesce("p.after", F.lit("")) != "")
    return good.select(
        *[c for c in df.columns if c not in ("p", "payload", "body")],
        F.col("p.repository.full_name").alias("push_repo"),
        F.substring(ref, len(HEADS) + 1, 1 << 30).alias("branch"),
        known_sha(F.col("p.before")).alias("before_sha"),
        known_sha(F.col("p.after")).alias("after_sha"),
        known.alias("transition_known"),
        F.coalesce("p.deleted", F.lit(False)).alias("deleted"),
        F.coalesce("p.forced", F.lit(False)).alias("forced"),
    )


def stack_hint(df: DataFrame) -> DataFrame:
    """Payloads whose stack summary is complete enough to compare with a cached stack."""
    s = "p.pull_request.stack"
    number = F.coalesce(F.nullif(F.col("p.number"), F.lit(0)), F.col("p.pull_request.number"))
    good = (
        (F.coalesce("p.repository.full_name", F.lit("")) != "") & (number > 0) & (F.col(f"{s}.id") > 0) & (F.col(f"{s}.number") > 0) & (F.col(f"{s}.size") > 0) & (F.col(f"{s}.position") > 0)
        & (F.col(f"{s}.position") <= F.col(f"{s}.size")) & (F.coalesce(f"{s}.base.ref", F.lit("")) != "") & (F.coalesce(f"{s}.base.sha", F.lit("")) != "")
    )
    return df.where(good).select(
        *[c for c in df.columns if c not in ("p", "payload", "body")], F.col("p.repository.full_name").alias("hint_repo"), number.alias("pr_number"),
        F.col(f"{s}.id").alias("stack_id"), F.col(f"{s}.number").alias("stack_number"), F.col(f"{s}.size").alias("stack_size"), F.col(f"{s}.position").alias("stack_position"),
        F.col(f"{s}.base.ref").alias("base_ref"), F.col(f"{s}.base.sha").alias("base_sha"),
    )


def suppress_matching(intents: DataFrame, hints: DataFrame, stacks: DataFrame) -> DataFrame:
    """Stack refreshes but those whose hint says what the cached stack says already.

    intents: delivery_guid, kind, key; hints as ``stack_hint`` gives them with delivery_guid; stacks: full_name, number,
    gh_id, base_ref, base_sha, entries (array of structs with number).
    """
    # entries meet hints one by one on all that has to agree, so a stack number that many stacks or hints name is no product of them
    entry = stacks.select("full_name", "number", "gh_id", "base_ref", "base_sha", F.size("entries").alias("size"), F.posexplode("entries").alias("i", "e"))
    s = entry.where("base_sha <> ''").select("full_name", "number", "gh_id", "base_ref", "base_sha", "size", (F.col("i") + 1).alias("position"), F.col("e.number").alias("member"))
    h = hints.withColumn("at", F.col("stack_position").cast("int"))
    same = (
        (h["hint_repo"] == s["full_name"]) & (h["stack_number"] == s["number"]) & (h["stack_id"] == s["gh_id"]) & (h["base_ref"] == s["base_ref"]) & (h["base_sha"] == s["base_sha"])
        & (h["stack_size"] == s["size"]) & (h["at"] == s["position"]) & (h["pr_number"] == s["member"])
    )
    joined = h.join(s, same, "left_semi")
    told = joined.select("delivery_guid", F.lit("refresh_stack").alias("kind"), F.concat_ws(":", F.lit("stack"), "hint_repo", F.col("stack_number").cast("string")).alias("key")).distinct()
    return intents.join(told, ["delivery_guid", "kind", "key"], "left_anti")


def coalesce_intents(df: DataFrame) -> DataFrame:
    """One row per (kind, key, priority) with the earliest received_at and the number of deliveries."""
    return df.where(F.col("key").isNotNull()).groupBy("kind", "key", "priority").agg(F.min("received_at").alias("received_at"), F.count_distinct("delivery_guid").alias("deliveries"))


def coalesce_checks(df: DataFrame) -> DataFrame:
    """Check events of one commit as one refresh."""
    return coalesce_intents(df.where(F.col("kind") == "refresh_checks"))


def _runs(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """(from, to) of stretches of rows that agree in all columns."""
    n = len(columns[0])
    starts = np.zeros(n, dtype=bool)
    starts[:1] = True
    for c in columns:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts[1:] |= codes[1:] != codes[:-1]
    bounds = np.append(np.flatnonzero(starts), n)
    yield from zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)


def _opened(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("kind", pa.string()), ("key", pa.string()), ("opened_us", pa.int64()), ("instants", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def _windows(micros: int):
    """(kind, key, opened_us, instants) from (kind, key, t) in this order; what is open goes on from batch to batch."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []  # kind, key, opened, instants

        for batch in batches:
            kinds, keys, times = (batch.column(c) for c in ("kind", "key", "t"))
            t = times.to_numpy()
            out: list[tuple] = []
            for lo, hi in _runs(kinds, keys):
                kind, key = kinds[lo].as_py(), keys[lo].as_py()
                if now and (now[0], now[1]) != (kind, key):
                    out.append(tuple(now))
                    now = []
                at = lo
                while at < hi:
                    if not now or t[at] >= now[2] + micros:
                        if now:
                            out.append(tuple(now))
                        now = [kind, key, int(t[at]), 0]
                    end = lo + int(np.searchsorted(t[lo:hi], now[2] + micros))
                    now[3] += end - at
                    at = end
            yield _opened(out)
        if now:
            yield _opened([tuple(now)])

    return windows


def debounce(df: DataFrame, seconds: int = 5) -> DataFrame:
    """Windows of fixed length per (kind, key): the first intent opens one, later ones in it don't extend it, the next opens another.

    Times are pre-aggregated to one per key and instant and sorted within a key. A task reads them in order and keeps only
    the window that is open, so a key may have any number of instants.
    """
    micros = seconds * 1_000_000
    instants = df.select("kind", "key", F.unix_micros(F.col("received_at").cast("timestamp")).alias("t")).distinct()
    ordered = instants.repartition("kind", "key").sortWithinPartitions("kind", "key", "t")
    opened = ordered.mapInArrow(_windows(micros), "kind string, key string, opened_us long, instants long")
    return opened.select("kind", "key", "opened_us", (F.col("opened_us") + micros).alias("due_us"), "instants")


def bump_generations(state: DataFrame, intents: DataFrame) -> DataFrame:
    """State (kind, refresh_key, generation, completed_generation, deadline, event_received_at) with a generation more for each (kind, key) of the batch; deadline and event time become the earlier ones."""
    new = intents.groupBy("kind", F.col("key").alias("refresh_key")).agg(F.min("deadline").alias("n_deadline"), F.min("received_at").alias("n_received"))
    both = state.join(new.withColumn("n_here", F.lit(1)), ["kind", "refresh_key"], "full")
    return both.select(
        "kind", "refresh_key", (F.coalesce("generation", F.lit(0)) + F.coalesce("n_here", F.lit(0))).cast("long").alias("generation"), F.coalesce("completed_generation", F.lit(0)).cast("long").alias("completed_generation"),
        F.least("deadline", "n_deadline").alias("deadline"), F.least("event_received_at", "n_received").alias("event_received_at"),
    )


def complete_generations(state: DataFrame, done: DataFrame) -> DataFrame:
    """Completed becomes the larger one; deadline and event time are cleared only if the current generation is done."""
    d = done.groupBy("kind", "refresh_key").agg(F.max("generation").alias("d_generation"))
    both = state.join(d, ["kind", "refresh_key"], "left")
    current = F.coalesce(F.col("d_generation") >= F.col("generation"), F.lit(False))
    return both.select(
        "kind", "refresh_key", "generation", F.greatest("completed_generation", "d_generation").alias("completed_generation"),
        F.when(~current, F.col("deadline")).alias("deadline"), F.when(~current, F.col("event_received_at")).alias("event_received_at"),
    )


def delivery_outcome(df: DataFrame, max_attempts: int = 5, base_s: float = 1.0, cap_s: float = 60.0) -> DataFrame:
    """``df`` (attempts, error) with outcome (processed, retry, parked) and, for a retry, retry_after_s."""
    failed = F.col("error").isNotNull()
    out = F.when(~failed, "processed").when(F.col("attempts") >= max_attempts, "parked").otherwise("retry")
    wait = F.least(F.lit(base_s) * F.pow(F.lit(2.0), F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(cap_s))
    return df.withColumns({"outcome": out, "retry_after_s": F.when(out == "retry", wait)})


def claim_due(df: DataFrame, now: str, n: int) -> DataFrame:
    """The ``n`` oldest pending deliveries that are due, now being processed, with an attempt more."""
    due = df.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= F.lit(now).cast("timestamp_ntz")))
    top = due.orderBy("received_at", "delivery_guid").limit(n)
    return top.withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1})


def requeue_parked(df: DataFrame, guids: DataFrame | None = None, event: str | None = None, error: str | None = None, limit: int = 100) -> DataFrame:
    """Parked deliveries chosen by identifier, or by event and part of the error: requeued, or refused where the body was pruned. At most ``limit``, oldest first."""
    parked = df.where(F.col("status") == "parked")
    if guids is not None:
        parked = parked.join(guids, "delivery_guid", "left_semi")
    if event is not None:
        parked = parked.where(F.col("event") == event)
    if error is not None:
        parked = parked.where(F.col("last_error").contains(error))
    top = parked.orderBy("received_at", "delivery_guid").limit(limit)
    pruned = F.col("payload_pruned_at").isNotNull()
    return top.select("delivery_guid", "event", F.when(pruned, "parked").otherwise("pending").alias("status"), F.when(pruned, F.col("attempts")).otherwise(0).alias("attempts"), F.when(pruned, "payload was pruned").alias("refused"))


def delivery_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def unmatched_counts(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Deliveries per event that no rule knows."""
    known = rules.select(F.col("r_event").alias("event")).distinct()
    return df.join(F.broadcast(known), "event", "left_anti").groupBy("event").agg(F.count(F.lit(1)).alias("n"))
