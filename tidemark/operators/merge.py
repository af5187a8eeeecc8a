"""Monotonic merges of observations into entity tables: upserts, replace-sets, tombstones, events."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import scope_key
from ..functions.session import checkpoint_dir


@dataclass(frozen=True)
class Spec:
    """How an entity table merges.

    ``keep_if_empty``: payload columns whose empty incoming value keeps the stored one. ``known_flag``: an incoming flag
    without which ``flagged`` columns keep their stored values. ``needs_version``: a stored null version takes only an
    incoming one that isn't null. ``order``: columns compared as a tuple instead of the version alone. ``parent``: the
    columns that name a child's parent. ``etag_wins``: an equal version is accepted too if it brings the first etag.
    """

    keys: tuple[str, ...]
    payload: tuple[str, ...]
    version: str = "gh_updated_at"
    keep_if_empty: tuple[str, ...] = ()
    known_flag: str | None = None
    flagged: tuple[str, ...] = ()
    needs_version: bool = False
    order: tuple[str, ...] = ()
    parent: tuple[str, ...] = ()
    etag_wins: bool = False
    display_window_s: int | None = None
    extra: tuple[str, ...] = field(default=("last_checked_at", "tombstoned_at"))


REPOS = Spec(("gh_id",), ("owner", "name", "full_name", "default_branch", "archived", "head_sha"), keep_if_empty=("head_sha",))
PULL_REQUESTS = Spec(("repo_id", "number"), ("gh_id", "title", "state", "author_login", "head_ref", "head_sha", "base_ref", "base_sha", "stack_number", "stack_position"), known_flag="membership_known", flagged=("stack_number", "stack_position"), display_window_s=86_400, extra=("last_checked_at", "tombstoned_at", "etag", "display_until"))
STACKS = Spec(("repo_id", "number"), ("state", "base_ref", "base_sha", "size"), etag_wins=True, extra=("last_checked_at", "tombstoned_at", "etag"))
REVIEW_THREADS = Spec(("thread_id",), ("repo_id", "pr_number", "resolved", "n_comments"), parent=("repo_id", "pr_number"))
REVIEW_REQUESTS = Spec(("repo_id", "pr_number", "reviewer_kind", "reviewer_id"), ("reviewer_login",), parent=("repo_id", "pr_number"), extra=("last_checked_at", "tombstoned_at", "first_seen_at", "requested_at"))
REVIEWS = Spec(("node_id",), ("repo_id", "pr_number", "state", "author_login"), order=("lifecycle", "submitted_at", "gh_updated_at"), parent=("repo_id", "pr_number"), extra=("last_checked_at", "tombstoned_at", "lifecycle", "submitted_at"))
COMMENTS = Spec(("node_id",), ("repo_id", "pr_number", "author_login", "body_chars"), parent=("repo_id", "pr_number"))
CHANGED_FILES = Spec(("repo_id", "pr_number", "path"), ("change_type", "previous_path"), parent=("repo_id", "pr_number"))
FILE_OWNERS = Spec(("repo_id", "pr_number", "path", "owner_token"), ("owner_type", "line"), parent=("repo_id", "pr_number"))
CHECK_RUNS = Spec(("gh_id",), ("repo_id", "head_sha", "name", "status", "conclusion"), needs_version=True, parent=("repo_id", "head_sha"))
REPO_RULES = Spec(("repo_id", "rule_key"), ("rule_type", "parameters"), needs_version=True, parent=("repo_id",))
CHANGE_SNAPSHOTS = Spec(("repo_id", "pr_number"), ("files_total", "files_truncated", "codeowners_state"))


def _same(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, (p.eqNullSafe(q) for p, q in zip(a, b, strict=True)), F.lit(True))


def fold_batch(df: DataFrame, spec: Spec, arrival: str = "last_checked_at") -> DataFrame:
    """Of several observations of a key in a batch the one that taking them in turn would leave: the newest version, then the latest arrival, then the larger payload hash."""
    rank = F.struct(*[F.col(c) for c in (spec.order or (spec.version,))], F.col(arrival), F.xxhash64(*[F.col(c) for c in spec.payload]))
    rest = [c for c in df.columns if c not in spec.keys]
    return df.groupBy(*spec.keys).agg(F.max_by(F.struct(*rest), rank).alias("r")).select(*spec.keys, "r.*").select(*df.columns)


def merge_if_newer(state: DataFrame, batch: DataFrame, spec: Spec) -> DataFrame:
    """The next state, with change: inserted, updated or kept (also for keys that the batch lacks).

    Accepted is what is new, what has a newer version, what has an equal version and another payload, and what was checked
    after the stored row's tombstone. A stored null version accepts anything, or with ``needs_version`` a version. Equal
    keys in the batch are folded first. Accepting clears the tombstone.
    """
    return _merge_folded(state, fold_batch(batch, spec), spec).drop("__seen")


def _merge_folded(state: DataFrame, folded: DataFrame, spec: Spec) -> DataFrame:
    """``merge_if_newer`` of a batch with one row a key; ``__seen`` tells whether the batch has the key."""
    cols = [*spec.keys, *spec.payload, spec.version, *[c for c in spec.extra if c != spec.version]]
    cols = list(dict.fromkeys(cols))
    s = state.select(*[F.col(c).alias(f"s_{c}") for c in cols], F.lit(True).alias("s_here"))
    flags = [spec.known_flag] if spec.known_flag else []
    i = folded.select(*[(F.col(c) if c in folded.columns else F.lit(None)).alias(f"i_{c}") for c in (*cols, *flags)], F.lit(True).alias("i_here"))
    both = s.join(i, reduce(lambda a, b: a & b, (F.col(f"s_{k}") == F.col(f"i_{k}") for k in spec.keys)), "full")
    s_here, i_here = F.col("s_here").isNotNull(), F.col("i_here").isNotNull()
    new = {c: F.col(f"i_{c}") for c in cols}
    for c in spec.keep_if_empty:
        new[c] = F.when(s_here & (F.col(f"i_{c}") == ""), F.col(f"s_{c}")).otherwise(F.col(f"i_{c}"))
    if spec.known_flag:
        for c in spec.flagged:
            new[c] = F.when(F.coalesce(F.col(f"i_{spec.known_flag}"), F.lit(False)), F.col(f"i_{c}")).otherwise(F.col(f"s_{c}"))
    if "etag" in cols:
        new["etag"] = F.when(s_here & (F.coalesce("i_etag", F.lit("")) == ""), F.col("s_etag")).otherwise(F.col("i_etag"))
    old_v, new_v = F.col(f"s_{spec.version}"), F.col(f"i_{spec.version}")
    if spec.order:
        floor = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")

        def tuple_of(side: str) -> Column:
            parts = [F.coalesce(F.col(f"{side}_{c}").cast("timestamp_ntz"), floor) if c != "lifecycle" else F.col(f"{side}_{c}") for c in spec.order]
            return F.struct(*parts)

        newer, equal = tuple_of("i") > tuple_of("s"), tuple_of("i") == tuple_of("s")
    else:
        newer, equal = F.coalesce(new_v > old_v, F.lit(False)), new_v.eqNullSafe(old_v)
    other = ~_same([new[c] for c in spec.payload], [F.col(f"s_{c}") for c in spec.payload])
    # a stored null accepts anything; where a version is needed, another version or the same void with another payload
    void = (old_v.isNull() & new_v.isNotNull()) if spec.needs_version else old_v.isNull()
    if spec.order:
        void = F.lit(False)
    revived = F.coalesce(F.col("s_tombstoned_at").isNotNull() & (F.col("i_last_checked_at") > F.col("s_tombstoned_at")), F.lit(False))
    accept = void | newer | (equal & other) | revived
    if spec.etag_wins:
        accept = accept | (equal & (F.coalesce("s_etag", F.lit("")) == "") & (F.coalesce("i_etag", F.lit("")) != ""))
    inserted, taken = i_here & ~s_here, i_here & (~s_here | accept)
    if spec.display_window_s is not None:
        until = F.col("i_last_checked_at") + F.make_dt_interval(secs=F.lit(spec.display_window_s))
        new["display_until"] = F.when(F.col("i_state") == "open", None).when(~s_here | (F.col("s_state") == "open"), until).otherwise(F.col("s_display_until"))
    if "first_seen_at" in cols:
        new["first_seen_at"] = F.when(s_here & F.col("s_tombstoned_at").isNull(), F.col("s_first_seen_at")).otherwise(F.col("i_last_checked_at"))
        new["requested_at"] = F.coalesce(F.col("i_requested_at"), F.when(F.col("s_tombstoned_at").isNull(), F.col("s_requested_at")))
    new["tombstoned_at"] = F.lit(None).cast(state.schema["tombstoned_at"].dataType)
    change = F.when(inserted, "inserted").when(taken, "updated").otherwise("kept")
    return both.select(*[F.when(taken, new[c]).otherwise(F.col(f"s_{c}")).alias(c) for c in cols], change.alias("change"), i_here.alias("__seen"))


def replace_set(state: DataFrame, observed: DataFrame, parents: DataFrame, spec: Spec) -> DataFrame:
    """Merge the children of completely observed parents; live ones that were not seen get a tombstone.

    ``parents`` holds a row with observed_at for every observed parent, also for one without children; a parent that was
    not observed changes nothing. Children of parents that are not listed are ignored.
    """
    on = list(spec.parent)
    seen = fold_batch(observed.join(parents.select(*on), on, "left_semi"), spec)
    # the merge itself tells what was seen, so the batch is folded and shuffled once
    merged = _merge_folded(state, seen, spec)
    gone = parents.groupBy(*on).agg(F.max("observed_at").alias("observed_at"))
    both = merged.join(gone, on, "left")
    missing = F.col("observed_at").isNotNull() & ~F.col("__seen") & F.col("tombstoned_at").isNull()
    missing = missing & F.coalesce(F.col("last_checked_at") <= F.col("observed_at"), F.lit(True))
    return both.select(
        *[F.when(missing, F.col("observed_at")).otherwise(F.col(c)).alias(c) if c == "tombstoned_at" else F.col(c) for c in merged.columns if c not in ("change", "__seen")],
        F.when(missing, "tombstoned").otherwise(F.col("change")).alias("change"),
    )


def parent_gate(observed: DataFrame, pulls: DataFrame) -> DataFrame:
    """Observations of children (repo_id, pr_number, parent_gh_updated_at) whose parent is live and not newer than they are."""
    p = pulls.where("tombstoned_at is null").select("repo_id", F.col("number").alias("pr_number"), F.col("gh_updated_at").alias("p_version"))
    return observed.join(p, ["repo_id", "pr_number"]).where("p_version is null or p_version <= parent_gh_updated_at").drop("p_version")


def snapshot_fence(snapshots: DataFrame, pulls: DataFrame) -> DataFrame:
    """Snapshots whose base and head are those of the live parent, and that are not older than it."""
    p = pulls.where("tombstoned_at is null").select("repo_id", F.col("number").alias("pr_number"), F.col("head_sha").alias("p_head"), F.col("base_sha").alias("p_base"), F.col("gh_updated_at").alias("p_version"))
    same = "head_sha = p_head and base_sha = p_base and head_sha <> '' and base_sha <> '' and (p_version is null or p_version <= parent_gh_updated_at)"
    return snapshots.join(p, ["repo_id", "pr_number"]).where(same).drop("p_head", "p_base", "p_version")


def child_fence(children: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Files or owners whose base and head are those of the stored snapshot."""
    s = snapshots.select("repo_id", "pr_number", "head_sha", "base_sha")
    return children.join(s, ["repo_id", "pr_number", "head_sha", "base_sha"], "left_semi")


def merge_rule_sync(state: DataFrame, checks: DataFrame) -> DataFrame:
    """(repo_id, etag, last_checked_at) after a batch of rule checks (repo_id, etag, checked_at, arrival) in order of arrival: an empty or missing etag leaves the one before, a check never goes back in time. The batch is folded before it meets the state."""
    valid = F.nullif(F.col("etag"), F.lit(""))
    batch = checks.groupBy("repo_id").agg(F.max_by(valid, F.when(valid.isNotNull(), F.struct("arrival", "checked_at", "etag"))).alias("new_etag"), F.max("checked_at").alias("checked_at"))
    both = state.select("repo_id", "etag", "last_checked_at").join(batch, "repo_id", "full_outer")
    return both.select("repo_id", F.coalesce("new_etag", "etag", F.lit("")).alias("etag"), F.greatest("last_checked_at", "checked_at").alias("last_checked_at"))


def merge_aliases(aliases: DataFrame) -> DataFrame:
    """The repository that each name was last seen for."""
    return aliases.groupBy("full_name").agg(F.max_by("repo_id", F.struct("last_seen_at", "repo_id")).alias("repo_id"), F.max("last_seen_at").alias("last_seen_at"))


def append_check_history(accepted: DataFrame, observed: DataFrame) -> DataFrame:
    """Observations that are what the table now holds."""
    same = ["gh_id", "status", "conclusion", "semantic_version"]
    a = accepted.select(*[F.col(c).alias(f"a_{c}") for c in (*same, "gh_updated_at")])
    on = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"a_{c}")) for c in (*same[1:], "gh_updated_at")), F.col("gh_id") == F.col("a_gh_id"))
    return observed.join(a, on, "left_semi")


def touch(state: DataFrame, keys: DataFrame, on: list[str], require_etag: bool = False) -> DataFrame:
    """Advance last_checked_at without a change; a confirmation by etag counts only for a live row of that etag."""
    k = keys.groupBy(*on).agg(F.max("checked_at").alias("checked_at"), F.max_by("etag", "checked_at").alias("k_etag")) if require_etag else keys.groupBy(*on).agg(F.max("checked_at").alias("checked_at"))
    both = state.join(k, on, "left")
    good = (F.col("etag") == F.col("k_etag")) & (F.col("etag") != "") & F.col("tombstoned_at").isNull() if require_etag else F.col("checked_at").isNotNull()
    return both.withColumn("last_checked_at", F.when(good, F.greatest("last_checked_at", "checked_at")).otherwise(F.col("last_checked_at"))).select(*state.columns)


def tombstone(state: DataFrame, missing: DataFrame, on: list[str], close: bool = False) -> DataFrame:
    """Confirmed missing entities (with observed_at): live ones last checked no later get a tombstone; a stack closes too."""
    m = missing.groupBy(*on).agg(F.max("observed_at").alias("observed_at"))
    hit = F.coalesce(F.col("tombstoned_at").isNull() & (F.col("last_checked_at") <= F.col("observed_at")), F.lit(False))
    new = {"tombstoned_at": F.when(hit, F.col("observed_at")).otherwise(F.col("tombstoned_at"))}
    if "etag" in state.columns:
        new["etag"] = F.when(hit, "").otherwise(F.col("etag"))
    if "display_until" in state.columns:
        new["display_until"] = F.when(~hit, F.col("display_until"))
    if close:
        new["state"] = F.when(hit, "closed").otherwise(F.col("state"))
    return state.join(m, on, "left").withColumns(new).select(*state.columns)


def cascade_tombstone(children: DataFrame, pulls: DataFrame) -> DataFrame:
    """Children of tombstoned pull requests get their tombstones."""
    dead = pulls.where("tombstoned_at is not null").select("repo_id", F.col("number").alias("pr_number"), F.col("tombstoned_at").alias("p_dead"))
    both = children.join(dead, ["repo_id", "pr_number"], "left")
    return both.withColumn("tombstoned_at", F.coalesce("tombstoned_at", "p_dead")).select(*children.columns)


def cas_observations(versions: DataFrame, batch: DataFrame) -> DataFrame:
    """(entity_key, start_version) against (entity_key, version): accepted and the version then. Of several writers from one start the first by arrival wins."""
    first = batch.groupBy("entity_key", "start_version").agg(F.min("arrival").alias("arrival"), F.count(F.lit(1)).alias("writers"))
    both = first.join(versions, "entity_key", "left").withColumn("version", F.coalesce("version", F.lit(0)))
    good = F.col("start_version") == F.col("version")
    return both.select("entity_key", "start_version", good.alias("accepted"), F.when(good, F.col("version") + 1).otherwise(F.col("version")).cast("long").alias("version"), (F.col("writers") - good.cast("int")).cast("long").alias("rejected"))


def dense_sequence(df: DataFrame, order: list[str], start: int, name: str = "seq", partitions: int | None = None) -> DataFrame:
    """Number rows from ``start`` by ``order`` without one task for all: sorted ranges, a count of each, offsets."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    checkpoint_dir(df.sparkSession)
    ranged = ranged.checkpoint()  # the numbers within ranges and the counts must be of one evaluation, whatever executors are lost
    part = F.shiftright("__at", 33)
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], start
    for p, size in sizes:
        offsets += [F.lit(p), F.lit(total).cast("long")]
        total += size
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("long"))
    return ranged.withColumn(name, F.create_map(*offsets)[part] + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at")


def emit_events(changes: DataFrame, next_seq: int) -> DataFrame:
    """One event per changed entity (entity_key, kind), numbered densely by key and kind."""
    return dense_sequence(changes.select("entity_key", "kind").distinct(), ["entity_key", "kind"], next_seq)


def mark_dirty(state: DataFrame, scopes: DataFrame) -> DataFrame:
    """Scopes with the latest time at which they were marked."""
    return state.select("scope_key", "marked_at").unionByName(scopes.select("scope_key", "marked_at")).groupBy("scope_key").agg(F.max("marked_at").alias("marked_at"))


def scopes_for_pulls(pulls: DataFrame, members: DataFrame) -> DataFrame:
    """(repo_id, number, scope_key) of pull requests (repo_id, number): their live stack of ``members`` (repo_id, number, stack_number), or themselves."""
    of = pulls.select("repo_id", "number").distinct().join(members.select("repo_id", "number", "stack_number").distinct(), ["repo_id", "number"], "left")
    return of.select("repo_id", "number", scope_key(F.col("repo_id"), F.col("stack_number"), F.col("number")).alias("scope_key"))


def scopes_for_stacks(members: DataFrame, old_members: DataFrame) -> DataFrame:
    """(scope_key) of stacks whose members changed: the stack's before and after, and those of pull requests that left it."""
    keys = ["repo_id", "number", "stack_number"]
    now, was = (x.select(*keys).distinct() for x in (members, old_members))
    moved = now.join(was, keys, "left_anti").unionByName(was.join(now, keys, "left_anti"))
    stacks = moved.select(scope_key(F.col("repo_id"), F.col("stack_number"), F.col("number")).alias("scope_key"))
    left = was.join(now.select("repo_id", "number"), ["repo_id", "number"], "left_anti")
    return stacks.unionByName(left.select(scope_key(F.col("repo_id"), F.lit(None).cast("long"), F.col("number")).alias("scope_key"))).distinct()


def scopes_for_heads(heads: DataFrame, pulls: DataFrame, members: DataFrame) -> DataFrame:
    """(head_sha, scope_key) of the live pull requests whose head a check (repo_id, head_sha) is of."""
    hit = pulls.where("tombstoned_at is null").select("repo_id", "number", "head_sha").join(heads.select("repo_id", "head_sha").distinct(), ["repo_id", "head_sha"])
    return hit.join(scopes_for_pulls(hit, members), ["repo_id", "number"]).select("head_sha", "scope_key").distinct()


def scopes_for_repos(repos: DataFrame, stacks: DataFrame, pulls: DataFrame, members: DataFrame) -> DataFrame:
    """(repo_id, scope_key) of all that is derived for repositories (repo_id): their live stacks, and their live pull requests that are in none.

    Stacks of repositories need no pull requests, and pull requests are loose if no row of ``members`` (repo_id, number,
    stack_number) puts them into a stack, live or not.
    """
    wanted = repos.select("repo_id").distinct()
    whole = stacks.where("tombstoned_at is null").select("repo_id", "stack_number").join(wanted, "repo_id")
    loose = pulls.where("tombstoned_at is null").select("repo_id", "number").join(wanted, "repo_id").join(members.where("stack_number is not null").select("repo_id", "number"), ["repo_id", "number"], "left_anti")
    none = F.lit(None).cast("long")
    return whole.select("repo_id", scope_key(F.col("repo_id"), F.col("stack_number"), none).alias("scope_key")).unionByName(loose.select("repo_id", scope_key(F.col("repo_id"), none, F.col("number")).alias("scope_key"))).distinct()


def merge_fenced(state: DataFrame, snapshots: DataFrame, pulls: DataFrame, spec: Spec) -> DataFrame:
    """``merge_if_newer`` of the change snapshots that ``snapshot_fence`` lets through."""
    return merge_if_newer(state, snapshot_fence(snapshots, pulls), spec)


def replace_fenced(state: DataFrame, children: DataFrame, parents: DataFrame, snapshots: DataFrame, spec: Spec) -> DataFrame:
    """``replace_set`` of files or owners of the stored snapshots: children and parents of other commits are left out as by ``child_fence``."""
    return replace_set(state, child_fence(children, snapshots), child_fence(parents, snapshots), spec)


def check_semantic_version(df: DataFrame, fields: tuple[str, ...] = ("status", "conclusion", "url", "app", "started_at", "completed_at")) -> DataFrame:
    """A hash of what a check says, in a canonical form."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in fields if c in df.columns])
    return df.withColumn("semantic_version", F.sha2(text, 256))


def shape_stacks(members: DataFrame) -> DataFrame:
    """(repo_id, stack_number, position, number, head_ref, head_sha, updated_at, base_ref, base_sha) as one row per stack: ordered entries, newest time, head of the last entry."""
    entry = F.struct("position", "number", "head_ref", "head_sha")
    return (
        members.groupBy("repo_id", "stack_number")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.max("updated_at").alias("updated_at"), F.min_by("base_ref", "position").alias("base_ref"), F.min_by("base_sha", "position").alias("base_sha"))
        .withColumn("head_sha", F.coalesce(F.nullif(F.element_at("entries", -1)["head_sha"], F.lit("")), "base_sha"))
    )


def membership_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """joined, left and moved members between two sets of (repo_id, stack_number, number, position)."""
    o = old.select("repo_id", "number", F.col("stack_number").alias("old_stack"), F.col("position").alias("old_position"))
    n = new.select("repo_id", "number", F.col("stack_number").alias("new_stack"), F.col("position").alias("new_position"))
    both = o.join(n, ["repo_id", "number"], "full")
    change = F.when(F.col("old_stack").isNull(), "joined").when(F.col("new_stack").isNull(), "left").when((F.col("old_stack") != F.col("new_stack")) | (F.col("old_position") != F.col("new_position")), "moved")
    return both.withColumn("change", change).where("change is not null")


def followups(changes: DataFrame) -> DataFrame:
    """Refreshes that follow a merge: checks of a new head, stacks left and joined, membership of what moved."""
    def row(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    repo = F.col("full_name")
    new_head = F.coalesce(F.col("new_head") != F.col("old_head"), F.col("new_head").isNotNull()) & (F.col("new_head") != "")
    moved = ~F.col("old_stack").eqNullSafe(F.col("new_stack"))
    wanted = F.array(
        F.when(new_head, row("refresh_checks", F.concat_ws(":", F.lit("checks"), repo, "new_head"))),
        F.when(moved & F.col("old_stack").isNotNull(), row("refresh_stack", F.concat_ws(":", F.lit("stack"), repo, F.col("old_stack").cast("string")))),
        F.when(moved & F.col("new_stack").isNotNull(), row("refresh_stack", F.concat_ws(":", F.lit("stack"), repo, F.col("new_stack").cast("string")))),
        F.when(moved, row("resolve_stack_membership", F.concat_ws(":", F.lit("pr"), repo, F.col("number").cast("string")))),
    )
    return changes.select(F.explode(F.filter(wanted, lambda x: x.isNotNull())).alias("f")).select("f.*").distinct()
