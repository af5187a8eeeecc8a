"""Cached state against the source: snapshots, sampling, canonical forms, field diffs, findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import checkpoint_dir

#: fixed values: how mergeability and review decisions are classed
MERGEABLE = {"MERGEABLE": "mergeable", "CLEAN": "mergeable", "CONFLICTING": "conflicting", "DIRTY": "conflicting", "UNKNOWN": "unknown", "": "unknown"}
DECISIONS = {"APPROVED": "approved", "CHANGES_REQUESTED": "changes_requested", "REVIEW_REQUIRED": "review_required", "": ""}


def drift_entities(parts: dict[str, DataFrame]) -> DataFrame:
    """(entity_kind, source_id, entity_key, freshness, document) of every live entity; a part brings source_id, entity_key, freshness and its fields, which become a JSON document with sorted names."""
    out = None
    for kind, df in sorted(parts.items()):
        fields = sorted(c for c in df.columns if c not in ("source_id", "entity_key", "freshness", "tombstoned_at"))
        live = df.where("tombstoned_at is null") if "tombstoned_at" in df.columns else df
        part = live.select(F.lit(kind).alias("entity_kind"), "source_id", "entity_key", "freshness", F.to_json(F.struct(*fields)).alias("document"))
        out = part if out is None else out.unionByName(part)
    return out


def fence_children(pulls: DataFrame, children: DataFrame) -> DataFrame:
    """Pull requests with the children (repo_id, pr_number, head_sha, item) of their present head, sorted; facts of another head are left out."""
    kept = children.join(pulls.select("repo_id", F.col("number").alias("pr_number"), "head_sha"), ["repo_id", "pr_number", "head_sha"], "left_semi")
    packed = kept.groupBy("repo_id", F.col("pr_number").alias("number")).agg(F.sort_array(F.collect_list("item")).alias("items"))
    return pulls.join(packed, ["repo_id", "number"], "left")


def drift_keys(parts: dict[str, DataFrame]) -> DataFrame:
    """The keys of the same entities alone."""
    cols = ("source_id", "entity_key", "freshness")
    frames = [df.where("tombstoned_at is null").select(F.lit(kind).alias("entity_kind"), *cols) if "tombstoned_at" in df.columns else df.select(F.lit(kind).alias("entity_kind"), *cols) for kind, df in sorted(parts.items())]
    return reduce(DataFrame.unionByName, frames)


def rotating_sample(keys: DataFrame, cursors: dict[str, int], n: int) -> DataFrame:
    """The next of each kind after its cursor, from the start again at the end. Kinds share ``n`` evenly, the first ones take what is left over."""
    kinds = sorted(cursors)
    out = None
    for i, kind in enumerate(kinds):
        quota = n // len(kinds) + (i < n % len(kinds))
        of_kind = keys.where(F.col("entity_kind") == kind)
        part = of_kind.orderBy((F.col("source_id") <= cursors[kind]), "source_id").limit(quota)
        out = part if out is None else out.unionByName(part)
    return out


def canonical_pull(df: DataFrame) -> DataFrame:
    """State merged where merged, classes of mergeability and decision in place of raw values."""
    def classed(values: dict[str, str], c: Column) -> Column:
        known = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
        return F.coalesce(known[F.upper(F.coalesce(c, F.lit("")))], F.lit("other"))

    new = {"state": F.when(F.col("merged"), "merged").otherwise(F.lower("state"))}
    if "mergeable_state" in df.columns:
        new["mergeable_state"] = classed(MERGEABLE, F.col("mergeable_state"))
    if "review_decision" in df.columns:
        new["review_decision"] = classed(DECISIONS, F.col("review_decision"))
    return df.withColumns(new)


def normalize(items: Column) -> Column:
    """An array of structs (kind, identity, ...) in order of these, unless an item has no identity: then as it is."""
    return F.when(F.forall(items, lambda x: x["identity"].isNotNull()), F.array_sort(items)).otherwise(items)


def semantic_diff(cache: DataFrame, upstream: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per differing field: keys, path, cache_value, upstream_value; a row on one side only has path '' and says missing for the other."""
    c = cache.select(*keys, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("c"))
    u = upstream.select(*keys, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("u"))
    both = c.join(u, keys, "full")
    one_sided = F.col("c").isNull() | F.col("u").isNull()
    leaf = [F.when(~F.col(f"c.{f}").eqNullSafe(F.col(f"u.{f}")), F.struct(F.lit(f).alias("path"), F.col(f"c.{f}").alias("cache_value"), F.col(f"u.{f}").alias("upstream_value"))) for f in fields]
    whole = F.array(F.struct(F.lit("").alias("path"), F.when(F.col("c").isNull(), "missing").otherwise("present").alias("cache_value"), F.when(F.col("u").isNull(), "missing").otherwise("present").alias("upstream_value")))
    diffs = F.when(one_sided, whole).otherwise(F.filter(F.array(*leaf), lambda x: x.isNotNull()))
    return both.select(*keys, F.explode(diffs).alias("d")).select(*keys, "d.*")


#: A step of a path into a document: a field's name, an item's position, or an item's identity with its place among items of the same.
STEP = "struct<kind:string,name:string,nth:int>"


def _path(steps: Column) -> Column:
    """Steps as text. Names that aren't plain words are quoted, so different steps never give one text."""

    def shown(s: Column) -> Column:
        name = s["name"]
        quoted = F.concat(F.lit('"'), F.regexp_replace(name, r'(["\\])', r"\\$1"), F.lit('"'))
        field = F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(F.lit("."), name)).otherwise(F.concat(F.lit("["), quoted, F.lit("]")))
        again = F.when(s["nth"] > 0, F.concat(F.lit("#"), s["nth"].cast("string"))).otherwise("")
        plain = name.rlike("^[A-Za-z_./:@-][A-Za-z0-9_./:@-]*$")
        named = F.concat(F.lit("["), F.when(plain, name).otherwise(F.concat(F.lit("="), quoted)), again, F.lit("]"))
        return F.when(s["kind"] == "field", field).when(s["kind"] == "item", F.concat(F.lit("["), name, F.lit("]"))).otherwise(named)

    return F.regexp_replace(F.array_join(F.transform(steps, shown), ""), r"^\.", "")


def _let(value: Column, body) -> Column:
    """``body`` of a value evaluated once; a plain column in a lambda could be evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def _step(kind: str, name: Column, nth: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"), (F.lit(0) if nth is None else nth).cast("int").alias("nth"))


def _members(v: Column, text: Column) -> Column:
    """Steps and variants of what the object or array ``v`` holds; items that repeat an identity are told apart by their order."""

    def of_items(items: Column, ids: Column, once: Column) -> Column:
        def nth(x: Column, i: Column) -> Column:
            return F.when(once, 0).otherwise(F.size(F.filter(F.slice(ids, F.lit(1), i), lambda y: y == x)))

        named = F.transform(ids, lambda x, i: _step("named", x, nth(x, i)))
        placed = F.transform(ids, lambda x, i: _step("item", i.cast("string")))
        return F.struct(F.when(F.forall(ids, lambda x: x.isNotNull()), named).otherwise(placed).alias("steps"), items.alias("values"))

    def identities(items: Column) -> Column:
        return F.transform(items, lambda x: F.try_variant_get(x, "$.identity", "string"))

    items = _let(F.try_variant_get(v, "$", "array<variant>"), lambda x: _let(identities(x), lambda ids: _let(F.size(F.array_distinct(ids)) == F.size(ids), lambda once: of_items(x, ids, once))))
    fields = _let(F.try_variant_get(v, "$", "map<string,variant>"), lambda x: F.struct(F.transform(F.map_keys(x), lambda k: _step("field", k)).alias("steps"), F.map_values(x).alias("values")))
    return F.when(text.startswith("["), items).otherwise(fields)


def _met(c: Column, u: Column) -> Column:
    """Members of both sides by step, as (step, vc, vu): the steps are sorted, so equal ones are neighbours."""

    def at(m: Column, side: int) -> Column:
        return F.transform(m["steps"], lambda k, i: F.struct(k.alias("step"), F.lit(side).alias("side"), i.alias("at")))

    def of(m: Column, steps: Column) -> Column:
        def one(e: Column, j: Column) -> Column:
            after = F.get(steps, j + 1)
            also = F.when(e["side"] == 1, e["at"]).when(after["step"] == e["step"], after["at"])
            pair = F.struct(e["step"].alias("step"), F.get(m["c"]["values"], F.when(e["side"] == 0, e["at"])).alias("vc"), F.get(m["u"]["values"], also).alias("vu"))
            return F.when((e["side"] == 0) | ~F.coalesce(F.get(steps, j - 1)["step"] == e["step"], F.lit(False)), pair)

        return F.filter(F.transform(steps, one), lambda x: x.isNotNull())

    none = F.array().cast(f"array<struct<step:{STEP},side:int,at:int>>")
    return _let(F.struct(c.alias("c"), u.alias("u")), lambda m: _let(F.sort_array(F.concat(F.coalesce(at(m["c"], 0), none), F.coalesce(at(m["u"], 1), none))), lambda steps: of(m, steps)))


def document_diff(cache: DataFrame, upstream: DataFrame, keys: list[str]) -> DataFrame:
    """One row per differing leaf of JSON documents (keys, document): keys, path, cache_value, upstream_value.

    Documents meet in one join by their keys and are dealt over all tasks, which is all that is shuffled. Then they are compared level by level as variants,
    in the row: what the two objects or arrays hold is matched by its steps, and only members that differ go on to the next
    level. A round is one level; the depth isn't bounded by anything here. Arrays of objects that all have an ``identity`` are compared by it, whatever
    their order, and by place among items that repeat it. Empty objects and arrays are leaves. Of one-sided leaves the
    missing side is null; a row on one side only has path ''. A document that isn't JSON is one leaf.
    """
    spark = cache.sparkSession
    checkpoint_dir(spark)
    both = cache.select(*keys, F.col("document").alias("c")).join(upstream.select(*keys, F.col("document").alias("u")), keys, "full")
    # few bytes, but much work a byte: the number of tasks is set, so that small files or merged partitions don't decide it
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = both.where(~F.col("c").eqNullSafe(F.col("u"))).repartition(tasks, *keys).select(F.struct(*keys).alias("d"), "c", "u")
    root = F.array().cast(f"array<{STEP}>").alias("steps")
    top = rows.select("d", root, *[F.try_parse_json(x).alias(f"v{x}") for x in "cu"], "c", "u")
    level = top.select("d", "steps", *[c for x in "cu" for c in (F.col(f"v{x}"), F.coalesce(F.to_json(f"v{x}"), F.col(x)).alias(f"t{x}"))])
    one_sided = F.col("tc").isNull() | F.col("tu").isNull()
    found, first = [], True
    while True:
        # an inner object or array is one that is JSON and holds something
        inner = {x: F.coalesce(F.col(f"v{x}").isNotNull() & F.col(f"t{x}").rlike(r"^[\[{]") & ~F.col(f"t{x}").isin("[]", "{}"), F.lit(False)) for x in "cu"}
        level = level.where(~F.col("tc").eqNullSafe(F.col("tu"))).withColumns({f"i{x}": inner[x] for x in "cu"}).checkpoint()
        if first:
            # a document on one side only is told of as a whole
            found.append(level.where(one_sided).select("d", "steps", *[F.when(F.col(f"t{x}").isNotNull(), "present").alias(y) for x, y in (("c", "cache_value"), ("u", "upstream_value"))]))
            level, first = level.where(~one_sided), False
        leaves = level.where("(tc is not null and not ic) or (tu is not null and not iu)")
        found.append(leaves.select("d", "steps", F.when(~F.col("ic"), F.col("tc")).alias("cache_value"), F.when(~F.col("iu"), F.col("tu")).alias("upstream_value")))
        deeper = level.where("ic or iu")
        if deeper.isEmpty():
            break
        held = [F.when(F.col(f"i{x}"), _members(F.col(f"v{x}"), F.col(f"t{x}"))) for x in "cu"]
        each = deeper.select("d", "steps", F.explode(_met(*held)).alias("m"))
        level = each.select("d", F.concat("steps", F.array("m.step")).alias("steps"), *[c for x in "cu" for c in (F.col(f"m.v{x}"), F.to_json(f"m.v{x}").alias(f"t{x}"))])
    leaf = reduce(DataFrame.unionByName, found)
    return leaf.select("d.*", _path(F.col("steps")).alias("path"), "cache_value", "upstream_value")


def diff_hashes(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per differing entity with the hash of all its differences."""
    line = F.concat_ws("\x1f", "path", F.coalesce("cache_value", F.lit("\x00")), F.coalesce("upstream_value", F.lit("\x00")))
    return diffs.groupBy(*keys).agg(F.md5(F.concat_ws("\x1e", F.sort_array(F.collect_list(line)))).alias("diff_hash"), F.count(F.lit(1)).alias("fields"))


def merge_findings(state: DataFrame, found: DataFrame, checked: DataFrame, now: str) -> DataFrame:
    """The next findings (entity_key, diff_hash, occurrence_count, heal_completed, first_seen_at, resolved_at) and change.

    A new difference opens a finding; a known one is touched, and escalated with one occurrence more if its heal was
    completed and it still differs; an open finding of a checked entity that no longer differs so is resolved.
    """
    t = F.lit(now).cast("timestamp_ntz")
    s = state.withColumn("__s", F.lit(True))
    f = found.select("entity_key", "diff_hash").distinct().withColumn("__f", F.lit(True))
    c = checked.select("entity_key").distinct().withColumn("__c", F.lit(True))
    both = s.join(f, ["entity_key", "diff_hash"], "full").join(c, "entity_key", "left")
    live = F.col("__s").isNotNull() & F.col("resolved_at").isNull()
    change = (
        F.when(F.col("__f").isNotNull() & ~live, "opened")
        .when(F.col("__f").isNotNull() & F.coalesce("heal_completed", F.lit(False)), "escalated")
        .when(F.col("__f").isNotNull(), "touched")
        .when(live & F.col("__c").isNotNull(), "resolved")
        .otherwise("kept")
    )
    out = both.withColumn("change", change)
    return out.select(
        "entity_key", "diff_hash",
        F.when(F.col("change") == "opened", 1).when(F.col("change") == "escalated", F.col("occurrence_count") + 1).otherwise(F.col("occurrence_count")).cast("long").alias("occurrence_count"),
        F.when(F.col("change") == "opened", t).otherwise(F.col("first_seen_at")).alias("first_seen_at"),
        F.when(F.col("change") == "resolved", t).when(F.col("change") == "opened", None).otherwise(F.col("resolved_at")).alias("resolved_at"), "change",
    )


def exclude_in_flight(keys: DataFrame, generations: DataFrame) -> DataFrame:
    """Entities (refresh_key) without an outstanding refresh."""
    busy = generations.where("completed_generation < generation").select("refresh_key")
    return keys.join(busy, "refresh_key", "left_anti")


def convergence_report(families: dict[str, tuple[DataFrame, DataFrame, list[str], list[str]]]) -> DataFrame:
    """Per family (cache, truth, keys, fields): rows of either side, missing, extra and differing ones."""
    out = None
    for name, (cache, truth, keys, fields) in sorted(families.items()):
        c = cache.select(*keys, F.xxhash64(*fields).alias("ch"), F.lit(True).alias("c"))
        t = truth.select(*keys, F.xxhash64(*fields).alias("th"), F.lit(True).alias("t"))
        both = c.join(t, keys, "full")
        part = both.agg(
            F.lit(name).alias("family"), F.count("c").alias("cached"), F.count("t").alias("expected"), F.count_if(F.col("c").isNull()).alias("missing"),
            F.count_if(F.col("t").isNull()).alias("extra"), F.count_if(F.col("c").isNotNull() & F.col("t").isNotNull() & (F.col("ch") != F.col("th"))).alias("differing"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def coverage(repos: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Per repository the number of each kind of fact, and whether none is lacking."""
    out = repos.select("repo_id")
    for name, df in sorted(facts.items()):
        out = out.join(df.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name)), "repo_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("covered", reduce(lambda a, b: a & b, [F.col(n) > 0 for n in sorted(facts)]))
