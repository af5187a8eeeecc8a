"""Alert rules over metric samples: one table of conditions, evaluated for all rules together."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import scratch


def _pass_missing(component: str, operation: str, bound: int, sampled: bool = True) -> list[dict]:
    at = {"component": component, "operation": operation}
    names = ["last_operation_success_age_seconds", *(["last_operation_sample_age_seconds"] if sampled else [])]
    return [{"metric": n, "labels": at, **test} for n in names for test in ({"op": "<", "value": 0}, {"op": ">", "value": bound}, {"absent": True})]


#: fixed values: rule name, for (minutes), severity, and the conditions of which one suffices. A condition tests a
#: metric's value, its increase over minutes, a ratio of two increases, a quantile of buckets, another metric as bound, or
#: absence; ``also`` must hold too. ``on`` names the labels that samples are grouped and matched by; without it all are.
ALERT_RULES: list[tuple[str, int, str, list[dict]]] = [
    ("conditional_hit_rate_low", 15, "warning", [
        {"ratio": ("conditional_304s_total", "conditional_requests_total"), "labels": {"class": "sweep", "resource": "rest"}, "minutes": 15, "op": "<", "value": 0.80},
        {"metric": "conditional_requests_total", "labels": {"class": "sweep", "resource": "rest"}, "absent": True}, {"metric": "conditional_304s_total", "labels": {"class": "sweep", "resource": "rest"}, "absent": True}]),
    ("budget_class_starved", 0, "page", [{"metric": "starvations_total", "on": ["class", "resource", "auth_context"], "minutes": 5, "op": ">", "value": 0}, {"metric": "starvations_total", "absent": True}]),
    ("secondary_gate_closed", 5, "page", [{"metric": "gate_closed", "on": ["installation_id", "resource", "auth_context"], "op": "==", "value": 1}, {"metric": "gate_closed", "absent": True}]),
    ("event_cache_p95_breach", 10, "page", [{"quantile": 0.95, "metric": "event_to_cache_latency_seconds_bucket", "minutes": 10, "op": ">", "value": 20}, {"metric": "event_to_cache_latency_seconds_bucket", "absent": True}]),
    ("event_cache_p99_breach", 10, "page", [{"quantile": 0.99, "metric": "event_to_cache_latency_seconds_bucket", "minutes": 10, "op": ">", "value": 60}, {"metric": "event_to_cache_latency_seconds_bucket", "absent": True}]),
    ("invalid_event_cache_clock", 0, "page", [{"metric": "invalid_event_cache_latency_total", "minutes": 5, "op": ">", "value": 0}, {"metric": "invalid_event_cache_latency_total", "absent": True}]),
    ("oldest_delivery_too_old", 5, "page", [{"metric": "oldest_unprocessed_delivery_age_seconds", "op": ">", "value": 60}, {"metric": "oldest_unprocessed_delivery_age_seconds", "absent": True}]),
    ("outstanding_generation_too_old", 5, "page", [{"metric": "oldest_outstanding_generation_age_seconds", "op": ">", "value": 60}, {"metric": "oldest_outstanding_generation_age_seconds", "absent": True}, {"metric": "outstanding_generations", "absent": True}]),
    ("event_queue_backlog", 5, "warning", [{"metric": "queue_depth", "labels": {"queue": "event"}, "op": ">", "value": 1000}, {"metric": "queue_depth", "labels": {"queue": "event"}, "absent": True}]),
    ("poison_delivery_parked", 1, "page", [{"metric": "parked_deliveries", "op": ">", "value": 0, "also": {"metric": "oldest_parked_delivery_age_seconds", "op": ">", "value": 300}, "on": []}, {"metric": "parked_deliveries", "absent": True}, {"metric": "oldest_parked_delivery_age_seconds", "absent": True}]),
    ("cache_staleness_bound_breached", 2, "page", [{"metric": "cache_staleness_seconds", "above": "staleness_bound_seconds", "on": ["entity_class"]}, {"metric": "cache_staleness_seconds", "absent": True}, {"metric": "staleness_bound_seconds", "absent": True}]),
    ("sweep_overrun", 0, "page", [{"metric": "sweep_overruns_total", "minutes": 15, "op": ">", "value": 0}, {"metric": "sweep_duration_seconds", "above": "sweep_period_seconds", "on": ["sweep_kind"]}, {"metric": "sweep_duration_seconds", "absent": True}, {"metric": "sweep_period_seconds", "absent": True}]),
    ("stack_sweep_missing", 5, "page", _pass_missing("sweep", "stacks", 675)),
    ("pull_request_sweep_missing", 5, "page", _pass_missing("sweep", "pull_requests", 1350)),
    ("repo_rules_sweep_missing", 5, "page", _pass_missing("sweep", "repo_rules", 8100)),
    ("repository_sweep_missing", 5, "page", _pass_missing("sweep", "repositories", 8100)),
    ("closed_sweep_missing", 5, "page", _pass_missing("sweep", "closed_tracked", 194400)),
    ("drift_open", 1, "page", [{"metric": "drift_findings", "labels": {"state": "open", "entity_kind": "all"}, "op": ">", "value": 0}, {"metric": "drift_findings", "labels": {"state": "open", "entity_kind": "all"}, "absent": True}]),
    ("drift_pass_missing", 5, "page", _pass_missing("drift", "detector", 7200)),
    ("watermark_stalled", 2, "page", [{"metric": "watermark_lag_sequences", "op": ">", "value": 0, "also": {"metric": "watermark_age_seconds", "op": ">", "value": 30}}, {"metric": "watermark_lag_sequences", "absent": True}, {"metric": "watermark_age_seconds", "absent": True}]),
    ("watermark_pass_missing", 2, "page", _pass_missing("watermarker", "entities", 30)),
    ("outbox_backlog", 15, "warning", [{"metric": "prunable_outbox_depth", "labels": {"stream": "all"}, "op": ">", "value": 100000}, {"metric": "prunable_outbox_depth", "labels": {"stream": "all"}, "absent": True}]),
    ("consumer_cursor_stalled", 5, "warning", [{"metric": "consumer_outstanding_events", "op": ">", "value": 10000, "also": {"metric": "oldest_outstanding_event_age_seconds", "op": ">", "value": 300}, "on": ["consumer", "stream"]}]),
    ("consumer_metrics_absent", 5, "warning", [{"metric": "consumer_outstanding_events", "absent": True}, {"metric": "oldest_outstanding_event_age_seconds", "absent": True}]),
    ("resync_storm", 0, "page", [{"metric": "resyncs_total", "minutes": 15, "op": ">", "value": 3}]),
    ("deriver_backlog", 10, "warning", [{"metric": "deriver_dirty_backlog", "op": ">", "value": 500}, {"metric": "deriver_dirty_backlog", "absent": True}]),
    ("deriver_pass_missing", 2, "page", _pass_missing("deriver", "dirty_sets", 30, sampled=False)),
    ("required_role_absent", 2, "page", [{"metric": "role_enabled", "labels": {"role": r}, "absent": True} for r in ("metrics", "ingress", "fetch", "sweep", "drift", "dispatch", "pruner", "watermarker", "deriver")]),
]


CONDITIONS = "cond int, rule string, severity string, needs int, form string, op string, bound double, op2 string, bound2 double, quantile double, absent_key string"
USES = "cond int, side string, sel int"
#: Steps of a series that one group of a window has at least.
STRETCH = 4096


def label_key(labels: dict[str, str]) -> str:
    """Labels as one text, sorted by name."""
    return ",".join(f"{k}={v}" for k, v in sorted(labels.items()))


def compile_rules(rules: list[tuple[str, int, str, list[dict]]], step_s: int) -> tuple[list[tuple], list[tuple]]:
    """Rules as rows of ``CONDITIONS`` and of selectors (cond, side, metric, want, by, steps): what to test, and which samples each side of a test reads."""
    conditions, selectors = [], []
    flat: Iterator[tuple] = ((name, severity, minutes * 60 // step_s, c) for name, minutes, severity, cs in rules for c in cs)
    for i, (rule, severity, needs, c) in enumerate(flat):
        labels, by, also = c.get("labels") or {}, c.get("on"), c.get("also") or {}
        steps = c["minutes"] * 60 // step_s if "minutes" in c else None
        form = next((f for f in ("absent", "ratio", "quantile", "above", "also") if f in c), "value")
        sides = {"a": c["ratio"][0] if form == "ratio" else c["metric"]}
        if form in ("ratio", "above", "also"):
            sides["b"] = c["ratio"][1] if form == "ratio" else c["above"] if form == "above" else also["metric"]
        if form in ("ratio", "quantile"):
            by = ["le"] if form == "quantile" else []
        conditions.append((i, rule, severity, needs, form, c.get("op"), _float(c.get("value")), also.get("op"), _float(also.get("value")), c.get("quantile"), label_key(labels) if form == "absent" else None))
        for side, name in sides.items():
            want = (also.get("labels") or {}) if form == "also" and side == "b" else labels
            selectors.append((i, side, name, list(want.items()), None if by is None else sorted(by), None if steps is None else max(steps, 1)))
    return conditions, selectors


def _float(x: float | None) -> float | None:
    return None if x is None else float(x)


def _test(value: Column, op: Column, bound: Column) -> Column:
    return F.when(op == "<", value < bound).when(op == ">", value > bound).when(op == "==", value == bound)


def shared_selectors(conditions: list[tuple], selectors: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """``selectors`` of ``compile_rules`` as rows, each different one once (sel, metric, want, by, steps), and who uses them: rows of ``USES``.

    Conditions on absence ask only whether there is anything, so another condition's selector of the same samples does.
    """
    absent = {c[0] for c in conditions if c[4] == "absent"}
    chosen: dict[tuple, int] = {}
    uses = []
    for cond, side, metric, want, by, steps in sorted(selectors, key=lambda s: s[0] in absent):
        samples = (metric, tuple(sorted(want)))
        how = (*samples, None if by is None else tuple(by), steps)
        known = next((n for other, n in chosen.items() if other[:2] == samples), None) if cond in absent else None
        uses.append((cond, side, chosen.setdefault(how, len(chosen)) if known is None else known))
    return [(n, metric, list(want), None if by is None else list(by), steps) for (metric, want, by, steps), n in chosen.items()], uses


def _last_of_step(samples: DataFrame, step_s: int) -> DataFrame:
    slot = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / (step_s * 1_000_000))
    # a number first that nearly tells series and steps, so that sorting compares few names and labels
    near = F.shiftleft(F.xxhash64("name", F.sort_array(F.map_entries("labels"))), 32).bitwiseOR(slot.bitwiseAND(0xFFFFFFFF)).alias("near")
    return samples.select(near, slot.alias("slot"), "name", "labels", "at", "value").groupBy("near", "name", "labels", "slot").agg(F.max(F.struct("at", "value"))["value"].alias("value")).drop("near")


def on_grid(samples: DataFrame, step_s: int) -> DataFrame:
    """Samples (at, name, labels map, value) as one row per series and step, the last of a step; ``grown`` is the growth since the step before. A counter that falls was reset and counts from 0."""
    last = _last_of_step(samples, step_s).withColumn("series", F.sort_array(F.map_entries("labels")).cast("string"))
    step = F.col("value") - F.lag("value").over(Window.partitionBy("name", "series").orderBy("slot"))
    return last.withColumn("grown", F.when(step < 0, F.col("value")).otherwise(F.coalesce(step, F.lit(0.0))))


def _quantiles(buckets: DataFrame, asked: DataFrame) -> DataFrame:
    """(cond, slot, a): the quantiles ``asked`` (cond, sel, quantile) of cumulative buckets (sel, key, slot, x), by straight lines within a bucket; above the last finite bound it is that bound."""
    b = buckets.withColumn("le", F.substring_index("key", "=", -1).try_cast("double")).where("le is not null")
    of = Window.partitionBy("sel", "slot")
    below = of.orderBy("le")
    b = b.withColumns({"below": F.lag("le").over(below), "n0": F.coalesce(F.lag("x").over(below), F.lit(0.0)), "total": F.max("x").over(of), "top": F.max("le").over(of)})
    b = b.where((F.col("top") == float("inf")) & (F.col("total") > 0)).join(asked, "sel")
    rank = F.col("quantile") * F.col("total")
    start = F.coalesce("below", F.lit(0.0))
    inside = start + (F.col("le") - start) * (rank - F.col("n0")) / (F.col("x") - F.col("n0"))
    at = F.when(F.col("le") == float("inf"), F.col("below")).otherwise(inside)
    return b.where(F.col("x") >= rank).groupBy("cond", "slot").agg(F.min_by(at, "le").alias("a"))


def _increases(met: DataFrame, lengths: dict[int, list[int]]) -> DataFrame:
    """(sel, key, slot, x): what ``grown`` of ``met`` adds up to over the steps of each selector; ``lengths`` has the selectors of each number of steps.

    Steps are dealt to stretches, and the last steps of a stretch are given to the next one too, so that a series of any length is spread.
    """
    reach = max(lengths, default=1)
    size = max(STRETCH, reach)
    own = F.floor(F.col("slot") / size)
    into = F.when(F.pmod("slot", F.lit(size)) > size - reach, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = met.where(F.col("sel").isin([n for ns in lengths.values() for n in ns])).select("sel", "key", "slot", "grown", F.explode(into).alias("stretch"))
    series = Window.partitionBy("sel", "key", "stretch").orderBy("slot")
    x = reduce(lambda c, n: c.when(F.col("sel").isin(lengths[n]), F.sum("grown").over(series.rangeBetween(1 - n, 0))), sorted(lengths), F.when(F.lit(False), F.col("grown")))
    return dealt.withColumn("x", x).where(F.col("stretch") == own).select("sel", "key", "slot", "x")


def holding(samples: DataFrame, rules: list | None = None, step_s: int = 60) -> DataFrame:
    """(rule, severity, needs, labels, slot): the steps at which a condition of a rule holds for a set of labels.

    Rules become small tables. Samples meet the different selectors of all conditions in one broadcast join on the metric's
    name, a series and step giving one row to each, and are written; where a selector groups labels, its rows are
    summed up. Any number of conditions tests the same rows, so the plan doesn't grow with the rules; only the
    windows of increases are one column for each length that occurs. Samples are read twice, metrics whose increases are asked for and others,
    since only the former are sorted by series; what is there at a step is a bit for each selector, and steps of samples that
    no rule reads count as times. Null labels or values of samples are left out; without samples no rule holds, absence included.
    """
    spark: SparkSession = samples.sparkSession
    conditions, selectors = compile_rules(ALERT_RULES if rules is None else rules, step_s)
    chosen, uses = shared_selectors(conditions, selectors)
    cond = spark.createDataFrame(conditions, CONDITIONS)
    use = cond.join(F.broadcast(spark.createDataFrame(uses, USES)), "cond")
    known = samples.where("at is not null and name is not null and labels is not null and value is not null")
    counted = F.col("name").isin(sorted({metric for _, metric, _, _, steps in chosen if steps is not None}))
    grid = on_grid(known.where(counted), step_s).drop("series").unionByName(_last_of_step(known.where(~counted), step_s).withColumn("grown", F.lit(0.0)))

    # a row meets the label names that its metric's selectors want, then the values wanted of these: one candidate for each set of names
    shapes = sorted({(metric, tuple(sorted(k for k, _ in want))) for _, metric, want, _, _ in chosen})
    most_wanted, most_by = max((len(names) for _, names in shapes), default=0), max((len(s[3] or []) for s in chosen), default=0)
    valued = [(n, shapes.index((metric, tuple(k for k, _ in sorted(want)))), by, *[v for _, v in sorted(want)], *[""] * (most_wanted - len(want))) for n, metric, want, by, _ in chosen]
    names = spark.createDataFrame([(i, *shape) for i, shape in enumerate(shapes)], "shape int, name string, names array<string>")
    sel = spark.createDataFrame(valued, ", ".join(["sel int", "shape int", "by array<string>", *[f"v{i} string" for i in range(most_wanted)]]))
    values = [F.when(F.size("names") <= i, "").otherwise(F.try_element_at("labels", F.get("names", F.lit(i)))).alias(f"v{i}") for i in range(most_wanted)]
    by = [F.get("by", F.lit(i)) for i in range(most_by)]
    grouped = F.concat_ws(",", *[F.concat(k, F.lit("="), F.coalesce(F.try_element_at("labels", k), F.lit(""))) for k in by])
    entries = F.map_entries("labels")
    texts = F.transform(F.sort_array(entries), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    whole = F.when(F.size("labels") == 0, "").when(F.size("labels") == 1, F.concat(entries[0]["key"], F.lit("="), entries[0]["value"])).otherwise(F.array_join(texts, ","))
    key = F.when(F.col("sel").isNull(), "").when(F.col("by").isNotNull(), grouped).otherwise(whole)
    probed = grid.join(F.broadcast(names), "name", "left").select("labels", "slot", "value", "grown", "shape", *values)
    alone = F.col("sel").isNotNull() & F.col("by").isNull()
    told = probed.join(F.broadcast(sel), ["shape", *[f"v{i}" for i in range(most_wanted)]], "left").select(F.coalesce("sel", F.lit(-1)).alias("sel"), key.alias("key"), alone.alias("alone"), "slot", "value", "grown")
    path = scratch(spark, "steps")
    told.write.option("compression", "zstd").parquet(path)
    told = spark.read.schema(told.schema).parquet(path)
    # a selector that doesn't group has one row per series and step already
    summed = told.where("not alone and sel >= 0").groupBy("sel", "key", "slot").agg(F.max("value").alias("value"), F.sum("grown").alias("grown"))
    met = told.where("alone").select("sel", "key", "slot", "value", "grown").unionByName(summed)

    lengths = {steps: [s[0] for s in chosen if s[4] == steps] for steps in {s[4] for s in chosen} - {None}}
    values = met.where(F.col("sel").isin([s[0] for s in chosen if s[4] is None])).select("sel", "key", "slot", F.col("value").alias("x"))
    x = values.unionByName(_increases(met, lengths)) if lengths else values

    a, b = F.col("a"), F.col("b")
    plain = _test(a, F.col("op"), F.col("bound"))
    said = ("rule", "severity", "needs")
    held = x.withColumnRenamed("x", "a").join(F.broadcast(use.where("form = 'value'")), "sel").where(plain).select(*said, "key", "slot")

    tests = F.broadcast(cond.where("form in ('ratio', 'above', 'also')"))
    passed = F.when(F.col("form") == "ratio", (b > 0) & _test(a / F.nullif(b, F.lit(0.0)), F.col("op"), F.col("bound"))).when(F.col("form") == "above", a > b).otherwise(plain & _test(b, F.col("op2"), F.col("bound2")))
    sided = x.join(F.broadcast(use.where("form in ('ratio', 'above', 'also')").select("sel", "cond", "side")), "sel")
    paired = sided.groupBy("cond", "key", "slot").agg(F.max(F.when(F.col("side") == "a", F.col("x"))).alias("a"), F.max(F.when(F.col("side") == "b", F.col("x"))).alias("b"))
    both = paired.join(tests, "cond").where(passed).select(*said, "key", "slot")

    of_buckets = F.broadcast(use.where("form = 'quantile'"))
    bucketed = x.where(F.col("sel").isin([n for c, _, n in uses if conditions[c][4] == "quantile"]))
    quantiles = _quantiles(bucketed, of_buckets.select("cond", "sel", "quantile")).join(of_buckets, "cond").where(plain).select(*said, F.lit("").alias("key"), "slot")

    words = [F.coalesce(F.bit_or(F.when((F.col("sel") >= w) & (F.col("sel") < w + 63), F.expr(f"shiftleft(1L, sel - {w})"))), F.lit(0).cast("long")) for w in range(0, len(chosen), 63)]
    there = told.groupBy("slot").agg(F.array(*words).alias("there"))
    asked = [F.struct(*[F.lit(v).alias(k) for k, v in zip((*said, "key"), (*conditions[c][1:4], conditions[c][10]), strict=True)], F.lit(n).alias("sel")) for c, _, n in uses if conditions[c][4] == "absent"]
    none = F.array().cast("array<struct<rule:string,severity:string,needs:int,key:string,sel:int>>")
    gone = there.select("slot", F.explode(F.filter(F.array(*asked) if asked else none, lambda c: F.call_function("shiftright", F.get("there", F.floor(c["sel"] / 63).cast("int")), c["sel"] % 63).bitwiseAND(F.lit(1)) == 0)).alias("c")).select("c.rule", "c.severity", "c.needs", "c.key", "slot")
    return held.unionByName(both).unionByName(quantiles).unionByName(gone).distinct().withColumnRenamed("key", "labels")


def evaluate_alerts(samples: DataFrame, rules: list | None = None, step_s: int = 60) -> DataFrame:
    """Intervals during which rules fire: rule, severity, labels, from_us, to_us.

    ``samples`` (at, name, labels map, value) are put on a grid of ``step_s``. A rule fires for a set of labels once a
    condition of it held over as many steps as it must; runs of steps are found by gaps and islands. Absence is judged at
    every step that has any sample, and stands for the labels that were asked for.
    """
    every = holding(samples, rules, step_s)
    island = F.col("slot") - F.row_number().over(Window.partitionBy("rule", "labels").orderBy("slot"))
    runs = every.withColumn("island", island).groupBy("rule", "severity", "needs", "labels", "island").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    step = step_s * 1_000_000
    return runs.where("b - a >= needs").select("rule", "severity", "labels", ((F.col("a") + F.col("needs")) * step).alias("from_us"), (F.col("b") * step).alias("to_us"))
