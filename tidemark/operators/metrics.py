"""Health measures, histograms, objectives and alert rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import seconds_between
from .changes import after_counts
from .ordered import exact_quantiles


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def delivery_metrics(deliveries: DataFrame, generations: DataFrame, now: str) -> DataFrame:
    """One row: age of the oldest unprocessed delivery, parked ones and the oldest's age, outstanding generations and the oldest's age."""
    t = _ts(now)
    waiting = F.col("status").isin("pending", "processing")
    a = deliveries.agg(
        F.coalesce(seconds_between(t, F.min(F.when(waiting, F.col("received_at")))), F.lit(0.0)).alias("oldest_unprocessed_s"),
        F.count_if(F.col("status") == "parked").alias("parked"),
        F.coalesce(seconds_between(t, F.min(F.when(F.col("status") == "parked", F.col("received_at")))), F.lit(0.0)).alias("oldest_parked_s"),
    )
    out = F.col("completed_generation") < F.col("generation")
    b = generations.agg(F.count_if(out).alias("outstanding"), F.coalesce(seconds_between(t, F.min(F.when(out, F.col("event_received_at")))), F.lit(0.0)).alias("oldest_outstanding_s"))
    return a.withColumn("__one", F.lit(1)).join(b.withColumn("__one", F.lit(1)), "__one").drop("__one")


def staleness(tables: dict[str, DataFrame], now: str) -> DataFrame:
    """Per entity class the largest age since the last check of what is live; 0 if nothing is."""
    parts = [df.where("tombstoned_at is null").agg(F.lit(name).alias("entity_class"), F.coalesce(F.max(seconds_between(_ts(now), F.col("last_checked_at"))), F.lit(0.0)).alias("staleness_s")) for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts)


def staleness_breaches(ages: DataFrame, bounds: DataFrame) -> DataFrame:
    """Classes over the strictest positive bound set for them."""
    strict = bounds.where("bound_s > 0").groupBy("entity_class").agg(F.min("bound_s").alias("bound_s"))
    return ages.join(strict, "entity_class").where("staleness_s > bound_s")


def tombstones(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.lit(name).alias("kind"), F.count("tombstoned_at").alias("tombstones")) for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, parts)


def sweep_durations(passes: DataFrame, now: str) -> DataFrame:
    """Per kind the longest pass; an open one lasts until now."""
    return passes.groupBy("kind").agg(F.max(F.greatest(seconds_between(F.coalesce("finished_at", _ts(now)), F.col("started_at")), F.lit(0.0))).alias("duration_s"))


def with_total(df: DataFrame, by: list[str], total: str, measures: list[Column]) -> DataFrame:
    """Grouped measures with a row per group in which ``total`` is 'all'."""
    out = df.rollup(*by, total).agg(*measures, F.grouping_id().alias("__g"))
    return out.where("__g <= 1").withColumn(total, F.when(F.col("__g") == 1, "all").otherwise(F.col(total))).drop("__g")


def drift_counts(findings: DataFrame) -> DataFrame:
    state = F.when(F.col("resolved_at").isNull(), "open").otherwise("resolved")
    return with_total(findings.withColumn("state", state), ["state"], "entity_kind", [F.count(F.lit(1)).alias("n")])


def stream_metrics(events: DataFrame, safe: DataFrame, cutoff: str) -> DataFrame:
    """Per stream and for all: how far the watermark lags, and how much retention may prune."""
    e = events.join(F.broadcast(safe), "stream")
    old = (F.col("occurred_at") < _ts(cutoff)) & (F.col("seq") <= F.col("safe_seq"))
    return with_total(e.withColumn("__k", F.lit(1)), ["__k"], "stream", [F.count_if(F.col("seq") > F.col("safe_seq")).alias("lag"), F.count_if(old).alias("prunable")]).drop("__k")


def consumer_lag(cursors: DataFrame, events: DataFrame, safe: DataFrame, now: str) -> DataFrame:
    """Per consumer and stream: outstanding events and the oldest's age, from running counts."""
    e = events.join(safe, "stream").where("seq <= safe_seq").select("stream", "seq", "occurred_at")
    last = cursors.groupBy("consumer", "stream").agg(F.min("cursor_seq").alias("after_seq"))
    met = last.join(after_counts(e, last), ["stream", "after_seq"], "left")
    return met.select("consumer", "stream", F.coalesce("outstanding", F.lit(0)).alias("outstanding"), F.coalesce(seconds_between(_ts(now), F.col("oldest")), F.lit(0.0)).alias("oldest_s"))


def backlogs(dirty: DataFrame, jobs: DataFrame) -> DataFrame:
    """Dirty scopes, and waiting jobs per queue."""
    waiting = jobs.where(F.col("state").isin("available", "scheduled", "retryable", "pending"))
    return dirty.agg(F.lit("dirty").alias("backlog"), F.count(F.lit(1)).alias("n")).unionByName(waiting.groupBy(F.concat(F.lit("queue:"), "queue").alias("backlog")).agg(F.count(F.lit(1)).alias("n")))


def heartbeats(expected: DataFrame, state: DataFrame, now: str) -> DataFrame:
    """Age of the last success of every expected operation; -1 if there was none."""
    s = state.groupBy("component", "operation").agg(F.max("succeeded_at").alias("succeeded_at"), F.sum("successes").alias("successes"))
    out = F.broadcast(expected).join(s, ["component", "operation"], "left")
    return out.select("component", "operation", F.coalesce(seconds_between(_ts(now), F.col("succeeded_at")), F.lit(-1.0)).alias("age_s"), F.coalesce("successes", F.lit(0)).alias("successes"))


def budget_audit(df: DataFrame, floor: float = 0.2) -> DataFrame:
    """Whether spending ``cost`` would leave less than the floor of the limit; -1 for what isn't known."""
    left = F.col("remaining") - F.col("cost")
    return df.withColumns({"remaining": F.coalesce("remaining", F.lit(-1)), "limit_n": F.coalesce("limit_n", F.lit(-1)), "gate_closed": F.coalesce(left < F.ceil(F.col("limit_n") * floor), F.lit(False)), "starved": F.coalesce(F.col("waited_s") > F.col("max_wait_s"), F.lit(False))})


def latency(df: DataFrame) -> DataFrame:
    """Event-to-cache latency in seconds of what was committed; a negative one is invalid. Superseded and failed work is left out."""
    s = seconds_between(F.col("committed_at"), F.col("received_at"))
    return df.where(F.col("outcome") == "committed").withColumns({"latency_s": F.when(s >= 0, s), "invalid": s < 0})


def histogram(df: DataFrame, value: str, bounds: list[float], by: list[str] | None = None) -> DataFrame:
    """Cumulative buckets (le, n) of a value; the last bound is infinite."""
    sums = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    agg = df.groupBy(*(by or [])).agg(*sums, F.count(value).alias("all"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return agg.select(*(by or []), F.explode(rows).alias("r")).select(*(by or []), "r.*")


def hist_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Growth of each bucket; regressed where one shrank."""
    return after.join(before.select("le", F.col("n").alias("n0")), "le", "left").select("le", (F.col("n") - F.coalesce("n0", F.lit(0))).alias("n"), (F.col("n") < F.coalesce("n0", F.lit(0))).alias("regressed"))


def hist_merge(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select("le", "n") for p in parts]).groupBy("le").agg(F.sum("n").alias("n"))


def hist_quantile(hist: DataFrame, quantiles: list[float]) -> DataFrame:
    """The upper bound of the first bucket that reaches each quantile."""
    total = hist.agg(F.max("n").alias("total"))
    wanted = hist.sparkSession.createDataFrame([(q,) for q in quantiles], "q double").withColumn("__one", F.lit(1))
    at = F.broadcast(wanted.join(total.withColumn("__one", F.lit(1)), "__one"))
    return at.join(F.broadcast(hist), F.col("n") >= F.ceil(F.col("total") * F.col("q"))).groupBy("q").agg(F.min("le").alias("value"))


def slo_check(latencies: DataFrame, value: str, objectives: dict[float, float]) -> DataFrame:
    """Exact percentiles against their objectives; none without values."""
    found = exact_quantiles(latencies, [], value, sorted(objectives))
    bound = F.create_map(*[F.lit(float(x)) for q in sorted(objectives) for x in (q, objectives[q])])[F.col("q")]
    return found.select("q", F.col(value).alias("value_s"), bound.alias("bound_s"), (F.col(value) <= bound).alias("met"))


def endpoint_family(path: Column) -> Column:
    """A request path as one of few families."""
    p = F.split(F.regexp_replace(path, r"[?#].*$", ""), "/")
    kind = F.get(p, F.lit(4))
    return (
        F.when(path.startswith("/graphql"), "graphql")
        .when(path.startswith("/app/installations"), "installations")
        .when(~path.startswith("/repos/"), "other")
        .when(kind.isNull() | (kind == ""), "repository")
        .when(kind == "pulls", F.when(F.get(p, F.lit(6)) == "files", "pull_files").otherwise("pulls"))
        .when(kind == "commits", F.when(F.get(p, F.lit(6)).isin("check-runs", "check-suites"), "checks").otherwise("commits"))
        .when(kind == "contents", "contents")
        .when(kind == "rulesets", "rules")
        .otherwise("other")
    )


def outcome_class(status: Column) -> Column:
    return F.when(status == 304, "not_modified").when(status.between(200, 299), "ok").when(status.isin(403, 429), "limited").when(status.between(400, 499), "client_error").when(status >= 500, "server_error").otherwise("other")


def attribute_requests(df: DataFrame) -> DataFrame:
    return df.groupBy("auth_context", endpoint_family(F.col("path")).alias("family"), outcome_class(F.col("status")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def hit_ratio(requests: DataFrame, window: str = "15 minutes") -> DataFrame:
    """Share of conditional requests answered from the validator, per class, resource and window; none without requests."""
    w = F.window(F.col("at"), window)
    return requests.where("conditional").groupBy("class", "resource", w.alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == 304).alias("hits")).select("class", "resource", F.col("w.start").alias("start"), "requests", (F.col("hits") / F.col("requests")).alias("ratio"))


def reject_ratio(df: DataFrame) -> DataFrame:
    return df.groupBy("entity_kind").agg(F.count(F.lit(1)).alias("writes"), F.avg(F.col("rejected").cast("double")).alias("ratio"))


def heal_audit(dropped: DataFrame, log: DataFrame, bound_s: float) -> DataFrame:
    """Dropped deliveries: whether they came again, were processed, and soon enough."""
    first = log.groupBy("delivery_guid").agg(F.min_by(F.struct("status", "received_at"), F.struct("received_at", "arrival")).alias("r"))
    out = dropped.select("delivery_guid", "dropped_at").join(first, "delivery_guid", "left")
    delay = seconds_between(F.col("r.received_at"), F.col("dropped_at"))
    verdict = F.when(F.col("r").isNull(), "not healed").when(F.col("r.status") != "processed", "not processed").when(delay > bound_s, "late").otherwise("healed")
    return out.select("delivery_guid", verdict.alias("verdict"))


def run_status(guids: DataFrame, log: DataFrame, outstanding: DataFrame) -> DataFrame:
    """Deliveries of a run: total, arrived, processed; drained if all are and nothing is outstanding."""
    l = log.groupBy("delivery_guid").agg(F.max((F.col("status") == "processed").cast("int")).alias("done"))
    a = guids.join(l, "delivery_guid", "left").agg(F.count(F.lit(1)).alias("total"), F.count("done").alias("arrived"), F.coalesce(F.sum("done"), F.lit(0)).alias("processed")).withColumn("__one", F.lit(1))
    o = outstanding.agg(F.count_if(F.col("completed_generation") < F.col("generation")).alias("outstanding")).withColumn("__one", F.lit(1))
    return a.join(o, "__one").drop("__one").withColumn("drained", (F.col("processed") == F.col("total")) & (F.col("outstanding") == 0))


def trust_verdict(checks: DataFrame) -> DataFrame:
    """One row over (aspect, good): the aspects that fail, and the verdict."""
    return checks.agg(F.array_join(F.array_sort(F.collect_list(F.when(~F.col("good"), F.col("aspect")))), ",").alias("failing"), F.bool_and("good").alias("trusted"))
