"""All alert rules over metric samples that the events give: two samples a minute of every series that a rule reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import run_sql
from ..operators import alerts
from .registry import query

BUCKETS = {"5": 0.5, "20": 0.9, "30": 0.97, "60": 0.985, "120": 0.995, "+Inf": 1.0}
COLUMNS = "i, n, name, lkey, form, low, high, share"


def series() -> list[tuple]:
    """(i, n, name, lkey, form, low, high, share) of every series that a rule reads, with two for each label that rules group by; n counts metrics, which are there or missing with all their series."""
    found: dict[tuple[str, str], tuple] = {}

    def add(name: str, labels: dict, on: list[str] | None, form: str, low: float, high: float) -> None:
        form = "counter" if name.endswith("_total") else form
        for side in ("x", "y") if on else ("",):
            key = alerts.label_key({**labels, **{k: side for k in on or []}})
            found.setdefault((name, key), (form, low, high, 0.0))

    for _rule, _minutes, _severity, conditions in alerts.ALERT_RULES:
        for c in conditions:
            labels, on = c.get("labels") or {}, c.get("on")
            if "ratio" in c:
                add(c["ratio"][1], labels, None, "counter", 0, 0)
                found[(c["ratio"][0], alerts.label_key(labels))] = ("hits", 0.0, 0.0, 0.0)
            elif "quantile" in c:
                for le, share in BUCKETS.items():
                    found.setdefault((c["metric"], f"le={le}"), ("bucket", 0.0, 0.0, share))
            elif "above" in c:
                add(c["metric"], labels, on, "gauge", 1.0, 1000.0)
                add(c["above"], labels, on, "flag", 500.0, 500.0)
            elif not c.get("absent"):
                for part in (c, *([c["also"]] if "also" in c else [])):
                    form = "flag" if part["op"] == "==" else "beat" if part["metric"].startswith("last_operation") else "gauge"
                    if part["op"] != "<":
                        add(part["metric"], part.get("labels") or {}, on, form, 0.0 if form == "flag" else part["value"] / 2, part["value"] + (form != "flag"))
    for _rule, _minutes, _severity, conditions in alerts.ALERT_RULES:
        for c in conditions:
            if c.get("absent") and not any(name == c["metric"] and set(alerts.label_key(c.get("labels") or {}).split(",")) <= {"", *key.split(",")} for name, key in found):
                add(c["metric"], c.get("labels") or {}, None, "flag", 1.0, 1.0)
    names = sorted({name for name, _ in found})
    return [(i, names.index(name), name, key, form, float(low), float(high), share) for i, ((name, key), (form, low, high, share)) in enumerate(found.items())]


SERIES = series()
HIGH = "(t + 17 * i) % 180 < 20 + 7 * (i % 5)"
VALUE = f"""CASE form WHEN 'counter' THEN floor(least((t + 17 * i) % 500, 200) / 2) WHEN 'hits' THEN floor(least(t % 500, 90) * 0.45 + greatest(0, t % 500 - 90) * 0.2)
 WHEN 'bucket' THEN floor(least(t % 500, 200) * 10 * share) + 10 * greatest(0, t % 500 - 200) WHEN 'flag' THEN CASE WHEN {HIGH} THEN high ELSE low END
 WHEN 'beat' THEN CASE WHEN NOT ({HIGH}) THEN low WHEN floor(t / 180) % 2 = 0 THEN high ELSE -1 END ELSE CASE WHEN {HIGH} THEN high + u % 3 ELSE low END END"""
THERE = "(t + 29 * n) % 400 >= 12 + 6 * (n % 3)"
EVENTS = "SELECT TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 30 SECOND * CAST(event_id AS INT) AS sampled_at, CAST(floor(event_id / 2) AS BIGINT) AS t, user_id AS u FROM events"


def samples(spark, sf):
    """(at, name, labels, value): every event gives one sample of each series that is there at its time.

    An event makes many samples, so events are dealt over all tasks first, those of a minute together; their files alone may be a task or two.
    """

    def labels(key: str):
        pairs = [F.lit(x) for part in key.split(",") if part for x in part.split("=", 1)]
        return (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("labels")

    rows = F.array(*[F.struct(*[labels(v) if c == "lkey" else F.lit(v).alias(c) for c, v in zip(COLUMNS.split(", "), s, strict=True)]) for s in SERIES])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = run_sql(spark, sf, EVENTS).repartition(n, "t").select("sampled_at", "t", "u", F.explode(rows).alias("s")).select("sampled_at", "t", "u", "s.*").where(THERE)
    return each.select(F.col("sampled_at").alias("at"), "name", "labels", F.expr(VALUE).cast("double").alias("value"))


def _where(name: str, labels: dict) -> str:
    return " AND ".join([f"name = '{name}'", *[f"(',' || lkey || ',') LIKE '%,{k}={v},%'" for k, v in labels.items()]])


def _key(on: list[str] | None) -> str:
    if on is None:
        return "lkey"
    return " || ',' || ".join(f"'{k}=' || regexp_extract(',' || lkey || ',', ',{k}=([^,]*),', 1)" for k in sorted(on)) or "''"


def _value(name: str, labels: dict, on: list[str] | None, minutes: int | None) -> str:
    per = f"SELECT slot, {_key(on)} AS k, max(value) AS value, sum(grown) AS grown FROM g WHERE {_where(name, labels)} GROUP BY 1, 2"
    if minutes is None:
        return f"SELECT slot, k, value AS x FROM ({per})"
    return f"SELECT slot, k, sum(grown) OVER (PARTITION BY k ORDER BY slot RANGE BETWEEN {minutes - 1} PRECEDING AND CURRENT ROW) AS x FROM ({per})"


def _holds(c: dict) -> str:
    """DuckDB's rows (k, slot) at which a condition holds."""
    labels, on, minutes, op = c.get("labels") or {}, c.get("on"), c.get("minutes"), {"==": "="}.get(c.get("op"), c.get("op"))
    if c.get("absent"):
        return f"SELECT '{alerts.label_key(labels)}' AS k, slot FROM (SELECT DISTINCT slot FROM g) WHERE slot NOT IN (SELECT slot FROM g WHERE {_where(c['metric'], labels)})"
    if "ratio" in c:
        a, b = (_value(n, labels, [], minutes) for n in c["ratio"])
        return f"SELECT a.k, a.slot FROM ({a}) a JOIN ({b}) b USING (slot) WHERE b.x > 0 AND a.x / b.x {op} {c['value']}"
    if "quantile" in c:
        q, inner = c["quantile"], _value(c["metric"], labels, ["le"], minutes)
        b = f"SELECT slot, CASE WHEN k = 'le=+Inf' THEN CAST('inf' AS DOUBLE) ELSE CAST(substr(k, 4) AS DOUBLE) END AS le, x FROM ({inner})"
        w = f"SELECT *, lag(le) OVER (PARTITION BY slot ORDER BY le) AS le0, coalesce(lag(x) OVER (PARTITION BY slot ORDER BY le), 0.0) AS x0, max(x) OVER (PARTITION BY slot) AS total, max(le) OVER (PARTITION BY slot) AS top FROM ({b})"
        f = f"SELECT *, row_number() OVER (PARTITION BY slot ORDER BY le) AS nth FROM ({w}) WHERE total > 0 AND isinf(top) AND x >= {q} * total"
        return f"SELECT '' AS k, slot FROM ({f}) WHERE nth = 1 AND CASE WHEN isinf(le) THEN le0 ELSE coalesce(le0, 0) + (le - coalesce(le0, 0)) * ({q} * total - x0) / (x - x0) END {op} {c['value']}"
    left = _value(c["metric"], labels, on, minutes)
    if "above" in c:
        return f"SELECT a.k, a.slot FROM ({left}) a JOIN ({_value(c['above'], labels, on, None)}) b ON a.slot = b.slot AND a.k = b.k WHERE a.x > b.x"
    if "also" in c:
        o = c["also"]
        return f"SELECT a.k, a.slot FROM ({left}) a JOIN ({_value(o['metric'], o.get('labels') or {}, on, None)}) b ON a.slot = b.slot AND a.k = b.k WHERE a.x {op} {c['value']} AND b.x {o['op']} {o['value']}"
    return f"SELECT k, slot FROM ({left}) WHERE x {op} {c['value']}"


VALUES = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in s) + ")" for s in SERIES)
HELD = " UNION ALL ".join(f"SELECT '{rule}' AS rule, '{severity}' AS severity, {minutes} AS needs, k, slot FROM ({_holds(c)})" for rule, minutes, severity, cs in alerts.ALERT_RULES for c in cs)
STEPS = f"""WITH s AS (SELECT epoch_us(sampled_at) // 60000000 AS slot, name, lkey, sampled_at, CAST({VALUE} AS DOUBLE) AS value FROM ({EVENTS}), (VALUES {VALUES}) AS m({COLUMNS}) WHERE {THERE}),
l AS (SELECT slot, name, lkey, arg_max(value, sampled_at) AS value FROM s GROUP BY ALL), d AS (SELECT *, value - lag(value) OVER (PARTITION BY name, lkey ORDER BY slot) AS step FROM l),
g AS MATERIALIZED (SELECT slot, name, lkey, value, CASE WHEN step < 0 THEN value ELSE coalesce(step, 0.0) END AS grown FROM d), h AS (SELECT DISTINCT * FROM ({HELD}))"""


@query("j20_all_rules", f"{STEPS}, i AS (SELECT *, slot - row_number() OVER (PARTITION BY rule, k ORDER BY slot) AS island FROM h), r AS (SELECT rule, severity, needs, k, min(slot) AS a, max(slot) AS b FROM i GROUP BY rule, severity, needs, k, island) SELECT rule, severity, k AS labels, (a + needs) * 60000000 AS from_us, b * 60000000 AS to_us FROM r WHERE b - a >= needs")
def _(spark, sf):
    return alerts.evaluate_alerts(samples(spark, sf))


@query("j20_rule_steps", f"{STEPS} SELECT rule, k AS labels, count(*) AS steps, min(slot) AS first_step, max(slot) AS last_step FROM h GROUP BY rule, k")
def _(spark, sf):
    return alerts.holding(samples(spark, sf)).groupBy("rule", "labels").agg(F.count(F.lit(1)).alias("steps"), F.min("slot").alias("first_step"), F.max("slot").alias("last_step"))
