"""Work that has to grow no faster than the tables."""

from pyspark.sql import functions as F

from tidemark.operators import alerts, branch


def test_conditions_share_the_rows_of_a_selector(spark):
    conditions, selectors = alerts.compile_rules(alerts.ALERT_RULES, 60)
    chosen, uses = alerts.shared_selectors(conditions, selectors)
    assert len(uses) == len(selectors) > 1.8 * len(chosen)  # each selector was summed up by itself before
    assert len({str(s[1:]) for s in chosen}) == len(chosen)
    rules = [("low", 0, "page", [{"metric": "m", "labels": {"a": "x"}, "op": "<", "value": 2}]), ("high", 0, "page", [{"metric": "m", "labels": {"a": "x"}, "op": ">", "value": 4}, {"metric": "m", "labels": {"a": "x"}, "absent": True}])]
    rows = [(f"2024-01-01 00:0{i}:00", "m", {"a": a, "b": "1"}, float(v)) for i, (a, v) in enumerate([("x", 1), ("x", 3), ("x", 5), ("y", 9)])]
    df = spark.createDataFrame(rows, "at string, name string, labels map<string,string>, value double").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = alerts.holding(df, rules).collect()
    zero = min(r.slot for r in got)
    assert {(r.rule, r.labels, r.slot - zero) for r in got} == {("low", "a=x,b=1", 0), ("high", "a=x,b=1", 2), ("high", "a=x", 3)}


def test_increases_over_the_edge_of_a_stretch(spark, monkeypatch):
    rules = [("grows", 0, "page", [{"metric": "c", "minutes": 3, "op": ">", "value": 5}])]
    rows = [(f"2024-01-01 00:{i:02}:00", "c", {}, float(i * (i % 4 != 3) * 2)) for i in range(60) if i % 7]
    df = spark.createDataFrame(rows, "at string, name string, labels map<string,string>, value double").withColumn("at", F.col("at").cast("timestamp_ntz"))
    found = []
    for size in (4096, 4):
        monkeypatch.setattr(alerts, "STRETCH", size)
        found.append(sorted(r.slot for r in alerts.holding(df, rules).collect()))
    assert found[0] == found[1] and len(found[0]) > 20


def test_deliveries_to_a_busy_branch_repeat_at_short_distance(spark):
    pushes = spark.sql("SELECT concat('g-', id) AS delivery_guid, 1L AS repo_id, 'main' AS branch FROM range(6400)")
    pulls = spark.sql("SELECT 1L AS repo_id, id AS number, 'open' AS state, concat('b', id) AS head_ref, 'main' AS base_ref, CAST(NULL AS TIMESTAMP_NTZ) AS tombstoned_at FROM range(5)")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on larger tables
        guids = [r.delivery_guid for r in branch.prs_on_branch(pushes, pulls).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(guids) == 32000 and len(set(guids)) == 6400
    assert guids.index(guids[0], 1) < 640  # 6400 before: the deliveries of all lists lay between
