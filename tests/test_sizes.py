"""Steps whose work has to grow with their tables: what they do once a row and not once a group, filter or pair."""

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import derive, dispatch
from tidemark.sources.deliveries import decode_payload, project_envelope


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_payloads_are_parsed_once(spark):
    log = spark.createDataFrame([("g", "application/json", '{"number": 3, "repository": {"full_name": "a/b"}, "pull_request": {"stack": {"id": 7, "number": 2, "size": 3, "position": 1, "base": {"ref": "main", "sha": "s"}}}}')], "delivery_guid string, content_type string, body string")
    hints = dispatch.stack_hint(project_envelope(decode_payload(log).where("decode_error is null")).select("delivery_guid", "p"))
    assert optimized(hints).count("from_json") == 1
    assert [r.pr_number for r in hints.collect()] == [3]


def test_hints_meet_entries_on_all_that_has_to_agree(spark):
    hints = [(f"g{i}", "r", i % 6, 7, 2, 3, i % 3 + 1, "main", "s") for i in range(12)]
    stacks = [("r", 2, 7, "main", sha, [(n,), (-1,), (None,)]) for n in range(4) for sha in ("s", "")]
    h = spark.createDataFrame(hints, "delivery_guid string, hint_repo string, pr_number long, stack_id long, stack_number long, stack_size long, stack_position long, base_ref string, base_sha string")
    s = spark.createDataFrame(stacks, "full_name string, number long, gh_id long, base_ref string, base_sha string, entries array<struct<number:long>>")
    intents = h.select("delivery_guid", F.lit("refresh_stack").alias("kind"), F.lit("stack:r:2").alias("key"))
    left = dispatch.suppress_matching(intents, h, s)
    assert {r.delivery_guid for r in left.collect()} == {g for g, _, n, *_, at, _, _ in hints if not (at == 1 and n < 4)}
    semi = next(line for line in optimized(left).splitlines() if "Join LeftSemi" in line)
    assert "pr_number" in semi and "member" in semi  # not all hints of a stack number with all stacks of it


def test_derive_hands_over_many_scopes_at_a_time(spark):
    scopes = spark.range(1000).select(F.concat(F.lit("repo:1:pr:"), F.col("id").cast("string")).alias("scope_key")).coalesce(1)
    out = derive.derive(scopes, lambda rows: pd.DataFrame({"scope_key": rows.scope_key, "identity_key": rows.scope_key, "payload": str(len(rows))})).collect()
    assert len({r.scope_key for r in out}) == 1000 and {r.payload for r in out} == {"1000"}


def test_alert_samples_come_from_all_tasks(spark, tmp_path):
    from tidemark.plans import alerting

    rows = spark.range(4000).selectExpr("id AS event_id", "id % 7 AS user_id", "'view' AS event_type")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    samples = alerting.samples(spark, str(tmp_path))
    made = samples.select(F.spark_partition_id().alias("p")).groupBy("p").count().count()
    assert made == int(spark.conf.get("spark.sql.shuffle.partitions"))  # one file was one task, with all samples of it
