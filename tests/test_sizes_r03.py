"""Work that has to stay spread or small on larger tables."""

from pyspark.sql import functions as F

from tidemark.operators import derive as dv
from tidemark.operators import drift
from tidemark.operators import merge as m
from tidemark.operators import timeline
from tidemark.plans.all import load


def test_replace_set_folds_the_batch_once(spark):
    state = spark.sql("SELECT id AS gh_id, id % 5 AS repo_id, 'h' AS head_sha, 'n' AS name, 'in_progress' AS status, '' AS conclusion, TIMESTAMP_NTZ '2001-01-01' AS gh_updated_at, TIMESTAMP_NTZ '2001-01-01' AS last_checked_at, CAST(NULL AS TIMESTAMP_NTZ) AS tombstoned_at FROM range(20)")
    batch = state.where("gh_id % 4 > 0").withColumns({"status": F.lit("completed"), "gh_updated_at": F.expr("gh_updated_at + interval 1 day"), "last_checked_at": F.expr("last_checked_at + interval 1 day")})
    parents = spark.sql("SELECT id AS repo_id, 'h' AS head_sha, TIMESTAMP_NTZ '2001-01-02' AS observed_at FROM range(3)")
    out = m.replace_set(state, batch, parents, m.CHECK_RUNS)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("max_by(") == 1
    expected = {(i, "kept" if i % 5 > 2 else "updated" if i % 4 else "tombstoned") for i in range(20)}
    assert {(r.gh_id, r.change) for r in out.collect()} == expected


def test_items_of_one_identity_are_dealt_over_tasks(spark):
    scopes = spark.sql("SELECT concat('repo:1:pr:', id) AS scope_key FROM range(1000)")
    items = spark.createDataFrame([(f"repo:1:pr:{i}", "dup", "{}", 1) for i in range(1000)], "scope_key string, identity_key string, payload string, repo_id long")
    owners = spark.createDataFrame([("dup", "repo:1:pr:0")], "identity_key string, scope_key string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = dv.validate_results(scopes, items, owners).where("problem = 'identity of another scope'")
        tasks = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(tasks) == 999 and max(tasks) < 600


def test_stacks_with_a_cycle_and_smaller_members_beside_it(spark):
    # 5 and 7 stand on each other, 1 on 5, 9 on 1; a chain of 40 stands beside them
    edges = [(1, 5, 7), (1, 7, 5), (1, 1, 5), (1, 9, 1)] + [(2, n + 1, n) for n in range(1, 40)]
    edges = spark.createDataFrame(edges, "repo_id long, number long, parent long")
    pulls = spark.sql("SELECT repo_id, id AS number, TIMESTAMP_NTZ '2001-01-01' AS gh_updated_at FROM range(1, 41) CROSS JOIN VALUES (1L), (2L) AS r (repo_id)")
    got = timeline.order_stacks(pulls, edges).orderBy("repo_id", "position").collect()
    assert [(r.stack_number, r.position, r.number) for r in got if r.repo_id == 1] == [(5, 1, 5), (5, 2, 1), (5, 3, 9), (5, 4, 7)]
    assert [(r.stack_number, r.number) for r in got if r.repo_id == 2] == [(1, n) for n in range(1, 41)]
    assert {(r.repo_id, r.number, r.root) for r in timeline.stack_components(edges).collect()} == {(1, n, 1) for n in (1, 5, 7, 9)} | {(2, n, 1) for n in range(1, 41)}


def test_documents_are_compared_without_a_join_of_their_members(spark):
    c = [(1, '{"l":[{"identity":"a","v":1},{"identity":"a","v":2},{"identity":"b","v":3}],"x":{"y":[1,2]}}'), (1, '{"x":1}'), (2, "[]"), (3, "{"), (4, None)]
    u = [(1, '{"l":[{"identity":"b","v":3},{"identity":"a","v":1},{"identity":"a","v":5}],"x":{"y":[1]}}'), (2, '[{"z":null}]'), (3, "{"), (4, "1")]
    c, u = (spark.createDataFrame(x, "id long, document string") for x in (c, u))
    out = drift.document_diff(c, u, ["id"])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.id, r.path, r.cache_value, r.upstream_value) for r in out.where("id <> 4 and not (cache_value = '1')").collect())
    assert (1, "l[a#1].v", "2", "5") in got and (1, "x.y[1]", "2", None) in got


def test_documents_read_the_lines_of_pulls_once(spark):
    df = load()[0]["i1_entity_documents"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # check runs read them, and the four sections what was grouped once
    assert len([x for x in plan.split("\n") if "Relation [" in x and "l_shipdate" in x]) == 1
