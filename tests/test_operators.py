import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import owner_type
from tidemark.operators import alerts, dispatch, drift, merge, metrics, owners, timeline
from tidemark.operators.merge import Spec, fold_batch, merge_if_newer, replace_set
from tidemark.sources.deliveries import decode_payload
from tidemark.sources.recordings import read_recording
from tidemark.sources.snapshots import append_events, current_version, read_snapshot, write_snapshot

SPEC = Spec(("id",), ("v",))
SCHEMA = "id long, v string, gh_updated_at timestamp_ntz, last_checked_at timestamp_ntz, tombstoned_at timestamp_ntz"


def t(n):
    from datetime import datetime

    return None if n is None else datetime(2024, 1, n)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, t(a), t(b), t(c)) for i, v, a, b, c in rows], SCHEMA)


def merged(state, batch, spec=SPEC):
    return {r.id: (r.v, r.change, r.tombstoned_at is not None) for r in merge_if_newer(state, batch, spec).collect()}


def test_merge_accepts_by_version_payload_and_tombstone(spark):
    state = frame(spark, [(1, "a", 5, 5, None), (2, "a", 5, 5, None), (3, "a", 5, 5, None), (4, "a", None, 5, None), (5, "a", 5, 5, 6), (6, "a", 5, 5, 6), (7, "a", 5, 5, None)])
    batch = frame(spark, [(1, "b", 6, 7, None), (2, "b", 4, 7, None), (3, "a", 5, 7, None), (4, "b", 1, 7, None), (5, "a", 5, 7, None), (6, "a", 5, 6, None), (7, "b", None, 9, None), (8, "n", 1, 1, None)])
    assert merged(state, batch) == {
        1: ("b", "updated", False), 2: ("a", "kept", False), 3: ("a", "kept", False), 4: ("b", "updated", False), 5: ("a", "updated", False), 6: ("a", "kept", True), 7: ("a", "kept", False), 8: ("n", "inserted", False),
    }


def test_stored_void_version_may_need_one(spark):
    state, spec = frame(spark, [(1, "a", None, 5, None), (2, "a", None, 5, None)]), Spec(("id",), ("v",), needs_version=True)
    assert {k: v[1] for k, v in merged(state, frame(spark, [(1, "a", None, 7, None), (2, "b", 3, 7, None)]), spec).items()} == {1: "kept", 2: "updated"}


def test_merge_is_independent_of_order_and_repeats(spark):
    rng = random.Random(1)
    state = frame(spark, [(i, "s", rng.choice([None, 3, 5]), 5, rng.choice([None, 6])) for i in range(30)])
    rows = [(rng.randrange(40), rng.choice("ab"), rng.choice([2, 3, 5, 7]), rng.randint(4, 9), None) for _ in range(120)]
    seen = set()
    for _ in range(4):
        shuffled = rows + rng.choices(rows, k=20)
        rng.shuffle(shuffled)
        seen.add(tuple(sorted((k, *map(str, v)) for k, v in merged(state, frame(spark, shuffled).repartition(rng.randint(1, 5))).items())))
    assert len(seen) == 1


def test_two_writers_end_alike_in_either_order(spark):
    state = frame(spark, [(1, "s", 3, 3, None)])
    a, b = frame(spark, [(1, "a", 5, 6, None)]), frame(spark, [(1, "b", 7, 4, None)])
    once = [merge_if_newer(merge_if_newer(state, x, SPEC).drop("change"), y, SPEC).first().v for x, y in ((a, b), (b, a))]
    assert once == ["b", "b"] and merge_if_newer(state, a.unionByName(b), SPEC).first().v == "b"
    assert fold_batch(a.unionByName(b), SPEC).count() == 1


def test_replace_set_needs_the_parent(spark):
    spec = Spec(("id",), ("v", "p"), parent=("p",))
    schema = SCHEMA.replace("v string", "v string, p long")
    state = spark.createDataFrame([(i, "a", p, t(1), t(1), None) for i, p in ((1, 10), (2, 10), (3, 11), (4, 12))], schema)
    seen = spark.createDataFrame([(1, "a", 10, t(1), t(5), None), (9, "z", 99, t(1), t(5), None)], schema)
    parents = spark.createDataFrame([(10, t(5)), (11, t(5))], "p long, observed_at timestamp_ntz")
    assert {r.id: r.change for r in replace_set(state, seen, parents, spec).collect()} == {1: "kept", 2: "tombstoned", 3: "tombstoned", 4: "kept"}


def test_dense_sequence(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(2).sample(range(1000), 300)], "x long")
    got = [(r.x, r.seq) for r in merge.dense_sequence(df, ["x"], 7).orderBy("x").collect()]
    assert [s for _, s in got] == list(range(7, 307))
    assert merge.dense_sequence(df.where("x < 0"), ["x"], 7).count() == 0


def test_rules_fail_closed(spark):
    good = {"event": "push", "action": "*", "target": "branch"}
    assert dispatch.load_rules(spark, [good]).count() == 1
    for bad in ([], [good | {"x": 1}], [good | {"target": "nope"}], [good | {"event": "check_run"}], [{"event": "push", "target": "branch"}]):
        with pytest.raises(ValueError):
            dispatch.load_rules(spark, bad)


def test_debounce_windows_do_not_extend(spark):
    from datetime import datetime, timedelta

    base = datetime(2024, 1, 1)
    df = spark.createDataFrame([("k", "a", base + timedelta(seconds=s)) for s in (0, 3, 4.9, 5, 9, 11, 30, 30)], "kind string, key string, received_at timestamp_ntz")
    got = dispatch.debounce(df, 5).orderBy("opened_us").collect()
    start = got[0].opened_us
    assert [((r.opened_us - start) // 1_000_000, r.instants) for r in got] == [(0, 3), (5, 2), (11, 1), (30, 1)]


def test_decode_payload(spark):
    rows = [(None, '{"a":1}'), ("application/json; charset=utf-8", "{}"), ("application/x-www-form-urlencoded", "x=1&payload=%7B%22a%22%3A1%7D"), ("application/x-www-form-urlencoded", "payload=a&payload=b"), ("text/plain", "{}"), ("", "nope"), ("", "3"), (None, None)]
    got = decode_payload(spark.createDataFrame(rows, "content_type string, body string")).collect()
    assert [r.payload for r in got[:3]] == ['{"a":1}', "{}", '{"a":1}'] and all(r.decode_error for r in got[3:])


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("*", ["a", "x/y"], []),
        ("*.js", ["a.js", "x/a.js"], ["a.jsx"]),
        ("/docs/", ["docs/a", "docs/x/y"], ["x/docs/a"]),
        ("docs/*", ["docs/a"], ["docs/x/y", "x/docs/a"]),
        ("apps/", ["apps/a", "x/apps/b"], ["apps.txt"]),
        ("/apps/web", ["apps/web", "apps/web/a"], ["apps/webx"]),
        ("**/logs", ["logs", "a/logs/x", "a/b/logs"], ["a/logsx"]),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b/c"], ["ab"]),
        ("a/**", ["a/b", "a/b/c"], ["a", "b/a/c"]),
        ("f?o", ["foo", "x/fxo"], ["fo", "f/o"]),
        (r"my\ file", ["my file"], ["my"]),
    ],
)
def test_owner_patterns(pattern, yes, no):
    import re

    regex = re.compile(owners.pattern_regex(pattern))
    assert all(regex.search(p) for p in yes) and not any(regex.search(p) for p in no)


def test_owner_lines():
    assert owners.parse_rule("# x") is None and owners.parse_rule("   ") is None and owners.parse_rule("\\#x @a") is None
    assert owners.parse_rule("a\\ b @x @y # z") == ("a\\ b", ["@x", "@y"])
    assert owners.parse_rule("x\r") == ("x", [])
    assert owners.pattern_regex("!a") is None and owners.pattern_regex("a[bc]") is None and owners.pattern_regex("/") is None


def test_owner_types(spark):
    rows = [("@a-b",), ("@o/t",), ("a@b.c",), ("@",), ("@a/b/c",), ("a@@b",), ("x",)]
    got = spark.createDataFrame(rows, "x string").select(owner_type(F.col("x"))).collect()
    assert [r[0] for r in got] == ["user", "team", "email", "malformed", "malformed", "malformed", "malformed"]


def test_alerts_absence_increase_reset_and_hold(spark):
    from datetime import datetime, timedelta

    base = datetime(2024, 1, 1)

    def sample(minute, name, value, **labels):
        return (base + timedelta(minutes=minute), name, labels, float(value))

    rows = [sample(i, "tick", 1) for i in range(20)]
    rows += [sample(i, "count_total", v) for i, v in enumerate([5, 5, 5, 2, 2, 2])]
    rows += [sample(i, "age", 100 if 4 <= i <= 12 else 1, who="a") for i in range(20)]
    rows += [sample(i, "limit", 50, who="a") for i in range(20)]
    rules = [
        ("grew", 0, "page", [{"metric": "count_total", "minutes": 2, "op": ">", "value": 0}]),
        ("held", 5, "page", [{"metric": "age", "above": "limit", "on": ["who"]}]),
        ("gone", 3, "page", [{"metric": "count_total", "absent": True}]),
        ("never", 10, "page", [{"metric": "age", "op": ">", "value": 50}]),
    ]
    df = spark.createDataFrame(rows, "at timestamp_ntz, name string, labels map<string,string>, value double")
    start = alerts.evaluate_alerts(df, rules).agg(F.min("from_us")).first()[0]
    zero = start - 3 * 60_000_000
    got = {(r.rule, r.labels): ((r.from_us - zero) // 60_000_000, (r.to_us - zero) // 60_000_000) for r in alerts.evaluate_alerts(df, rules).collect()}
    assert got == {("grew", ""): (3, 4), ("held", "who=a"): (9, 12), ("gone", ""): (9, 19)}
    assert len(alerts.ALERT_RULES) == 28


def test_alerts_quantile_lies_within_its_bucket(spark):
    from datetime import datetime, timedelta

    base = datetime(2024, 1, 1)
    share = {"10": 0, "20": 90, "40": 100, "+Inf": 100}
    rows = [(base + timedelta(minutes=i), "b", {"le": le, "pod": pod}, float(i * n)) for i in range(6) for le, n in share.items() for pod in "xy"]

    def fires(bound, op):
        rules = [("slow", 0, "page", [{"quantile": 0.95, "metric": "b", "minutes": 5, "op": op, "value": bound}])]
        return [(r.labels, (r.to_us - r.from_us) // 60_000_000) for r in alerts.evaluate_alerts(spark.createDataFrame(rows, SAMPLES), rules).collect()]

    assert fires(29.9, ">") == [("", 4)] and fires(30.1, ">") == [] and fires(30.1, "<") == [("", 4)]


def test_alerts_take_whole_series_groups_and_odd_samples(spark):
    from datetime import datetime, timedelta

    base = datetime(2024, 1, 1)
    rows = [(base + timedelta(minutes=i), "lag", {"pod": p, "zone": "a, b} {c"}, 5.0 if p == "x" or i < 2 else 0.0) for i in range(4) for p in "xy"]
    rows += [(base + timedelta(minutes=i), "age", {"zone": "a, b} {c", "pod": "x"}, 50.0) for i in range(4)]
    rows += [(base, "lag", None, 9.0), (None, "lag", {}, 9.0), (base, None, {}, 9.0), (base, "lag", {"pod": "z"}, None)]
    rules = [("stalled", 1, "page", [{"metric": "lag", "op": ">", "value": 0, "also": {"metric": "age", "op": ">", "value": 30}}]), ("role", 1, "page", [{"metric": "up", "labels": {"role": r}, "absent": True} for r in "ab"])]
    got = {(r.rule, r.labels) for r in alerts.evaluate_alerts(spark.createDataFrame(rows, SAMPLES), rules).collect()}
    assert got == {("stalled", "pod=x,zone=a, b} {c"), ("role", "role=a"), ("role", "role=b")}
    assert alerts.evaluate_alerts(spark.createDataFrame([], SAMPLES)).collect() == []
    twice = spark.createDataFrame([(base, "lag", {}, 1.0), (base, "lag", {}, 3.0)], SAMPLES)
    assert alerts.on_grid(twice, 60).first().value == 3.0


SAMPLES = "at timestamp_ntz, name string, labels map<string,string>, value double"


def _document_tables(spark, **rows):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    base = "last_checked_at timestamp_ntz, tombstoned_at timestamp_ntz"
    schemas = {
        "repos": "repo_id long, gh_id long, installation_id long, full_name string, " + base,
        "pull_requests": "repo_id long, number long, pull_id long, gh_id long, head_sha string, base_sha string, " + base,
        "stacks": "repo_id long, number long, stack_id long, gh_id long, entries array<struct<number:long,updated_at:timestamp_ntz>>, " + base,
        "repo_rules": "repo_id long, rule_key string, rule string, " + base,
        "rule_sync_state": "repo_id long, last_checked_at timestamp_ntz",
        "check_runs": "repo_id long, head_sha string, gh_id long, name string, " + base,
        "change_snapshots": "repo_id long, pr_number long, base_sha string, head_sha string, files_total_count long, " + base,
        "review_requests": "repo_id long, pr_number long, reviewer_kind string, reviewer_gh_id long, head_sha string, " + base,
        "reviews": "repo_id long, pr_number long, node_id string, head_sha string, submitted_at timestamp_ntz, " + base,
        "comments": "repo_id long, pr_number long, node_id string, head_sha string, " + base,
        "changed_files": "repo_id long, pr_number long, path string, base_sha string, head_sha string, " + base,
        "file_owners": "repo_id long, pr_number long, path string, owner_token string, base_sha string, head_sha string, " + base,
        "review_threads": "repo_id long, pr_number long, thread_id string, comments array<struct<author_login:string>>, " + base,
    }
    return {name: spark.createDataFrame([tuple(r) + ((t,) if name == "rule_sync_state" else (t, None) if len(r) < len(schema.split(" timestamp_ntz")[0].split(", ")) + (name == "reviews") else ()) for r in rows.get(name, [])], schema) for name, schema in schemas.items()}


def test_documents_fence_children_and_change_inputs(spark):
    from tidemark.operators import documents

    def pulls(**rows):
        tables = _document_tables(spark, repos=[(1, 10, 7, 'a/"b"')], pull_requests=[(1, 5, 50, 500, "h", "b"), (2, 6, 60, 600, "h", "b")], **rows)
        out = documents.entity_documents(tables).collect()
        keys = {(r.installation_id, r.entity_kind, r.source_id) for r in documents.document_keys(tables).collect()}
        assert keys == {(r.installation_id, r.entity_kind, r.source_id) for r in out} and len(keys) == len(out)
        return {r.entity_kind: json.loads(r.document) for r in out}

    empty = pulls()
    assert set(empty) == {"repository", "repo_rules", "pull_request", "review_threads"}
    assert empty["pull_request"]["reviews"] == [] and empty["pull_request"]["change_inputs"] is None and empty["repo_rules"] == {"rules_by_id": {}} and empty["review_threads"] == {"threads": []}
    assert empty["repository"]["full_name"] == 'a/"b"' and "title" in empty["pull_request"]

    stated = dict(change_snapshots=[(1, 5, "b", "h", 2)], changed_files=[(1, 5, "z", "b", "h"), (1, 5, "a", "b", "h")])
    full = pulls(**stated, comments=[(1, 5, "n2", "h"), (1, 5, "n1", "old"), (1, 5, "n0", "h"), (1, 5, "n9", None)], repo_rules=[(1, 'k"', '{"x":[1]}')], check_runs=[(1, "h", 9, "c"), (1, "h", 8, None)])
    assert [c["node_id"] for c in full["pull_request"]["comments"]] == ["n0", "n2"]
    assert [f["path"] for f in full["pull_request"]["change_inputs"]["files"]] == ["a", "z"] and full["pull_request"]["change_inputs"]["owners"] == []
    assert full["repo_rules"] == {"rules_by_id": {'k"': {"x": [1]}}} and [r["id"] for r in full["checks"]["runs"]] == [8, 9]
    for spoilt in (dict(file_owners=[(1, 5, "a", "@t", None, "h")]), dict(file_owners=[(1, 5, "a", "@t", "b", "other")]), dict(change_snapshots=[(1, 5, "b", "old", 2)])):
        assert pulls(**{**stated, **spoilt})["pull_request"]["change_inputs"] is None


def test_alert_rules_run(spark):
    from datetime import datetime

    df = spark.createDataFrame([(datetime(2024, 1, 1), "tick", {"le": "1"}, 1.0)], "at timestamp_ntz, name string, labels map<string,string>, value double")
    assert {r.rule for r in alerts.evaluate_alerts(df, alerts.ALERT_RULES[:3]).collect()} == {"budget_class_starved"}


def test_stack_cycle_starts_at_its_smallest(spark):
    edges = spark.createDataFrame([(1, 5, 7), (1, 7, 6), (1, 6, 5), (1, 9, 5)], "repo_id long, number long, parent long")
    pulls = spark.createDataFrame([(1, n, t(n)) for n in (5, 6, 7, 9)], "repo_id long, number long, gh_updated_at timestamp_ntz")
    got = timeline.order_stacks(pulls, edges).orderBy("position").collect()
    assert [r.number for r in got] == [5, 6, 7, 9] and {r.stack_number for r in got} == {5} and got[0].updated_at == t(9)


def test_parent_choice(spark):
    rows = [(1, 1, "x", "main", "s1", "", "closed", t(3)), (1, 2, "x", "main", "s2", "", "open", t(1)), (1, 3, "x", "main", "s3", "", "open", t(2)), (1, 4, "y", "x", "s4", "s1", "open", t(1)), (1, 5, "z", "x", "s5", "", "open", t(1)), (1, 6, "w", "main", "s6", "s1", "open", t(1))]
    df = spark.createDataFrame(rows, "repo_id long, number long, head_ref string, base_ref string, head_sha string, base_sha string, state string, gh_updated_at timestamp_ntz")
    assert {r.number: r.parent for r in timeline.stack_edges(df).collect()} == {4: 1, 5: 3}


def test_snapshots_and_events_are_idempotent(spark, tmp_path):
    table = str(tmp_path / "t")
    assert current_version(spark, table) is None
    for _ in range(2):
        write_snapshot(spark.range(3), table, 1)
    write_snapshot(spark.range(5), table, 2)
    assert current_version(spark, table) == 2 and read_snapshot(spark, table).count() == 5 and read_snapshot(spark, table, 1).count() == 3
    for _ in range(2):
        append_events(spark.range(4), str(tmp_path / "e"), 0)
    assert spark.read.parquet(str(tmp_path / "e")).count() == 4


def test_recording(spark, tmp_path):
    lines = [{"type": "recording", "version": 1, "repository": "a/b"}, {"seq": 1, "at_ms": 0, "kind": "commit", "commit": {"sha": "x"}}, {"seq": 2, "at_ms": 5, "kind": "push", "push": {"ref": "refs/heads/m"}}]
    path = tmp_path / "r.ndjson"
    path.write_text("\n".join(map(json.dumps, lines)) + "\n")
    header, events = read_recording(spark, str(path))
    assert header.first().repository == "a/b" and [r.seq for r in events.orderBy("seq").collect()] == [1, 2]


def test_drift_diff_of_one_sided_rows(spark):
    a, b = (spark.createDataFrame(r, "k long, x string, y long") for r in ([(1, "a", 1), (2, "b", 2), (3, None, 3)], [(1, "a", 1), (3, "c", None), (4, "d", 4)]))
    got = {(r.k, r.path): (r.cache_value, r.upstream_value) for r in drift.semantic_diff(a, b, ["k"], ["x", "y"]).collect()}
    assert got == {(2, ""): ("present", "missing"), (4, ""): ("missing", "present"), (3, "x"): (None, "c"), (3, "y"): ("3", None)}
    assert drift.diff_hashes(drift.semantic_diff(a, b, ["k"], ["x", "y"]), ["k"]).count() == 3


def test_counts_after_points_match_brute_force(spark, monkeypatch):
    from tidemark.operators import changes

    rng = random.Random(4)
    monkeypatch.setattr(changes, "BUCKET", 8)
    events = [(s, q, t(q % 20 + 1)) for s in "ab" for q in rng.sample(range(100), 60)]
    points = [(s, rng.randrange(-5, 110)) for s in "abc" for _ in range(12)]
    got = changes.after_counts(spark.createDataFrame(events, "stream string, seq long, occurred_at timestamp_ntz"), spark.createDataFrame(points, "stream string, after_seq long"))
    for r in got.collect():
        later = [x[2] for x in events if x[0] == r.stream and x[1] > r.after_seq]
        assert (r.outstanding, r.oldest) == (len(later), min(later, default=None))
    assert got.count() == len(set(points))


def test_results_of_scopes_are_checked_for_owners_and_absence(spark):
    from tidemark.operators.derive import validate_results

    scopes = spark.createDataFrame([("repo:1:pr:2",), ("repo:1:pr:3",)], "scope_key string")
    items = spark.createDataFrame([("repo:1:pr:2", "x", "{}", 1)], "scope_key string, identity_key string, payload string, repo_id long")
    owners = spark.createDataFrame([("x", "repo:1:pr:9")], "identity_key string, scope_key string")
    assert validate_results(scopes, items).count() == 0
    got = {tuple(r) for r in validate_results(scopes, items, owners, complete=True).collect()}
    assert got == {("repo:1:pr:2", "x", "identity of another scope"), ("repo:1:pr:3", None, "no result")}


def test_repeats_of_a_timeline_keep_the_least(spark):
    from tidemark.operators.timeline import dedupe_timeline

    rows = [("k", t(1), "b"), ("k", t(1), "a"), ("k", t(2), "c")]
    for some in (rows, rows[::-1]):
        got = sorted((r.stable_key, r.v) for r in dedupe_timeline(spark.createDataFrame(some, "stable_key string, at timestamp_ntz, v string")).collect())
        assert got == [("k", "a"), ("k", "c")]


def test_rules_from_a_file(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"event": "push", "action": "*", "target": "branch"}\n\n{"event": "check_run", "action": "created", "target": "checks"}\n')
    assert [r.r_event for r in dispatch.read_rules(spark, str(tmp_path / "rules.json")).orderBy("rule").collect()] == ["push", "check_run"]
    for bad in ("", "[]", '{"event": "push"}', '{"event": "push", "action": "*", "target": "branch", "x": 1}', "nonsense"):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            dispatch.read_rules(spark, str(tmp_path / "bad.json"))


def test_scopes_of_pulls_stacks_and_heads(spark):
    members = spark.createDataFrame([(1, 10, 5), (1, 11, 5)], "repo_id long, number long, stack_number long")
    old = spark.createDataFrame([(1, 10, 5), (1, 12, 6)], "repo_id long, number long, stack_number long")
    pulls = spark.createDataFrame([(1, 10, "a", None), (1, 12, "b", None), (1, 13, "c", t(1))], "repo_id long, number long, head_sha string, tombstoned_at timestamp_ntz")
    assert {(r.number, r.scope_key) for r in merge.scopes_for_pulls(pulls, members).collect()} == {(10, "repo:1:stack:5"), (12, "repo:1:pr:12"), (13, "repo:1:pr:13")}
    assert {r.scope_key for r in merge.scopes_for_stacks(members, old).collect()} == {"repo:1:stack:5", "repo:1:stack:6", "repo:1:pr:12"}
    heads = spark.createDataFrame([(1, "a"), (1, "c"), (2, "b")], "repo_id long, head_sha string")
    assert {tuple(r) for r in merge.scopes_for_heads(heads, pulls, members).collect()} == {("a", "repo:1:stack:5")}


def test_fences_let_the_stored_commit_through(spark):
    pulls = spark.createDataFrame([(1, 1, "h", "b", t(3), None), (1, 2, "h2", "b", t(3), t(4))], "repo_id long, number long, head_sha string, base_sha string, gh_updated_at timestamp_ntz, tombstoned_at timestamp_ntz")
    seen = spark.createDataFrame([(1, 1, "h", "b", t(3)), (1, 1, "old", "b", t(3)), (1, 1, "h", "b", t(2)), (1, 2, "h2", "b", t(3))], "repo_id long, pr_number long, head_sha string, base_sha string, parent_gh_updated_at timestamp_ntz")
    good = merge.snapshot_fence(seen, pulls)
    assert [(r.pr_number, r.head_sha, r.parent_gh_updated_at) for r in good.collect()] == [(1, "h", t(3))]
    files = spark.createDataFrame([(1, 1, "h", "b", "x"), (1, 1, "old", "b", "y")], "repo_id long, pr_number long, head_sha string, base_sha string, path string")
    assert [r.path for r in merge.child_fence(files, good).collect()] == ["x"]


def test_documents_differ_by_leaves(spark):
    from tidemark.operators.drift import document_diff

    a = [(1, '{"x":{"y":1,"z":[1,2]},"w":null}'), (2, "{}"), (3, "same"), (4, '{"r":[{"identity":"p","v":1},{"identity":"q","v":2}]}'), (5, "[1")]
    b = [(1, '{"x":{"y":2,"z":[1]},"w":null,"n":{"k":true}}'), (3, "same"), (4, '{"r":[{"identity":"q","v":2},{"identity":"p","v":3}]}'), (5, "[1]"), (6, "1")]
    got = {tuple(r) for r in document_diff(*[spark.createDataFrame(x, "id long, document string") for x in (a, b)], ["id"]).collect()}
    assert got == {
        (1, "x.y", "1", "2"), (1, "x.z[1]", "2", None), (1, "n.k", None, "true"), (2, "", "present", None), (4, "r[p].v", "1", "3"),
        (5, "", "[1", None), (5, "[0]", None, "1"), (6, "", None, "present"),
    }


def test_pushes_of_one_batch_chain(spark):
    from datetime import datetime, timedelta

    from tidemark.operators import branch

    base = datetime(2024, 1, 1)
    steps = [("main", "a", "b"), ("main", "x", "y"), ("main", "b", "c"), ("main", "a", "z"), ("main", "c", "c"), ("dev", "a", "q"), ("main", "", "b"), ("main", "c", "a"), ("main", "a", "d")]
    steps += [("long", f"n{i}", f"n{i + 1}") for i in range(300)] + [("flip", "u" if i % 2 else "v", "v" if i % 2 else "u") for i in range(101)]
    rows = [(f"g{i}", 1, b, f, t, True, base + timedelta(seconds=i)) for i, (b, f, t) in enumerate(steps)]
    rows += [("g0", 1, "main", "a", "b", True, base + timedelta(days=1)), ("lost", 1, "main", "d", "e", False, base + timedelta(days=2)), ("none", 1, "main", "d", "f", None, base)]
    pushes = spark.createDataFrame(rows, "delivery_guid string, repo_id long, branch string, before_sha string, after_sha string, transition_known boolean, received_at timestamp_ntz")
    got = {(r.branch, r.before_sha): (r.after_sha, r.hops) for r in branch.branch_transitions(pushes).collect()}
    expected = {}
    for b in ("main", "dev", "long", "flip"):
        mine = [(f, t) for x, f, t in steps if x == b and f and f != t]
        for start in {f for f, _ in mine}:
            at, hops = start, 0
            for f, t in mine:
                if f == at:
                    at, hops = t, hops + 1
            expected[b, start] = (at, hops)
    assert got == expected and got["main", "a"] == ("d", 4) and got["long", "n0"] == ("n300", 300)
    assert branch.branch_transitions(pushes.limit(0)).collect() == []


def test_neighbours_and_quantiles_of_one_large_key(spark):
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from tidemark.operators.ordered import exact_quantiles, lag_in_order

    rng = random.Random(7)
    rows = [("big", i, rng.gauss(0, 1) ** 3) for i in rng.sample(range(100_000), 20_000)] + [("few", i, float(i % 3)) for i in range(9)] + [("one", 1, 5.0), (None, 2, 6.0), (None, 3, None), ("void", 1, None)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    for parts in (1, 7):
        told = lag_in_order(df, ["k"], ["i"], "i", "last", parts).collect()
        assert len(told) == len(rows)
        for k in ("big", "few", "one"):
            mine = sorted((r.i, r["last"]) for r in told if r.k == k)
            assert [x for _, x in mine] == [None, *[i for i, _ in mine[:-1]]]
    got = {(r.k, r.q): r.v for r in exact_quantiles(df, ["k"], "v", [0.0, 0.5, 0.99, 1.0]).collect()}
    for k in ("big", "few", "one"):
        for q in (0.0, 0.5, 0.99, 1.0):
            assert abs(got[k, q] - np.quantile([v for x, _, v in rows if x == k], q)) < 1e-12
    assert ("void", 0.5) not in got
    one = exact_quantiles(df.withColumn("w", F.lit(3.0)), [], "w", [0.5]).collect()
    assert [(r.q, r.w) for r in one] == [(0.5, 3.0)]
    assert exact_quantiles(df.limit(0), ["k"], "v", [0.5]).collect() == []


def test_debounce_of_one_large_key(spark):
    import random
    from datetime import datetime

    from pyspark.sql import functions as F

    rng = random.Random(5)
    times = sorted({rng.randrange(10**9) for _ in range(60_000)})
    base = int(datetime(2024, 1, 1).timestamp())
    df = spark.createDataFrame([("k", "a", t) for t in times] + [("k", None, 5), (None, "a", 7), ("j", "a", 9)], "kind string, key string, us long").withColumn("received_at", F.timestamp_micros(F.col("us") + base * 10**6).cast("timestamp_ntz"))
    expected, opened = [], None
    for t in times:
        if opened is None or t >= opened + 50_000:
            opened = t
            expected.append([t, 0])
        expected[-1][1] += 1
    got = dispatch.debounce(df.withColumn("received_at", F.timestamp_micros("us").cast("timestamp_ntz")), 5).collect()
    small = dispatch.debounce(df.withColumn("received_at", F.timestamp_micros(F.col("us") * 100).cast("timestamp_ntz")), 5).where("kind = 'k' and key = 'a'").orderBy("opened_us").collect()
    assert [[r.opened_us // 100, r.instants] for r in small] == expected and len(expected) > 10_000
    assert sorted(str((r.kind, r.key, r.opened_us, r.instants)) for r in got if (r.kind, r.key) != ("k", "a")) == sorted(map(str, [("k", None, 5, 1), (None, "a", 7, 1), ("j", "a", 9, 1)]))


def test_document_diff_tells_paths_apart_at_any_depth(spark):
    from tidemark.operators.drift import document_diff

    deep = "[" * 7 + "{}" + "]" * 7
    a = [(1, '{"a.b":1}'), (2, '{"r":[{"identity":"p","v":1},{"identity":"p","v":2}]}'), (3, deep.replace("{}", "1")), (4, '{"k":[1,{"identity":"x"}]}'), (5, '{"a":1,"b":[{"c":null}]}'), (None, '{"q\\"]":1}'), (7, None), (8, '{"0":1}')]
    b = [(1, '{"a":{"b":1}}'), (2, '{"r":[{"identity":"p","v":1},{"identity":"p","v":3}]}'), (3, deep.replace("{}", "2")), (4, '{"k":[{"identity":"x"},1]}'), (5, '{ "b" : [{"c":null}], "a" : 1 }'), (7, "{}"), (8, "[1]")]
    got = {tuple(r) for r in document_diff(*[spark.createDataFrame(x, "id long, document string") for x in (a, b)], ["id"]).collect()}
    assert got == {
        (1, '["a.b"]', "1", None), (1, "a.b", None, "1"), (2, "r[p#1].v", "2", "3"), (3, "[0]" * 7, "1", "2"), (4, "k[0]", "1", None), (4, "k[0].identity", None, '"x"'),
        (4, "k[1].identity", '"x"', None), (4, "k[1]", None, "1"), (None, "", "present", None), (7, "", None, "present"), (8, '["0"]', "1", None), (8, "[0]", None, "1"),
    }
