from tidemark.operators import changes


def test_delivered_events_are_those_within_the_span(spark):
    cursors = [(f"c{i}", "s" if i % 2 else "t", i * 7) for i in range(20)]
    events = [("s" if n % 3 else "t", n) for n in range(1, 150)]
    found = changes.delivered_within(spark.createDataFrame(cursors, "consumer string, stream string, cursor_seq long"), spark.createDataFrame(events, "stream string, seq long"), 30)
    assert sorted(map(tuple, found.collect())) == sorted((c, s, n) for c, s, at in cursors for e, n in events if e == s and at < n <= at + 30)
