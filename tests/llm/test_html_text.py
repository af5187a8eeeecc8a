import random

from tidemark.llm.common import table
from tidemark.llm.html_text import common_lines, extract_text, main_text, page_lines

SCHEMA = "page_id long, url string, html string, host string, path string"


def test_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="menu">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
    <div class="ad">Buy</div><div id="cookie-notice"><div>We use</div> cookies</div>
    <main><article><h1>A &amp; B</h1><p>One  <b>two</b>\n three&nbsp;four<br>five<p class="ads">Ad<p>a &lt; b &#233;</p>
    <aside>Side</aside><form><input><p>Name</p></form><section class="comments"><p>First!</p></section></article></main>
    <footer>&copy; X</footer></body></html>"""
    assert main_text(page_lines(page), []) == "A & B\nOne two three four five\na < b é"


def test_broken_markup_and_empty():
    assert page_lines("") == []
    assert page_lines("<p>a<p>b <i>c</p> d < e") == [("a", False), ("b c", False), ("d < e", False)]
    assert page_lines("<script>x") == [] and page_lines("<!-- x") == []


def test_common_lines_match_dynamic_programming():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(common_lines(a, b))
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(a[i] in rest for i in found)


def test_differencing_and_edge_cases(spark):
    def page(body):
        return f"<body><p>Top news today</p><p>All about us</p>{body}<p>Call us now</p></body>"

    rows = [
        (1, "http://a.com/x/1", page("<p>The first story is about rivers and how they move stones for years.</p><p>Rain.</p>")),
        (2, "http://a.com/x/2", page("<p>A second story tells of a mountain, far away and rarely climbed at all.</p>")),
        (3, "http://b.com/x/1", page("<p>Alone</p>")),
        (4, None, None),
        (5, "http://c.com/", ""),
        (6, "http://d.com/1", "<article><p>Same text</p></article>"),
        (7, "http://d.com/1", "<article><p>Same text</p></article>"),
        (8, "http://e.com/1", "<p>" + "long words " * 50_000 + "</p>"),
        (6, "http://d.com/1", "<article><p>Same text</p></article>"),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in extract_text(df).collect() if r.url is not None)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by_id = {g[0]: g[2] for g in got}
    assert by_id[1] == "The first story is about rivers and how they move stones for years.\nRain."
    assert by_id[2] == "A second story tells of a mountain, far away and rarely climbed at all."
    assert by_id[3] == "Top news today\nAll about us\nAlone\nCall us now"
    assert by_id[5] == "" and by_id[6] == by_id[7] == "Same text" and len(by_id[8]) == 549_999
    assert len(got) == 8 and all(g[3] == len(g[2]) for g in got)
    assert extract_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pages(spark):
    got = {r.page_id: r.text for r in extract_text(table(spark, "/root/testdata/sf0.001", "pages")).collect()}
    for r in table(spark, "/root/testdata/sf0.001", "pages").collect():
        body = r.html.split("<article>")[1].split("</article>")[0]
        assert got[r.page_id] == main_text(page_lines(body), [])
        assert "©" not in got[r.page_id]


def test_result_does_not_depend_on_partitions(spark):
    def page(i):
        return "<body>" + "".join(f"<p>Shared line {k} of the site, the same on every page.</p>" for k in range(9)) + f"<p>Own {i}</p></body>"

    rows = [(i, f"http://a.com/x/{i:03}", page(i)) for i in range(150)]
    df, got = spark.createDataFrame(rows, "page_id long, url string, html string"), []
    try:
        for n in (1, 8, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append(sorted((r.page_id, r.text) for r in extract_text(df.repartition(n)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == got[2] == [(i, f"Own {i}") for i in range(150)]


def test_comments_and_open_tags():
    assert main_text(page_lines("<article><p>Text</p></article><article class='comment'><p>First!</p></article>"), []) == "Text"
    for broken in ("<a " * 60_000, "<![CDATA[" * 60_000, "<a '\"" * 60_000):
        assert isinstance(page_lines("<p>x</p>" + broken), list)
    assert page_lines("<p>a <![CDATA[b < c]]> d</p>") == [("a b < c d", False)]


def test_pairing_matches_brute_force(spark):
    rng = random.Random(7)
    shared = [f"Notice {k} that many pages of this site carry." for k in range(6)]
    rows = []
    for i in range(220):
        host = rng.choice(["a.com", "b.org", "c.net"])
        lines = [x for x in shared if rng.random() < 0.6] + [f"Own line {rng.randrange(300)}" for _ in range(rng.randint(0, 3))]
        body = "".join(f"<p>{x}</p>" for x in lines)
        rows.append((i, f"http://{host}/{rng.choice('xy')}/{rng.randrange(400)}?q={i}", body if rng.random() < 0.8 else f"<article>{body}</article>"))
    order = sorted((u.split("/")[2], u[u.index("/", 7) :].split("?")[0], i, page_lines(h)) for i, u, h in rows if "<article>" not in h)
    expected = {i: main_text(page_lines(h), []) for i, _, h in rows if "<article>" in h}
    for k, (host, _, i, lines) in enumerate(order):
        near = [order[j] for j in (k - 2, k - 1, k + 1, k + 2) if 0 <= j < len(order) and order[j][0] == host]
        expected[i] = main_text(lines, [[x for x, _ in n[3]] for n in near])
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == expected


def test_lines_of_nearly_all_articles_of_a_host_go(spark):
    def page(i):
        quote = "<p>A proverb that several articles quote by right.</p>" if i % 5 == 0 else ""
        return f"<article><h1>Story {i}</h1><p>What {i} tells.</p>{quote}<p>All rights reserved by this paper.</p></article>"

    rows = [(i, f"http://a.com/{i:03}", page(i)) for i in range(90)] + [(100 + i, f"http://b.com/{i}", page(i)) for i in range(8)]
    df, got = spark.createDataFrame(rows, "page_id long, url string, html string"), []
    try:
        for n in (1, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append({r.page_id: r.text for r in extract_text(df.repartition(n)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]
    for i in range(90):
        assert got[0][i] == f"Story {i}\nWhat {i} tells." + ("\nA proverb that several articles quote by right." if i % 5 == 0 else "")
    # too few pages of one host to tell
    assert all(got[0][100 + i].endswith("All rights reserved by this paper.") for i in range(8))
