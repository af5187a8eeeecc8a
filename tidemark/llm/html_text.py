"""Main text of web pages: differencing against the pages nearest by URL, and the structure of the page."""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, written

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text in which no tags count.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
DROPPED = frozenset("nav footer aside form button select menu dialog svg math object audio video canvas".split())
BODY = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|cookies?|consent|notices?|popups?|modal|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|share|sharing|social"
    r"|related|recommend\w*|comments?|commentlist|respond|replies|disqus|newsletter|subscribe|signup|login|footer|header|masthead|widgets?|toolbar|pagination|pager|skip|copyright|hidden)(?:$|[\s_-])",
    re.I,
)
COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|replies|disqus)(?:$|[\s_-])", re.I)
#: Pages of a block, and how many pages before and after a page are compared with it.
BLOCK_PAGES, NEIGHBOURS = 64, 2
#: The same for pages with an article element; of the pages that tell something so many at least, and of these so many tenths, have to share a line that goes.
BODY_NEIGHBOURS, BODY_COMPARED, BODY_TENTHS = 16, 16, 9
IMPLIED_END = frozenset("p li dt dd option tr td th".split())


def _unwanted(tag: str, attributes: str, inside: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    names = COMMENT_NAMES if tag in BODY else NAMES
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name in ("class", "id") and names.search(value) or name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes))


def page_lines(page: str) -> list[tuple[str, bool]]:
    """The blocks of a page that its structure doesn't rule out, as (text, whether it stands in an article)."""
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    inside = depth = 0
    skipped = ""  # the element that is being left out, and how many of its name are open
    at, end = 0, len(page)

    def close() -> None:
        if held:
            if text := " ".join("".join(held).split()):
                out.append((text, inside > 0))
            held.clear()

    last_tag, last_cdata = page.rfind(">"), page.rfind("]]>")
    while at < end:
        if at < last_cdata and page.startswith("<![CDATA[", at):
            stop = page.index("]]>", at)
            if not skipped:
                held.append(page[at + 9 : stop])
            at = stop + 3
            continue
        if at > last_tag:  # no tag ends from here on
            if not skipped and not page.startswith("<!--", at):
                held.append(html.unescape(page[at:]))
            break
        m = TOKEN.match(page, at)
        at = m.end()
        if (text := m[4]) is not None:
            if not skipped:
                held.append(html.unescape(text))
            continue
        if m[2] is None:
            continue
        closing, tag = bool(m[1]), m[2].lower()
        if tag not in INLINE:
            close()
        elif tag == "br" and not skipped:
            held.append(" ")
        if tag in RAW and not closing:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if skipped:
            if tag == skipped and (closing or tag not in IMPLIED_END):
                depth += -1 if closing else 1
                if depth <= 0:
                    skipped = ""
                continue
            if skipped not in IMPLIED_END or tag in INLINE:
                continue
            skipped, depth = "", 0  # an element without an end tag ends where the next block begins
        if closing:
            if tag in BODY and inside:
                inside -= 1
            continue
        if tag in VOID:
            continue
        if _unwanted(tag, m[3], inside > 0):
            skipped, depth = tag, 1
        elif tag in BODY:
            inside += 1
    close()
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (Hunt and Szymanski)."""
    places = defaultdict(list)
    for j, line in enumerate(b):
        places[line].append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect_left(tails, j)
            node = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(node)
            else:
                tails[k] = j
                links[k] = node
    found, node = set(), links[-1] if links else None
    while node:
        found.add(node[0])
        node = node[1]
    return found


def shared_lines(mine: list, others: list[list], body: bool) -> list[int]:
    """Positions of lines that ``mine`` shares with enough of the ``others``; copies, which share all lines, tell nothing and are left out.

    Half of them are enough, or in a page with an article (``body``) ``BODY_TENTHS`` tenths of ``BODY_COMPARED`` or more: the element
    speaks for its lines, and articles hold the same line by right (a quotation, a signature), but not nearly all of a host's.
    """
    if body:
        # few lines stand in so many pages at all, and only then pages have to be aligned
        stands = Counter(line for other in others for line in set(other))
        if not any(10 * stands[line] >= BODY_TENTHS * BODY_COMPARED for line in mine):
            return []
    found = [shared for shared in (common_lines(mine, other) for other in others) if len(shared) < len(mine)]
    votes = Counter(i for shared in found for i in shared)
    if body:
        return sorted(i for i, n in votes.items() if len(found) >= BODY_COMPARED and 10 * n >= BODY_TENTHS * len(found))
    return sorted(i for i, n in votes.items() if 2 * n >= len(found))


def _candidates(lines: list[tuple[str, bool]]) -> tuple[list[str], bool]:
    """The lines that may be main text, and whether they stand in an article; a page with such an element consists of its lines."""
    body = any(inside for _, inside in lines)
    return [text for text, inside in lines if inside or not body], body


def main_text(lines: list[tuple[str, bool]], others: list[list[str]]) -> str:
    """The page without the lines that ``shared_lines`` finds in the ``others``."""
    mine, body = _candidates(lines)
    gone = set(shared_lines(mine, others, body))
    return "\n".join(text for i, text in enumerate(mine) if i not in gone)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        pages = [_candidates(page_lines(page or "")) for page in batch.pop("html")]
        yield batch.assign(
            body=[body for _, body in pages],
            texts=[texts for texts, _ in pages],
            lines=[[int.from_bytes(hashlib.md5(x.encode("utf-8", "surrogatepass")).digest()[:8], "little", signed=True) for x in texts] for texts, _ in pages],
        )


def _difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Positions of the lines that go, of pages that lose some. Rows come by block and rank; each page of the block is compared with the pages that stand near it on its host."""

    def done(block: list) -> pd.DataFrame:
        at = {x.rank: x for x in block}
        out = []
        for x in block:
            if x.rank // BLOCK_PAGES == x.block and len(x.lines):
                reach = BODY_NEIGHBOURS if x.body else NEIGHBOURS
                near = [at[x.rank + d] for d in range(-reach, reach + 1) if d and x.rank + d in at]
                gone = shared_lines(list(x.lines), [list(y.lines) for y in near if (y.host, y.body) == (x.host, x.body)], x.body)
                if gone:
                    out.append((x.row, gone))
        return pd.DataFrame(out, columns=["row", "gone"])

    held: list = []
    for batch in batches:
        for x in batch.itertuples(index=False):
            if held and held[0].block != x.block:
                yield done(held)
                held = []
            held.append(x)
    if held:
        yield done(held)


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Blocks that the structure marks as menus, headers, footers, asides, forms, notices, adverts, comments, scripts or
    styles go, and of a page with an article element what stands outside. The pages of a host with such an element and those
    without are put in the order of their paths, and each is compared with those nearest to it, ``NEIGHBOURS`` before and
    after, or ``BODY_NEIGHBOURS`` of pages with an article: lines that half of them share, or nearly all within articles,
    found by longest common subsequence, are deleted. Character references are decoded, white space inside a block becomes one space,
    blocks are joined by line ends.

    Pages are numbered in the order of (article or not, host, path, page_id) over all of them, from the sizes of sorted ranges; a page
    goes to its block of ``BLOCK_PAGES`` numbers, and near an edge to the next block as well, so the result doesn't depend
    on the partitions, a hot host is split, and memory holds one block. Blocks hold 64-bit digests of lines in place of their
    texts; what they tell is which lines go, of pages that lose some.

    Null html is an empty page; pages without a host count as one host. Repeated rows give one result each and are copies
    of each other. An empty table gives an empty result. Other columns are ignored.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    src = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"), host.alias("host"), path.alias("path"))
    parsed = written(src.mapInPandas(_parse, "row long, page_id long, url string, host string, path string, body boolean, texts array<string>, lines array<long>"))
    spark = pages.sparkSession
    order = ["body", "host", "path", "page_id", "row"]
    ranges = parsed.select(*order).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    numbered = written(ranges.select("row", F.monotonically_increasing_id().alias("m")))
    part = F.shiftright("m", 33).cast("int")
    sizes = sorted(numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts = spark.createDataFrame([(r.part, sum(x.n for x in sizes[:i])) for i, r in enumerate(sizes)], "part int, start long")  # a row a range
    ranked = numbered.withColumn("part", part).join(F.broadcast(starts), "part").select("row", (F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("rank"))
    reach = F.when(F.col("body"), BODY_NEIGHBOURS).otherwise(NEIGHBOURS)
    block = F.floor((F.col("rank") - reach) / BLOCK_PAGES), F.floor((F.col("rank") + reach) / BLOCK_PAGES)
    dealt = parsed.select("row", "host", "body", "lines").join(ranked, "row").withColumn("block", F.explode(F.sequence(*block)))
    gone = written(dealt.repartition("block").sortWithinPartitions("block", "rank").mapInPandas(_difference, "row long, gone array<int>"))
    kept = F.when(F.col("gone").isNull(), F.col("texts")).otherwise(F.filter("texts", lambda x, i: ~F.array_contains("gone", i)))
    rows = parsed.drop("lines").join(bounded_broadcast(gone, gone.count()), "row", "left")
    text = rows.select("page_id", "url", F.array_join(kept, "\n").alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
