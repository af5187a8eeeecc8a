"""Benchmark decontamination by winnowed fingerprints, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, bounded_broadcast, cut, document_key, let, packed

#: What separates words once A-Z are lower-cased: every ASCII character but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _window_minima(words: Column, window: int, k: int) -> Column:
    """For each start of a ``window`` of words the least hash of its k-grams: equal windows have equal minima."""
    n = F.size(words)

    def grams(w: Column) -> Column:
        return F.when(n >= window, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(k)))))

    def minima(g: Column) -> Column:
        starts = F.sequence(F.lit(1), n - (window - 1))
        return F.when(n >= window, F.transform(starts, lambda i: F.array_min(F.slice(g, i, F.lit(window - k + 1)))))

    return F.coalesce(let(grams(words), minima), F.array().cast("array<bigint>"))


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, window: int, k: int) -> DataFrame:
    """One row per item and window: item, len, win (its words), anchor (the fingerprint that finds it)."""
    parts = let(
        words_of(F.col(f"`{text_col}`")),
        lambda w: F.when(
            F.size(w) >= window,
            F.zip_with(
                F.sequence(F.lit(1), F.size(w)),
                _window_minima(w, window, k),
                lambda i, m: F.when(m.isNotNull(), F.struct(F.lit(window).alias("len"), F.concat_ws(" ", F.slice(w, i, F.lit(window))).alias("win"), m.alias("anchor"))),
            ),
        ).when(F.size(w) > 0, F.array(F.struct(F.size(w).alias("len"), F.concat_ws(" ", w).alias("win"), F.xxhash64(F.element_at(w, 1), F.lit("short")).alias("anchor")))),
    )
    return items.select(F.col(f"`{item_col}`").alias("item"), F.explode(parts).alias("p")).where("p is not null").select("item", "p.*")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z. An item's windows are its runs of
    ``window`` words; an item of fewer words, but not none, is one window. A document word is hit if it lies in an
    occurrence of any window.

    Winnowing: of every ``window`` words the least hash of the ``window - k + 1`` k-grams in it is the fingerprint.
    Equal spans of ``window`` words have equal fingerprints, so the join of document and item fingerprints misses none;
    each match is then extended to the whole window and compared word by word. Items shorter than a window are found by
    their first word and compared likewise. The fingerprints are broadcast if their count allows it, else shuffled;
    texts are never shuffled in the first case.

    Nulls and empty texts have no words. Items with a null identifier mark words but are not counted. Repeated document
    rows give one result each; repeated items count once. No items: nothing is hit. Other columns are ignored.
    """
    windows = cut(benchmark_windows(items, item_col, item_text_col, window, k))
    has_short = not windows.where(F.col("len") < window).isEmpty()
    anchors = windows.groupBy("anchor").agg(F.collect_set("len").alias("lens"))
    n_anchors = anchors.count()

    def probes(w: Column) -> Column:
        parts = [F.array(F.lit(None).cast("bigint")), _window_minima(w, window, k)]
        if has_short:
            parts.append(F.transform(w, lambda x: F.xxhash64(x, F.lit("short"))))
        return F.concat(*parts)

    cols = let(words_of(F.col(f"`{text_col}`")), lambda w: F.struct(w.alias("words"), probes(w).alias("probes")))
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), cols.alias("c"))
    src = src.select("row", "id", F.col("c.words").alias("words"), F.col("c.probes").alias("probes"))
    if bounded := n_anchors <= BROADCAST_ROWS:
        found = src.select("row", "id", "words", F.posexplode("probes").alias("pos", "anchor"))
        found = found.join(bounded_broadcast(anchors, n_anchors), "anchor", "left").where("pos = 0 or lens is not null")
    else:
        near = src.select("row", F.posexplode("probes").alias("pos", "anchor")).join(anchors, "anchor").select("row", "pos", "lens")
        found = src.drop("probes").join(near.unionByName(src.select("row", F.lit(0).alias("pos"), F.lit(None).cast("array<int>").alias("lens"))), "row")
    n = F.size("words")
    n_long = F.greatest(n - (window - 1), F.lit(0))
    found = found.select(
        "row", "id", n.alias("n_words"), "pos", F.when(F.col("pos") <= n_long, F.col("pos")).otherwise(F.col("pos") - n_long).alias("start"), "words", F.explode_outer("lens").alias("len")
    ).select("row", "id", "n_words", "pos", "start", "len", F.when(F.col("len").isNotNull(), F.concat_ws(" ", F.slice("words", F.greatest("start", F.lit(1)), F.coalesce("len", F.lit(0))))).alias("win"))
    wins = windows.groupBy("win", "len").agg(F.xxhash64("win").alias("win_id"))
    n_wins = n_anchors if not bounded else wins.count()
    hits = found.join(bounded_broadcast(wins, n_wins), ["win", "len"], "left").where("pos = 0 or win_id is not null")
    per_row = cut(
        hits.groupBy("row").agg(
            F.first("id").alias("id"),
            F.max("n_words").alias("n_words"),
            F.sort_array(F.collect_set(F.when(F.col("win_id").isNotNull(), F.struct("start", "len")))).alias("spans"),
            F.collect_set(F.when(F.col("win_id").isNotNull(), F.col("win"))).alias("wins"),
        )
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["total"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(s["start"], a["end"]))).alias("total"),
            F.greatest(a["end"], s["start"] + s["len"]).alias("end"),
        ),
        lambda a: a["total"],
    )
    pairs = windows.select("win", "item").distinct()
    held = (
        per_row.select("row", F.explode("wins").alias("win"))
        .join(bounded_broadcast(pairs, pairs.count()), "win")
        .groupBy("row")
        .agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    )
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return per_row.join(held, "row", "left").select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        covered.cast("long").alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_found), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any window of an item, with their columns, whatever their names. Null and empty texts and
    repeated rows stay; an empty table stays empty.
    """
    mine, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    keyed = docs.select(document_key(mine, text).alias("key"), text.alias("text"), packed(docs).alias("doc"))
    found = decontaminate(keyed.select("key", "text"), items, "key", "text", item_col, item_text_col, **options)
    bad = cut(found.where("contaminated").select("key").distinct())
    return keyed.select("key", "doc").join(bounded_broadcast(bad, bad.count()), "key", "left_anti").select("doc.*")
