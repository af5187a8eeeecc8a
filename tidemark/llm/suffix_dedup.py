"""Exact substring deduplication: content-defined shards, each sorted by external induced suffix sorting."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, sieve, spread_join, written

GRAM, CLASSES = 64, 2
#: Bytes of a shard aimed at, and anchors with more places than this are dealt out by their distance from the start.
SHARD_BYTES, HOT_PLACES, HOT_BLOCK = 1 << 20, 5000, 16
#: Positions that the queues of a sort hold in memory; more go to files.
QUEUE_POSITIONS = 24 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """The first ``n`` powers modulo 2 ** 64, kept for the next text."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 1 << 20:
            _POWERS[base] = known
    return known[:n]


_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of a polynomial modulo 2 ** 64, from which the hash of any range follows."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.add.accumulate((data + np.uint64(1)) * _powers(len(data), _INVERSE), out=sums[1:])
    return sums


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(32)
    return h


def core_size(length: int) -> int:
    """Bytes that the strings of ``length`` bytes of an anchor and class have in common."""
    return length + 1 + -(length - GRAM + 1) // CLASSES


def anchors_of(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(at, first, last, hash, core): the positions of the smallest gram, leftmost of equals, in some ``length`` bytes, the first
    and last start whose smallest gram it is, a hash of the bytes that all these starts' strings have in common, and where these
    ``core_size`` bytes begin.

    An anchor's starts are dealt into ``CLASSES`` by their distance from it, so that more bytes are common to them than the
    gram alone. Equal strings of ``length`` bytes have their anchors at equal distances, with equal hashes.
    """
    sums = _prefix_sums(data)
    n = len(data) - GRAM + 1
    h = _mixed((sums[GRAM:] - sums[:-GRAM]) * _powers(n, _MULTIPLIER))
    w, starts = length - GRAM + 1, len(data) - length + 1
    ranked = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    filled = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max)
    filled[: len(h)] = ranked
    ahead = np.minimum.accumulate(filled.reshape(-1, w), axis=1).ravel()
    back = np.minimum.accumulate(filled.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(back[:starts], ahead[w - 1 : w - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    width = -(-w // CLASSES)
    kind = (at - np.arange(starts)) // width
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (kind[1:] != kind[:-1])]))
    last = np.concatenate([first[1:] - 1, [starts - 1]])
    at, kind = at[first], kind[first]
    begin = at - kind * width
    common = (sums[begin + core_size(length)] - sums[begin]) * _powers(len(data), _MULTIPLIER)[begin]
    return at, first, last, _mixed(common + kind.astype(np.uint64)).view(np.int64), begin


class _Queue:
    """Blocks of positions, first in first out; what exceeds the shared allowance waits in a file."""

    held = 0

    def __init__(self, folder: str) -> None:
        self.blocks: list = []
        self.folder = folder

    def push(self, block: np.ndarray) -> None:
        if _Queue.held + len(block) > QUEUE_POSITIONS:
            with tempfile.NamedTemporaryFile(dir=self.folder, delete=False) as f:
                block.tofile(f)
            self.blocks.append((f.name, block.dtype))
        else:
            _Queue.held += len(block)
            self.blocks.append(block)

    def pop(self) -> np.ndarray:
        block = self.blocks.pop(0)
        if isinstance(block, tuple):
            return np.fromfile(block[0], dtype=block[1])
        _Queue.held -= len(block)
        return block


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    change = np.concatenate([[0], (keys[order][1:] != keys[order][:-1]).astype(np.int64)])
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(change) + 1
    return out


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``t`` in the order of their suffixes as far as ``depth`` symbols tell them apart.

    ``t`` are small unsigned symbols that end with a unique smallest one. Suffixes are of type S or L; those of leftmost S
    type are named by their substrings, the string of names, at most half as long, is sorted by doubling its names, and
    from its order that of the L and then of the S type suffixes is induced: each symbol has a queue, a suffix taken
    from the front puts the one before it at the back of its symbol's queue.
    """
    n = len(t)
    step = np.sign(t[:-1].astype(np.int32) - t[1:].astype(np.int32))
    known = np.flatnonzero(step)  # equal neighbours are of the type of the next that differ
    is_s = np.append(np.repeat(step[known] < 0, np.diff(known, prepend=-1)), True)
    lms = np.flatnonzero(is_s & np.concatenate([[False], ~is_s[:-1]]))
    coded = (t.astype(np.uint64) << np.uint64(1)) | is_s
    ends = np.append(lms[1:], n - 1)
    longest = int(min((ends - lms).max() + 1, depth + 1))
    names = np.zeros(len(lms), np.int64)
    for offset in range(0, longest, 3):
        word = names.astype(np.uint64)
        for i in range(offset, offset + 3):
            at = lms + i
            word = (word << np.uint64(10)) | np.where(at <= ends, coded[np.minimum(at, n - 1)], np.uint64(0))
        names = _dense(word)
    span = 1
    while names.max() < len(lms) and span < depth:
        pair = np.zeros(len(lms), np.int64)
        pair[:-span] = names[span:] if span < len(lms) else 0
        names = _dense((names.astype(np.uint64) << np.uint64(32)) | pair.astype(np.uint64))
        span *= 2
    sorted_lms = lms[np.argsort(names, kind="stable")]

    symbols = int(t.max()) + 1
    with tempfile.TemporaryDirectory() as folder:

        def deal(block: np.ndarray, s_type: bool, queues: list[_Queue]) -> None:
            before = block[block > 0] - 1
            before = before[is_s[before] == s_type]
            if len(before):
                c = t[before]
                order = np.argsort(c, kind="stable")
                before, c = before[order], c[order]
                cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
                for piece, symbol in zip(np.split(before, cuts), c[np.concatenate([[0], cuts])], strict=True):
                    queues[symbol].push(piece)

        ls, ss = [_Queue(folder) for _ in range(symbols)], [_Queue(folder) for _ in range(symbols)]
        done_l: list[list] = [[] for _ in range(symbols)]
        first = np.searchsorted(t[sorted_lms], np.arange(symbols + 1))
        for c in range(symbols):
            while ls[c].blocks:
                block = ls[c].pop()
                done_l[c].append(block)
                deal(block, False, ls)
            deal(sorted_lms[first[c] : first[c + 1]], False, ls)
        out: list[np.ndarray] = []
        for c in range(symbols - 1, -1, -1):
            if c == t[-1]:
                ss[c].push(np.array([n - 1]))
            while ss[c].blocks:
                block = ss[c].pop()
                out.append(block)
                deal(block, True, ss)
            for block in reversed(done_l[c]):
                out.append(block[::-1])
                deal(block[::-1], True, ss)
    return np.concatenate(out)[::-1]


def repeated_starts(pieces: list[bytes], counts: np.ndarray, lengths: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each of ``lengths``, in rising order, and each piece, which of its first ``count`` positions start a string of that
    length that starts elsewhere too; every one of these positions has the least of the lengths before the piece's end.
    """
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    total = int(sizes.sum()) + len(pieces)
    raw = np.zeros(total + 9, np.uint8)
    t = np.ones(total + 1, np.uint16)
    for p, b in zip(pieces, begin, strict=True):
        raw[b : b + len(p)] = np.frombuffer(p, np.uint8)
        t[b : b + len(p)] = raw[b : b + len(p)].astype(np.uint16) + 2
    t[-1] = 0
    room = np.zeros(total + 1, np.int64)
    for b, c, size in zip(begin, counts, sizes, strict=True):
        room[b : b + c] = size - np.arange(c)
    order = suffix_array(t, lengths[-1])
    order = order[room[order] > 0]
    # common prefixes of neighbours, eight bytes at a time, as long as they last
    word = np.zeros(total + 1, np.uint64)
    for i in range(8):
        word |= raw[i : total + 1 + i].astype(np.uint64) << np.uint64(8 * i)
    left, right = order[:-1], order[1:]
    alive, done, out = np.arange(len(left)), 0, []
    for length in lengths:
        # the neighbour among those with room for the length is found by leaving the others out
        if length > lengths[0]:
            some = order[room[order] >= length]
            left, right = some[:-1], some[1:]
            alive, done = np.arange(len(left)), 0
        for offset in [*range(done, length - 7, 8), *([length - 8] if length % 8 else [])]:
            alive = alive[word[left[alive] + offset] == word[right[alive] + offset]]
        repeated = np.zeros(total + 1, bool)
        repeated[left[alive]] = True
        repeated[right[alive]] = True
        out.append([repeated[b : b + c] for b, c in zip(begin, counts, strict=True)])
    return out


def _find_anchors(lengths: tuple[int, ...]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                texts = [np.frombuffer(text.encode(), np.uint8) for text in batch.column("text").to_pylist()]
                for length in lengths:
                    some = [i for i, text in enumerate(texts) if len(text) >= length]
                    found = [anchors_of(texts[i], length) for i in some]
                    owner = pa.array(np.repeat(some, [len(f[0]) for f in found]).astype(np.int64))
                    columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]])) for i in range(5)]
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(owner), *columns, pa.array(np.full(len(owner), length, np.int32))], ["key", "at", "lo", "hi", "anchor", "core", "length"])

    return of


def _sort_shard(lengths: tuple[int, ...]):
    """Which starts of the distinct pieces of each anchor repeat: those of a piece with copies all, others as the sort of an anchor's pieces tells."""

    def of(shard: pd.DataFrame) -> pd.DataFrame:
        pieces, counts = shard["piece"].tolist(), shard["starts"].to_numpy()
        several = shard.groupby("anchor")["anchor"].transform("size").to_numpy() > 1
        rows = np.flatnonzero(several)
        hits = [{} for _ in lengths]
        if len(rows):
            sorted_ = repeated_starts([pieces[i] for i in rows], counts[rows], lengths)
            hits = [dict(zip(rows.tolist(), h, strict=True)) for h in sorted_]
        anchors, digests, copies, out = shard["anchor"].tolist(), shard["digest"].tolist(), shard["copies"].tolist(), []
        for i, piece in enumerate(pieces):
            for kind, length in enumerate(lengths):
                if copies[i] > 1:
                    edges = [(0, min(counts[i], len(piece) - length + 1))] if len(piece) >= length else []
                elif i in hits[kind]:
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], hits[kind][i], [False]]).astype(np.int8))).reshape(-1, 2)
                else:
                    edges = []
                out.extend((anchors[i], digests[i], length, int(a), int(b - 1 + length)) for a, b in edges)
        return pd.DataFrame(out, columns=["anchor", "digest", "length", "a", "b"])

    return of


def repeated_anchors(keyed: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(key, at, lo, hi, anchor, core, length, n) for the anchors of distinct texts that stand at ``n`` places, two or more. ``keyed`` are (key: a digest, text), copies allowed."""
    anchors = written(keyed.mapInArrow(_find_anchors(lengths), "key binary, at long, lo long, hi long, anchor long, core long, length int"))
    place = F.xxhash64("key", "lo")
    places = cut(anchors.groupBy("anchor", "length").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("anchor", "length", "n"))
    return sieve(anchors, F.col("anchor"), places.select(F.col("anchor").alias("k"))).join(places, ["anchor", "length"])


def repeated_spans(keyed: DataFrame, anchors: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(key, start, stop): byte ranges of distinct texts covered by strings of ``length`` bytes that start elsewhere in distinct
    texts too, and the texts (key, text) that may hold any. ``keyed`` are (key: a digest, text), copies allowed, ``anchors``
    theirs of that length that repeat.

    Every start of ``length`` bytes has an anchor, the smallest hash of the grams in it, with more of the bytes around it.
    Equal strings have equal anchors at equal distances, so only starts whose anchor occurs at two places or more can
    repeat, and their pieces, the bytes that they need, are compared by anchor. Equal pieces are first brought together by
    their digests, within tasks and then across: of a passage that many texts hold one piece is sorted, and its places
    learn the verdict by digest. The distinct pieces of an anchor go to one shard, which is sorted by suffixes; neighbours
    with a common prefix of ``length`` bytes repeat. Anchors of very many places are dealt out over shards by the distance
    from start to anchor, in which equal strings agree.
    """
    lengths = (length,)
    found = cut(anchors.groupBy("key").agg(F.collect_set(F.struct("at", "lo", "hi", "anchor", "n")).alias("found")))
    held = sieve(keyed, F.xxhash64("key"), found.select(F.xxhash64("key").alias("k"))).groupBy("key").agg(F.first("text").alias("text"))
    each = held.join(found, "key").select("key", F.col("text").cast("binary").alias("bytes"), F.explode("found").alias("f")).select("key", "bytes", "f.*")
    hot = F.col("n") > HOT_PLACES
    block = F.explode(F.when(hot, F.sequence(F.expr(f"(at - hi) div {HOT_BLOCK}"), F.expr(f"(at - lo) div {HOT_BLOCK}"))).otherwise(F.array(F.lit(-1).cast("long"))))
    dealt = each.select("key", "bytes", "at", "lo", "hi", "anchor", block.alias("j")).select(
        "key",
        "bytes",
        F.when(F.col("j") < 0, F.col("lo")).otherwise(F.greatest("lo", F.col("at") - HOT_BLOCK * F.col("j") - (HOT_BLOCK - 1))).alias("lo"),
        F.when(F.col("j") < 0, F.col("hi")).otherwise(F.least("hi", F.col("at") - HOT_BLOCK * F.col("j"))).alias("hi"),
        F.xxhash64("anchor", "j").alias("anchor"),
    )
    pieces = dealt.select("key", "lo", (F.col("hi") - F.col("lo") + 1).alias("starts"), "anchor", F.substring("bytes", F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo") + length).cast("int")).alias("piece"))
    pieces = pieces.withColumn("digest", F.unhex(F.md5("piece")))
    distinct = written(pieces.groupBy("anchor", "digest", "starts").agg(F.first("piece").alias("piece"), F.count(F.lit(1)).alias("copies")))
    size = distinct.agg(F.sum(F.length("piece"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    judged = distinct.withColumn("shard", F.pmod("anchor", F.lit(shards))).groupBy("shard").applyInPandas(_sort_shard(lengths), "anchor long, digest binary, length int, a long, b long")
    verdicts = cut(judged.groupBy("anchor", "digest").agg(F.collect_set(F.struct("length", "a", "b")).alias("v")))
    spans = pieces.select("key", "lo", "anchor", "digest").join(verdicts, ["anchor", "digest"]).select("key", "lo", F.explode("v").alias("v"))
    return spans.select("key", (F.col("lo") + F.col("v.a")).alias("start"), (F.col("lo") + F.col("v.b")).alias("stop")), held


def _merged(spans: DataFrame) -> DataFrame:
    """(key, length, start, stop) with the ranges that touch joined, for each key and length."""
    order = Window.partitionBy("key", "length").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.withColumn("new", (before.isNull() | (F.col("start") > before)).cast("int"))
    return begins.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("key", "length", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def _covered(spans: Column) -> Column:
    return F.coalesce(F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"]), F.lit(0).cast("bigint"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, passage: int = 250) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated, kept (the remaining bytes).

    Removed is each byte covered by a string of ``length`` bytes that also starts anywhere else, in the same or another
    text; all strings are judged on the input. ``n_repeated`` tells of shorter passages, which are not removed: it counts
    the bytes of anchors' cores of strings of ``passage`` bytes (``core_size``, 157 of 250) that stand elsewhere too; every
    string of ``passage`` bytes that repeats holds one. Texts that occur in two rows or more repeat as a whole. Null is
    empty. Repeated rows count as occurrences. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    keyed = rows.select("key", "text")
    anchors = cut(repeated_anchors(keyed, (passage, length) if passage < length else (length,)))
    spans, held = repeated_spans(keyed, anchors.where(F.col("length") == length), length)
    cores = anchors.where(F.col("length") == passage).select("key", F.lit(passage).alias("length"), F.col("core").alias("start"), (F.col("core") + core_size(passage)).alias("stop"))
    ranges = _merged(spans.select("key", F.lit(length).alias("length"), "start", "stop").unionByName(cores)).groupBy("key")
    of_length = [F.sort_array(F.collect_list(F.when(F.col("length") == n, F.struct("start", "stop")))).alias(name) for n, name in ((length, "gone"), (passage, "also"))]
    found = ranges.agg(*of_length).select("key", "gone", _covered(F.col("also")).alias("n_repeated"))
    cut_texts = held.join(found.where(F.size("gone") > 0).select("key", "gone"), "key")
    # what remains is put together as hexadecimal digits, since strings can be joined in one pass
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("gone", lambda s: s["stop"]))
    ends = F.concat(F.transform("gone", lambda s: s["start"]), F.array(F.octet_length("text").cast("bigint")))
    parts = F.zip_with(begins, ends, lambda a, b: F.hex(F.substring(F.col("text").cast("binary"), (a + 1).cast("int"), (b - a).cast("int"))))
    left = cut_texts.select("key", F.unhex(F.array_join(parts, "")).alias("left"))
    known = found.select("key", F.size("gone").alias("n_spans"), _covered(F.col("gone")).alias("n_removed"), "n_repeated").join(left.select("key", "left", F.sha2("left", 256).alias("sha")), "key", "left")
    copied = rows.where(F.octet_length("text") >= passage).groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    side = copied.join(known, "key", "full")
    own = rows.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"), F.col("text").cast("binary").alias("bytes"), F.xxhash64("id", "key").alias("spread"))
    joined = spread_join(own, side, "key", "spread")
    whole = F.coalesce("copies", F.lit(1)) > 1
    gone, cut_any = whole & (F.col("n_bytes") >= length), F.coalesce("n_spans", F.lit(0)) > 0
    return joined.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).when(cut_any, F.col("sha")).otherwise(F.col("own")).alias("kept_sha256"),
        F.when(whole & (F.col("n_bytes") >= passage), F.col("n_bytes")).otherwise(F.coalesce("n_repeated", F.lit(0).cast("long"))).alias("n_repeated"),
        F.when(gone, F.lit(b"")).when(cut_any, F.col("left")).otherwise(F.col("bytes")).alias("kept"),
    )
