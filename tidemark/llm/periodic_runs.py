"""Runs of words that repeat periodically, by a dictionary of basic factors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of documents that are worked on together; a longer document is worked on alone.
CHUNK_WORDS = 1 << 17
#: A run is at least so long, and at least two periods.
LEAST = 12


class Factors:
    """The dictionary of basic factors of a sequence: for every power of two, which positions start equal stretches of that length.

    ``names[k][i]`` names the stretch of ``2 ** k`` from ``i``; a stretch that occurs once has a name below zero, told by
    its position. Levels end where nothing occurs twice.
    """

    def __init__(self, codes: np.ndarray):
        self.names: list[np.ndarray] = []
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []
        n = len(codes)
        at, keys = np.arange(n), codes
        while len(at):
            order = np.argsort(keys, kind="stable")
            at, keys = at[order], keys[order]
            again = keys[1:] == keys[:-1]
            shared = np.concatenate([again, [False]]) | np.concatenate([[False], again])
            at, keys = at[shared], keys[shared]
            if not len(at):
                break
            group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
            names = -1 - np.arange(n)
            names[at] = group
            size = 1 << len(self.names)
            self.names.append(names)
            self.groups.append((at, group))
            first = np.sort(at)
            first = first[first + 2 * size <= n]
            first = first[names[first + size] >= 0]
            at, keys = first, names[first] * n + names[first + size]

    def proposals(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per level (positions, periods) that stretches and their later occurrences propose; the stretch from the position occurs again a period later.

        Occurrences of a stretch of ``2 ** k`` form arithmetic progressions where they overlap. From each position the
        progressions within ``2 ** (k + 1)`` are walked, and the first and last member of each proposes its distance. Members
        between them lie in one run of a smaller period, so every run with a period of ``2 ** k`` to ``2 ** (k + 1)`` has a
        position that proposes it.
        """
        for k, (at, group) in enumerate(self.groups):
            low, high = 1 << k, 2 << k
            n = len(at)
            gap = np.where(group[1:] == group[:-1], at[1:] - at[:-1], high)
            gap = np.minimum(np.concatenate([gap, [high]]), high)
            # index of the last member of the progression that starts with a member's step to its successor
            ends = np.concatenate([np.flatnonzero((gap[1:] != gap[:-1]) | (group[1:] != group[:-1])), [n - 1]])
            last = np.minimum(ends[np.searchsorted(ends, np.arange(n))] + 1, n - 1)
            start = cur = np.flatnonzero(gap < high)
            found = []
            while len(cur):
                for to in (cur + 1, last[cur]):
                    period = at[to] - at[start]
                    ok = (period >= low) & (period < high)
                    found.append((at[start[ok]], period[ok]))
                cur = last[cur]
                more = (gap[cur] < high) & (at[cur] - at[start] < high)
                start, cur = start[more], cur[more]
            if found:
                i, q = (np.concatenate(x) for x in zip(*found, strict=True))
                key = np.unique(q * (at.max() + 2) + i)
                i, q = key % (at.max() + 2), key // (at.max() + 2)
                fresh = np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1] + 1)]) if len(i) else np.zeros(0, bool)
                yield i[fresh], q[fresh]

    def extended(self, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest (start, end) around ``i`` in which elements ``q`` apart are equal, by the factors from the longest to the shortest."""
        n = len(self.names[0])
        right, left = np.zeros_like(i), np.zeros_like(i)
        for k in range(len(self.names) - 1, -1, -1):
            size, names = 1 << k, self.names[k]
            a = i + right
            ok = a + q + size <= n
            ok[ok] = names[a[ok]] == names[a[ok] + q[ok]]
            right[ok] += size
            a = i - left - size
            ok = a >= 0
            ok[ok] = names[a[ok]] == names[a[ok] + q[ok]]
            left[ok] += size
        return i - left, i + q + right


def find_runs(codes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of every maximal run of ``codes``, by start and period.

    A run has its smallest period and is at least ``least`` and two periods long. A stretch that several periods propose
    keeps the smallest, which divides the others.
    """
    factors = Factors(np.asarray(codes, dtype=np.int64))
    rows = [np.zeros((0, 3), dtype=np.int64)]
    for i, q in factors.proposals():
        start, end = factors.extended(i, q)
        ok = end - start >= np.maximum(least, 2 * q)
        rows.append(np.stack([start[ok], end[ok], q[ok]], axis=1))
    found = np.concatenate(rows)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if len(found):
        found = found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def planted(words: list[bytes], identifier: bytes) -> list[bytes]:
    """``words``, for one identifier in ten rewritten from some word on to repeat what stands there."""
    h, n = zlib.crc32(identifier), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + period]
    return words[:a] + (tail * ((n - a) // period + 1))[: n - a]


_SCHEMA = pa.schema([("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("collapsed", pa.string())])


def _reports(texts: list[list[bytes]], with_text: bool) -> pa.RecordBatch:
    """One row per document; ``texts`` are their words."""
    sizes = np.array([len(w) for w in texts])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    codes, base = np.empty(bounds[-1], dtype=np.int64), 0
    # a code belongs to one document, so no factor is found in two of them and no run crosses a border
    for j, words in enumerate(texts):
        known = {w: base + c for c, w in enumerate(dict.fromkeys(words))}
        codes[bounds[j] : bounds[j + 1]] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        base += len(known)
    runs = find_runs(codes)
    covered = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(covered, runs[:, 0] + runs[:, 2], 1)
    np.add.at(covered, runs[:, 1], -1)
    dropped = np.cumsum(covered)[:-1] > 0
    ends = np.searchsorted(runs[:, 0], bounds, "left")
    out = []
    for j, words in enumerate(texts):
        mine = runs[ends[j] : ends[j + 1]] - [bounds[j], bounds[j], 0]
        listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in mine.tolist())
        best = min(((s - e, s, q) for s, e, q in mine.tolist()), default=None)
        gone = dropped[bounds[j] : bounds[j + 1]]
        kept = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x] if gone.any() else words)
        top = (None,) * 4 if best is None else (best[1], -best[0], best[2], -1000 * best[0] // best[2])
        out.append((len(mine), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _scan(rewrite: bool, with_text: bool):
    """(id, reports) from (id, name, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held, done = [], 0, 0
            for at, (name, text) in enumerate(zip(batch.column("name"), batch.column("text"), strict=True), 1):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                texts.append(planted(words, name.as_py().encode()) if rewrite and name.is_valid else words)
                held += len(words)
                if held >= CHUNK_WORDS or at == batch.num_rows:
                    out = _reports(texts, with_text)
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(done, len(texts)), *out.columns], ["id", *out.schema.names])
                    texts, held, done = [], 0, at

    return scan


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = False, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_runs, the longest run (start, length, period, exponent_milli; nulls without one), runs_sha256, collapsed_sha256 and, ``with_text``, the collapsed text.

    Words are maximal runs of other characters than ASCII white space, numbered from 0. A run is a stretch whose words a
    period apart are equal, that no neighbouring word extends, at least ``LEAST`` words and two periods long, told by its
    smallest period. Of equally long runs the one that starts first, then that of the smaller period is told. Collapsing drops the
    words that any run contains after its first period and joins the others by one space. ``rewrite`` plants runs in one
    document of ten, by its identifier, before all this.

    A document is its own affair: whole texts are worked on where they are read, without a shuffle, some together in
    chunks of bounded size; memory grows with the longest text. Null and empty texts have no words and no runs. Rows that
    repeat an identifier give one result each, null identifiers are never rewritten, an empty table gives an empty result.
    Other columns are ignored.
    """
    mine = F.col(f"`{id_col}`")
    given = docs.select(mine.alias("id"), mine.cast("string").alias("name"), F.col(f"`{text_col}`").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    found = given.mapInArrow(_scan(rewrite, with_text), f"id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string")
    columns = [c for c in found.columns[1:] if with_text or c != "collapsed"]
    return found.select(F.col("id").alias(id_col), *columns)
