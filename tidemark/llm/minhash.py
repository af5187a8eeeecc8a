"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, sieve, spread_join, written

#: Words of a shingle, and the percentage of shared shingles from which two sets are linked.
WORDS, PERCENT = 5, 85
#: Bands of a sketch and the bins that each joins: of two sets at 85 % all but 2 in a million share a band.
BANDS, ROWS = 28, 6
BINS = BANDS * ROWS
#: A sketch keeps one bit of each bin. Half of the bins that differ agree in it by chance, so sets at 85 % share 155 of 168
#: bits on average, with a standard deviation of 4. Pairs of sets of so many shingles that share fewer bits go unread.
LEAST_BITS, SKETCHED = 134, 64
#: Members outside a bucket's main component that are compared with all of it; where there are more, sets meet again by their rarest shingles.
CROWDED = 16
#: Shelves on which shingles of crowded buckets are counted, to order them by rarity.
SHELVES = 1 << 20

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread evenly, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Hashes of words, kept for a batch."""

    def __missing__(self, word: bytes) -> int:
        return self.setdefault(word, xxhash.xxh64_intdigest(word))


def shingle_set(text: bytes, words: int, known: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; of the whole sequence if it is shorter; none without words.

    Words are maximal runs of other bytes than ASCII white space, A-Z in lower case. A run's hash chains its words' hashes.
    """
    known = _WordHashes() if known is None else known
    w = text.lower().split()
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    size = min(words, len(w))
    if not size:
        return h
    out = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = _mixed(out * _STEP + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def _probe(bins: np.ndarray, attempt: int) -> np.ndarray:
    """Where an empty bin looks at its ``attempt``-th try, the same for all sets."""
    return (_mixed(bins.astype(np.uint64) * np.uint64(1 << 32) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BINS) bins of sorted hashes, no set empty.

    One permutation: a hash's leading part tells its bin, and the smallest hash of a bin is its value. An empty bin takes
    the value of the first bin that holds one along a sequence of its own, which all sets share (optimal densification),
    so two sets agree in any bin with the probability of their similarity.
    """
    out = np.zeros((len(sets), BINS), dtype=np.uint64)
    held = np.zeros((len(sets), BINS), dtype=bool)
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), sizes)
    at = ((values >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    key = of * BINS + at
    first = np.concatenate([[True], key[1:] != key[:-1]])
    out.ravel()[key[first]] = values[first]
    held.ravel()[key[first]] = True
    row, empty = np.nonzero(~held)
    attempt = 0
    while len(row):
        attempt += 1
        to = _probe(empty, attempt)
        hit = held[row, to]
        out[row[hit], empty[hit]] = out[row[hit], to[hit]]
        row, empty = row[~hit], empty[~hit]
    return out


def band_slots(sketch: np.ndarray) -> np.ndarray:
    """One number per band."""
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    out = np.zeros((len(sketch), BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = _mixed(out * _STEP + parts[:, :, k])
    return out


def sketch_bits(sketch: np.ndarray) -> np.ndarray:
    """A bit of every bin, in three numbers of 56 bits."""
    bits = (_mixed(sketch) >> np.uint64(63)).reshape(len(sketch), 3, BINS // 3)
    return (bits << np.arange(BINS // 3, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    known = _WordHashes()
    for text in batch.column("text"):
        yield shingle_set(text.as_buffer().to_pybytes() if text.is_valid else b"", words, known)


def _sketched(words: int):
    """(id, row, k, sha, n, slots, bits) from (id, row, k, text); without words there is no digest and no slot."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "row", "k", "sha", "n", "slots", "bits"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = list(_sets(part, words))
                some = [j for j, x in enumerate(found) if len(x)]
                slots, bits = [None] * len(found), [None] * len(found)
                if some:
                    sketch = sketches([found[j] for j in some])
                    for j, s, b in zip(some, band_slots(sketch).view(np.int64).tolist(), sketch_bits(sketch).view(np.int64).tolist(), strict=True):
                        slots[j], bits[j] = s, b
                shas = pa.array([_digest(x) if len(x) else None for x in found], pa.binary())
                sizes = pa.array([len(x) for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names[:3]], shas, sizes, pa.array(slots, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names)

    return sketched


def _whole(words: int):
    """(t, hs) from (t, sha, text), where the text has that digest."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [(t, x) for t, sha, x in zip(part.column("t").to_pylist(), part.column("sha").to_pylist(), _sets(part, words), strict=True) if _digest(x) == sha]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int64()), pa.array([x.view(np.int64) for _, x in found], pa.list_(pa.int64()))], ["t", "hs"])

    return whole


def _alike(percent: int, a: str = "a", b: str = "b") -> Column:
    """May two sets of sizes n and sketches bits be linked?"""
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(3)), F.lit(0))
    return (low * 100 >= high * percent) & ((low < SKETCHED) | (apart <= BINS - LEAST_BITS))


def _met(posted: DataFrame) -> DataFrame:
    """(slot, t, rep, pos) of buckets with several members, pos being null, counted before members are shuffled.

    The centre ``rep`` is the member whose buckets are the fullest: of near copies of one text that is the one that the
    others differ from least.
    """
    shared = cut(posted.groupBy("slot").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    met = cut(sieve(posted, F.col("slot"), shared.select(F.col("slot").alias("k"))).join(shared, "slot"))
    full = met.groupBy("t").agg(F.sum("c").alias("w"))
    centre = met.join(full, "t").groupBy("slot").agg(F.max(F.struct("w", "t")).alias("best"))
    return cut(met.select("slot", "t").join(centre.select("slot", F.col("best.t").alias("rep")), "slot").withColumn("pos", F.lit(None).cast("int")))


def _linked(pairs: DataFrame, sets: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose whole sets are similar enough."""
    side = sets.select("t", F.struct("n", "bits").alias("of"))
    near = pairs.join(side.select(F.col("t").alias("a"), F.col("of").alias("x")), "a").join(side.select(F.col("t").alias("b"), F.col("of").alias("y")), "b").where(_alike(percent, "x", "y")).select("a", "b")
    both = near.join(held.select(F.col("t").alias("a"), F.col("hs").alias("ha")), "a").join(held.select(F.col("t").alias("b"), F.col("hs").alias("hb")), "b")
    sized = both.select("a", "b", (F.size("ha") + F.size("hb")).alias("n"), F.size(F.array_intersect("ha", "hb")).alias("c"))
    return cut(sized.where(F.col("c") * 100 >= (F.col("n") - F.col("c")) * percent).select("a", "b"))


def _pairs(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def similar_links(sets: DataFrame, held, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that connect what all pairs of ``sets`` (t, n, slots, bits) that share a bucket and are similar enough connect.

    Candidates are stars: every member of a bucket is compared with its centre alone, so a bucket costs as many pairs as
    it has members. What the stars have linked is one component. A bucket that holds several components still has its
    members outside the main one compared with those of other components, if they are few (``CROWDED``). The members of
    buckets with more of them meet again by their rarest shingles (``_prefixes``), which leaves out none that are similar
    enough and parts those that differ in many places, each by shingles of its own.

    ``held(wanted)`` gives the whole sets (t, hs) of the identifiers ``wanted`` (t); it is asked once.
    """
    met = _met(sets.select(F.explode("slots").alias("slot"), "t"))
    whole = held(met.select("t").distinct())
    links = _linked(met.where("t <> rep").select(*_pairs("t", "rep")).distinct(), sets, whole, percent)
    parts = cut(components(links)).withColumnRenamed("node", "t")
    mixed = cut(_mixed_buckets(met, parts))
    found = _listed(mixed.where(F.col("outside") <= CROWDED), sets, percent)
    crowd = cut(mixed.where(F.col("outside") > CROWDED).select("t").distinct())
    if not crowd.isEmpty():
        found = found.unionByName(_listed(_mixed_buckets(_prefixes(crowd, whole, percent), parts), sets, percent))
    return links.unionByName(_linked(found.distinct(), sets, whole, percent))


def _mixed_buckets(met: DataFrame, parts: DataFrame) -> DataFrame:
    """``met`` (slot, t, pos) with part, main and outside, of buckets that hold several components; ``outside`` counts the members beyond the largest of them."""
    placed = met.select("slot", "t", "pos").join(parts, "t", "left").select("slot", "t", "pos", F.coalesce("component", "t").alias("part"))
    sizes = placed.groupBy("slot", "part").agg(F.count(F.lit(1)).alias("n"))
    split = sizes.groupBy("slot").agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("c"))
    return placed.join(split.select("slot", F.col("main.part").alias("main"), (F.col("c") - F.col("main.n")).alias("outside")).where("outside > 0"), "slot")


def _listed(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members outside a bucket's main component with those of other components, sifted by size, sketch and position; a bucket's members are dealt to a lane for each ``CROWDED`` outside.

    If the first shingle that two sets share stands at ``pos`` of each, no more are shared than follow it in either. Where
    ``pos`` is null that says nothing.
    """
    told = mixed.join(sets.select("t", "n", "bits"), "t").withColumn("lanes", F.ceil(F.col("outside") / CROWDED).cast("int"))
    side = F.struct("t", "part", "n", "bits", "pos")
    some = told.where("part <> main").select("slot", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), side.alias("x"))
    every = told.select("slot", F.pmod(F.xxhash64("t"), "lanes").cast("int").alias("lane"), side.alias("y"))
    most = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) + 1
    enough = F.coalesce(most * 100 >= (F.col("x.n") + F.col("y.n") - most) * percent, F.lit(True))
    meets = (F.col("s.slot") == F.col("e.slot")) & (F.col("s.lane") == F.col("e.lane")) & F.expr("x.part <> y.part") & enough & _alike(percent, "x", "y")
    return some.alias("s").join(every.alias("e"), meets).select(*_pairs("x.t", "y.t")).distinct()


def _shelf(hashes: np.ndarray) -> np.ndarray:
    return (_mixed(hashes) & np.uint64(SHELVES - 1)).astype(np.int64)


def _shelf_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shelf, c) of a task's shingles, summed in the task."""
    total = np.zeros(SHELVES, dtype=np.int64)
    for batch in batches:
        total += np.bincount(_shelf(batch.column("hs").flatten().to_numpy().view(np.uint64)), minlength=SHELVES)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["shelf", "c"])


def _rarest(counts: np.ndarray, percent: int):
    """(slot, t, pos) of the prefixes from (t, hs)."""

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, ts, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for t, hs in zip(batch.column("t").to_pylist(), batch.column("hs"), strict=True):
                h = hs.values.to_numpy().view(np.uint64)
                c = counts[_shelf(h)]
                first = np.lexsort((h, c))[: len(h) + (-len(h) * percent // 100) + 1]
                shared = np.flatnonzero(c[first] > 1)
                slots.append(h[first[shared]])
                ts.append(np.full(len(shared), t, dtype=np.int64))
                places.append(shared + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots).view(np.int64)), pa.array(np.concatenate(ts)), pa.array(np.concatenate(places), pa.int32())], ["slot", "t", "pos"])

    return rarest


def _prefixes(members: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(slot, t, pos): the rarest shingles of each set by their position, so many that two similar sets share one of them.

    Similar sets share ``percent`` of each at least, so of either's shingles in any common order the first
    ``n - ceil(n * percent / 100) + 1`` hold one that both have there. The order here is by the counts among ``members``
    of the ``SHELVES`` that shingles fall on by hash, then by hash: the table of counts is of one size whatever the input,
    and shingles that share a shelf only come later than they might. A shingle alone on its shelf is in no other set.
    """
    held = members.join(whole, "t").select("t", "hs")
    told = held.mapInArrow(_shelf_counts, "shelf long, c long").groupBy("shelf").agg(F.sum("c").alias("c")).toArrow()  # SHELVES rows at most
    counts = np.zeros(SHELVES, dtype=np.int32)
    counts[told.column("shelf").to_numpy()] = np.minimum(told.column("c").to_numpy(), np.iinfo(np.int32).max)
    return held.mapInArrow(_rarest(counts, percent), "slot long, t long, pos int")


def minhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest identifier reachable), kept (that is the row's own).

    Texts are linked if their sets of shingles share ``percent`` or more of their union, confirmed on whole sets of 64-bit
    hashes. Texts of equal sets, copies among them, meet by digest and are one member from then on. Candidates come from
    ``BANDS`` bands of a one-permutation sketch: about 2 in a million of the pairs exactly at 85 % share none.

    Null and empty texts and those of white space alone have no shingles, link with nothing and are their own component.
    A null identifier counts only where a component has no other. Repeated rows give one result each. An empty table
    gives an empty result. Other columns are ignored.
    """
    mine, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    given = docs.select(mine.alias("id"), F.xxhash64(mine, text).alias("k"), text.alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    numbered = given.select("id", F.monotonically_increasing_id().alias("row"), "k", "text")
    rows = written(numbered.mapInArrow(_sketched(words), f"id {kind}, row long, k long, sha binary, n long, slots array<long>, bits array<long>"))
    one = rows.where("n > 0").groupBy("sha").agg(F.min(F.struct("k", "n", "slots", "bits")).alias("s"), F.min("id").alias("low"))
    sets = written(one.select("sha", "low", "s.*", F.monotonically_increasing_id().alias("t")))

    def held(wanted: DataFrame) -> DataFrame:
        keys = cut(sets.select("t", "sha", "k").join(wanted, "t"))
        some = sieve(given.select("k", "text"), F.col("k"), keys.select("k")).join(keys, "k").select("t", "sha", "text")
        return written(some.mapInArrow(_whole(words), "t long, hs array<long>").dropDuplicates(["t"]))

    parts = components(similar_links(sets.select("t", "n", "slots", "bits"), held, percent))
    rooted = cut(sets.select("t", "sha", "low").join(parts.withColumnRenamed("node", "t"), "t", "left").select("sha", "low", F.coalesce("component", "t").alias("root")))
    side = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("sha", "component_id")
    placed = spread_join(rows.select("id", "row", "sha", "n"), side, "sha", "row")
    component = F.coalesce("component_id", "id")
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
