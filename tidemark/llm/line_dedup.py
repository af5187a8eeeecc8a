"""Fuzzy line deduplication: SimHashes of normalised lines, pigeonhole blocks, edit similarity, connected groups."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import components, cut, document_key, let, packed, release, sieve, written

#: Edit similarity of linked lines, and the differing bits of 56 up to which SimHashes over words and over grams let a pair be compared.
SIMILARITY, WORD_BITS, GRAM_BITS = 0.8, 19, 16
#: Members of a posting that one task compares with all of it; a posting with more of them is dealt over as many lanes as that takes.
PAIRED_POSTING = 1024
#: A posting with more loose members is crowded: before they meet all of it, its members are compared with so many neighbours each.
CROWDED, NEIGHBOURS = 32, 4
#: Up to so many characters a similarity of 0.8 allows one edit at most, which texts with one character left out find for certain.
ONE_EDIT = 9
#: Seeds of the 64 more SimHash bits each that are made of the texts of candidates, and the differing bits allowed in all of these.
MORE_SEEDS, MORE_WORD_BITS, MORE_GRAM_BITS = (101, 102), 44, 37
#: Ways to cut a line into features, chosen by its bytes (and by its long words): from, below, bytes of a gram, groups, features of
#: a block. The ranges overlap by more than a line of similarity 0.8 can be longer.
GRAM_FORMS = ((10, 32, 3, 6, 2), (24, 60, 4, 6, 3), (48, 120, 5, 12, 3))
#: From, below so many words of over ``SHORT_WORD`` bytes, groups, features of a block.
WORD_FORMS = ((12, 30, 9, 2), (24, 1 << 60, 16, 2))
WORDS_FROM, SHORT_WORD, FEW_WORDS = 96, 3, 15
#: Lines of fewer blocks, since few features repeat in them, are posted under every two of five blocks of their whole SimHash too.
FEW_BLOCKS = 5
#: Kinds of characters that lines are counted by.
KINDS = 32
#: Text that one pass of the hashing below holds as 64-bit numbers.
CHUNK_BYTES = 1 << 21
_CONTROLS = bytes([*range(9), *range(14, 32), 127])
_PLAIN = np.array([c if c == 10 or 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else 32 for c in range(256)], dtype=np.uint8)
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        known[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(known)
    return known[:n]


def normalise(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The lines of all ``texts`` and the place of each one's text.

    Lower case, digits to 0, other ASCII characters and white space to single spaces; a line without letters and digits
    keeps its other characters, as one word. The empty text has one blank line.
    """
    low = pc.binary_join_element_wise(pc.utf8_lower(texts), "", "\n")
    offsets = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    raw = np.frombuffer(low.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    x = _PLAIN[raw]
    breaks = np.flatnonzero(x == 10)
    x = x[(x != 32) | np.concatenate([[False], (x[:-1] != 32) & (x[:-1] != 10)])]
    x = x[(x != 32) | np.concatenate([x[1:] != 10, [False]])]
    lines = x.tobytes().split(b"\n")[:-1]
    if b"" in lines:
        for i in [i for i, line in enumerate(lines) if not line]:
            lines[i] = b"".join(raw[(breaks[i - 1] + 1 if i else 0) : breaks[i]].tobytes().translate(None, _CONTROLS).split())
    return lines, np.searchsorted(offsets[1:] - offsets[0], breaks, side="right")


class _Lines:
    """Lines in one array, each ended by a line break, with their long words."""

    def __init__(self, lines: list[bytes]) -> None:
        self.x = x = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
        end = x == 10
        ends = np.flatnonzero(end)
        self.starts = np.concatenate([[0], ends[:-1] + 1])
        self.size = ends - self.starts
        self.chars = np.add.reduceat(((x & 0xC0) != 0x80).astype(np.int64), self.starts) - 1
        edges = np.flatnonzero(np.diff(np.concatenate([[False], (x != 32) & ~end]).astype(np.int8)))
        first, last = edges[0::2], edges[1::2]
        long = last - first > SHORT_WORD
        self.first, self.last = first[long], last[long]
        self.line = np.cumsum(end, dtype=np.int32)[self.first]
        self.words = np.bincount(self.line, minlength=len(lines))
        self.wordy = (self.size >= WORDS_FROM) & (self.words >= WORD_FORMS[0][0])

    def word_hashes(self) -> np.ndarray:
        sums = np.zeros(len(self.x) + 1, np.uint64)
        np.cumsum((self.x + np.uint64(1)) * _powers(_INVERSE, len(self.x)), out=sums[1:])
        return _mix((sums[self.last] - sums[self.first]) * _powers(_ODD, len(self.x))[self.first])

    def gram_hashes(self, wanted: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Lines and hashes of all grams of the wanted lines."""
        at = np.flatnonzero(wanted & (self.size >= gram))
        n = self.size[at] - gram + 1
        pos = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        h = np.zeros(len(pos), np.uint64)
        for i in range(gram):
            h = (h << np.uint64(8)) | self.x[pos + i]
        return np.repeat(at, n), _mix(h + np.uint64(_ODD))


    def letters(self) -> np.ndarray:
        """How many characters of each of ``KINDS`` kinds a line has, at most 255: a kind is told by a character's last byte."""
        last = (np.append(self.x[1:], 10) & 0xC0) != 0x80
        last[self.x == 10] = False
        owner = np.repeat(np.arange(len(self.size)), self.size + 1)[last]
        kind = self.x[last] & (KINDS - 1)
        return np.minimum(np.bincount(owner * KINDS + kind, minlength=KINDS * len(self.size)), 255).astype(np.uint8).reshape(-1, KINDS)


def _blocks(line: np.ndarray, h: np.ndarray, rank: np.ndarray | None, groups: int, few: int, form: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines and their blocks: the features of a line are dealt to groups by their hashes, and a block is the SimHash of a
    group's ``few`` least features; groups of fewer have none."""
    h = _mix(h + np.uint64(form))
    group = ((h >> np.uint64(56)) * np.uint64(groups)) >> np.uint64(8)
    feature = h & np.uint64((1 << 40) - 1) if rank is None else (rank << np.uint64(37)) | (h & np.uint64((1 << 37) - 1))
    ordered = (line.astype(np.uint64) << np.uint64(44)) | (group << np.uint64(40)) | feature
    ordered.sort()
    ordered = ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]
    owner = ordered >> np.uint64(40)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    first = first[np.diff(np.append(first, len(owner))) >= few]
    each = [_mix(ordered[first + i] & np.uint64((1 << 40) - 1)) for i in range(few)]
    # a bit is set if it is in over half of the features
    bits = each[0] & each[1] if few == 2 else (each[0] & each[1]) | (each[0] & each[2]) | (each[1] & each[2])
    # of two features few bits are left, so that the others are mixed in
    bits = _mix(bits + np.uint64(_ODD) * (each[0] ^ each[1]) if few == 2 else bits)
    name = (owner[first] & np.uint64(15)) | np.uint64(form << 4)
    return (owner[first] >> np.uint64(4)).astype(np.int64), _mix(bits ^ (name * np.uint64(_ODD)))


def _simhash(line: np.ndarray, h: np.ndarray, out: np.ndarray) -> None:
    """The SimHash of all features of each line, into ``out``."""
    if not len(line):
        return
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    n = np.diff(np.append(first, len(line)))
    # bytes of a 64-bit sum count bits over at most 255 features; pieces of that length are then added up by line
    pieces = -(-n // 255)
    lead = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    begin = np.repeat(first, pieces) + (np.arange(pieces.sum()) - np.repeat(lead, pieces)) * 255
    counts = np.empty((len(begin), 8, 8), dtype=np.int32)
    for i in range(8):
        lanes = np.add.reduceat((h >> np.uint64(i)) & np.uint64(0x0101010101010101), begin)
        counts[:, :, i] = lanes.view(np.uint8).reshape(-1, 8)
    ones = np.add.reduceat(counts.reshape(len(begin), 64), lead, axis=0)
    bits = (ones * 2 > n[:, None]).astype(np.uint8)
    out[line[first]] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def _left_out(line: str) -> list[int]:
    """Numbers of the line and of what it is without one of its characters; lines within one edit share one."""
    forms = {line} | {line[:i] + line[i + 1 :] for i in range(len(line))}
    return [int.from_bytes(hashlib.md5(f.encode()).digest()[:8], "little", signed=True) for f in forms]


def line_blocks(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, slot, sketch) of every block of ``lines``, none of them blank.

    A sketch has 56 bits of the SimHash of all words or grams of the line, as the block has words or grams, one bit that
    tells which, and 7 of the length's logarithm.
    """
    t = _Lines(lines)
    rank = np.uint64(7) - np.clip(t.last - t.first - SHORT_WORD - 1, 0, 7).astype(np.uint64)
    h = t.word_hashes()
    words, grams = [], []
    for form, (low, below, groups, few) in enumerate(WORD_FORMS):
        use = (t.wordy & (t.words >= low) & (t.words < below))[t.line]
        if use.any():
            words.append(_blocks(t.line[use], h[use], rank[use], groups, few, form))
    for form, (low, below, gram, groups, few) in enumerate(GRAM_FORMS, len(WORD_FORMS)):
        wanted = (t.size >= low) & (t.size < below)
        if form == len(WORD_FORMS) + len(GRAM_FORMS) - 1:
            wanted |= (t.size >= WORDS_FROM) & (t.words < FEW_WORDS)
        line, g = t.gram_hashes(wanted, gram)
        if len(line):
            grams.append(_blocks(line, g, None, groups, few, form))
    short = [(i, s) for i in np.flatnonzero(t.chars <= ONE_EDIT).tolist() for s in _left_out(lines[i].decode())]
    if short:
        grams.append((np.array([i for i, _ in short]), np.array([s for _, s in short], np.int64).view(np.uint64)))
    have = np.bincount(np.concatenate([x[0] for x in words + grams] or [np.zeros(0, np.int64)]), minlength=len(lines))
    poor = np.flatnonzero((have < FEW_BLOCKS) & (t.chars > ONE_EDIT))
    by_words, by_grams = np.zeros(len(lines), np.uint64), np.zeros(len(lines), np.uint64)
    use = t.wordy[t.line]
    _simhash(t.line[use], h[use], by_words)
    of_grams = ~t.wordy
    of_grams[poor] = True
    for at, _ in grams:
        of_grams[at] = True
    _simhash(*t.gram_hashes(of_grams, 4), by_grams)
    for form, kept in enumerate(combinations(range(5), 2), 8):
        mask = np.uint64(sum(((1 << 64 * (b + 1) // 5) - (1 << 64 * b // 5)) for b in kept))
        grams.append((poor, _mix((by_grams[poor] & mask) ^ np.uint64(form * _ODD % (1 << 64)))))
    length = np.minimum(127, np.log(t.chars) / math.log(1.1)).astype(np.uint64)
    out = []
    for found, sims, kind in ((words, by_words, 128), (grams, by_grams, 0)):
        for at, slot in found:
            out.append((at, slot, (sims[at] & ~np.uint64(0xFF)) | np.uint64(kind) | length[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def edit_similar(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Whether the edit distance is at most ``1 - similarity`` of the longer text's characters (bit-parallel rows, stopped once it can't be)."""
    allowed = math.floor(max(len(a), len(b)) * (1 - similarity) + 1e-9)
    if a == b:
        return True
    if abs(len(a) - len(b)) > allowed:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # the length of the common start by halving
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[len(a) - mid : len(a) - lo] == b[len(b) - mid : len(b) - lo] else (lo, mid - 1)
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    if len(a) > len(b):
        a, b = b, a
    if not a or len(b) <= allowed:
        return len(b) <= allowed
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, len(a) - 1
    up, down, score, left = full, 0, len(a), len(b)
    for c in b:
        left -= 1
        eq = places.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(across | up), up & across
        if plus >> top & 1:
            score += 1
        elif minus >> top & 1:
            score -= 1
        if score - left > allowed:
            return False
        plus = plus << 1 | 1
        change = eq | down
        up, down = (minus << 1 | ~(change | plus)) & full, plus & change & full
    return score <= allowed


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, doc_key, n_lines, pos, key, k, line): one row per line that isn't blank, and one per document with pos -1.

    The row numbers hold within this table only; documents are found again by their keys.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    mine = F.col(f"`{id_col}`")
    src = docs.select(F.monotonically_increasing_id().alias("row"), mine.alias("id"), F.unhex(document_key(mine, text)).alias("doc_key"), text.alias("text"))
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()), src.schema["id"], T.StructField("doc_key", T.BinaryType()), T.StructField("n_lines", T.IntegerType()),
            T.StructField("pos", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("k", T.LongType()), T.StructField("line", T.BinaryType()),
        ]
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                lines, owner = normalise(batch.column("text"))
                counts = np.bincount(owner, minlength=batch.num_rows)
                pos = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(counts)[:-1]])[owner]
                empty = pc.equal(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
                some = [i for i, line in enumerate(lines) if line]
                held = [lines[i] for i in some]
                n_docs, at = batch.num_rows, pa.array(owner[some])
                none = pa.nulls(n_docs, pa.binary())
                digests = [hashlib.md5(x).digest() for x in held]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([batch.column("row"), batch.column("row").take(at)]),
                        pa.concat_arrays([batch.column("id"), batch.column("id").take(at)]),
                        pa.concat_arrays([batch.column("doc_key"), pa.nulls(len(held), batch.column("doc_key").type)]),
                        pa.concat_arrays([pa.array(np.where(empty, 0, counts), pa.int32()), pa.nulls(len(held), pa.int32())]),
                        pa.concat_arrays([pa.array(np.full(n_docs, -1), pa.int32()), pa.array(pos[some], pa.int32())]),
                        pa.concat_arrays([none, pa.array(digests, pa.binary())]),
                        pa.concat_arrays([pa.nulls(n_docs, pa.int64()), pa.array(np.frombuffer(b"".join(digests), np.int64)[::2])]),
                        pa.concat_arrays([none, pa.array(held, pa.binary())]),
                    ],
                    names=schema.names,
                )

    return written(src.mapInArrow(split, schema))


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, k, sketch) of lines (k, line). A line that repeats within a task is posted once, as far as its last 2 ** 18 lines tell."""
    seen: set[int] = set()
    for batch in batches:
        keys, lines = batch.column("k").to_pylist(), batch.column("line").to_pylist()
        fresh = {k: line for k, line in zip(keys, lines, strict=True) if k not in seen}
        if len(seen) > 1 << 18:
            seen.clear()
        seen.update(fresh)
        held: list[tuple[int, bytes]] = []
        size = 0
        for i, (k, line) in enumerate(fresh.items(), 1):
            held.append((k, line))
            size += len(line)
            if size >= CHUNK_BYTES or i == len(fresh):
                at, slots, sketch = line_blocks([x for _, x in held])
                k64 = np.array([x for x, _ in held], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slots.view(np.int64)), pa.array(k64[at]), pa.array(sketch.view(np.int64))], names=["slot", "k", "sketch"])
                held, size = [], 0


def _longer_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (key, k, line) with more SimHash bits: over words (null in lines that have too few) and over grams; and with their characters: how many of each kind, how many."""
    names = [f"{kind}{i}" for kind in "wg" for i in range(len(MORE_SEEDS))]
    for batch in batches:
        lines, lo = batch.column("line").to_pylist(), 0
        while lo < len(lines):
            hi, size = lo, 0
            while hi < len(lines) and size < CHUNK_BYTES:
                size += len(lines[hi])
                hi += 1
            t = _Lines(lines[lo:hi])
            use, h = t.wordy[t.line], t.word_hashes()
            line, g = t.gram_hashes(np.ones(hi - lo, bool), 4)
            sims = np.zeros((2 * len(MORE_SEEDS), hi - lo), np.uint64)
            for i, seed in enumerate(MORE_SEEDS):
                _simhash(t.line[use], _mix(h[use] + np.uint64(seed)), sims[i])
                _simhash(line, _mix(g + np.uint64(seed)), sims[len(MORE_SEEDS) + i])
            columns = [pa.array(x.view(np.int64), mask=~t.wordy if i < len(MORE_SEEDS) else None) for i, x in enumerate(sims)]
            part = batch.slice(lo, hi - lo)
            counted = [pa.array([x.tobytes() for x in t.letters()], pa.binary()), pa.array(t.chars.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("k"), part.column("line"), *columns, *counted], names=["key", "k", "line", *names, "kinds", "chars"])
            lo = hi


def letters_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most the edit distance, of rows of ``_Lines.letters``: an edit takes one character away, brings one, or both."""
    more = a.astype(np.int32) - b
    return np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))


def _by_letters(similarity: float):
    """Pairs (a, b) that their characters allow."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, KINDS) for c in ("kindsa", "kindsb"))
            chars = np.maximum(batch.column("charsa").to_numpy(), batch.column("charsb").to_numpy())
            good = letters_bound(a, b) <= np.floor(chars * (1 - similarity) + 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return of


def words_bound(a: str, b: str) -> int:
    """At least the edit distance: equal words are passed, others rewritten up to where two words in a row agree again."""
    x, y = a.split(" "), b.split(" ")
    i = j = bound = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i += 1
            j += 1
            continue
        for steps in range(1, 9):
            for p in range(steps + 1):
                if x[i + p : i + p + 2] == y[j + steps - p : j + steps - p + 2] != []:
                    break
            else:
                continue
            break
        else:
            break
        bound += max(len(" ".join(x[i : i + p])), len(" ".join(y[j : j + steps - p]))) + (p in (0, steps))
        i, j = i + p, j + steps - p
    return bound + max(len(" ".join(x[i:])), len(" ".join(y[j:]))) + ((i == len(x)) != (j == len(y)))


def _verified(similarity: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("la").to_pylist(), batch.column("lb").to_pylist()
            good = []
            for x, y in zip(left, right, strict=True):
                x, y = x.decode(), y.decode()
                good.append(words_bound(x, y) <= math.floor(max(len(x), len(y)) * (1 - similarity) + 1e-9) or edit_similar(x, y, similarity))
            yield batch.select(["a", "b", "ka", "kb"]).filter(pa.array(good, pa.bool_()))

    return of


def _near(s1: Column, s2: Column, similarity: float) -> Column:
    """Whether sketches of one kind allow a pair: SimHashes within ``WORD_BITS`` or ``GRAM_BITS`` bits, and lengths that may agree."""
    apart = s1.bitwiseXOR(s2).bitwiseAND(-256)
    steps = math.ceil(-math.log(similarity) / math.log(1.1))
    alike = F.bit_count(apart) <= F.when(s1.bitwiseAND(128) != 0, WORD_BITS).otherwise(GRAM_BITS)
    return alike & (F.abs(s1.bitwiseAND(127) - s2.bitwiseAND(127)) <= steps)


def similar_lines(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between keys of ``lines`` (key, k: a number made of the key, line; repeats allowed) that share a block, have near sketches and an edit similarity of ``similarity`` or more.

    An edited word or gram changes at most two groups of a line's features, so at most two of its blocks: lines that few
    edits part share a block for certain, by the pigeonhole principle, others if some block's features are left. Every
    member of a posting is first compared with the posting's smallest. In crowded postings members are then compared with
    ``NEIGHBOURS`` others in an order by hash, which connects near copies of each other, in turns as long as these halve
    the loose members: those outside the posting's largest part of connected ones. What is loose still is compared with all
    members, whatever the posting's size: in one of over ``PAIRED_POSTING`` of them they are dealt over lanes, each of which
    meets all members. Pairs that the links found so far connect are not compared. Texts are read for lines of near pairs
    only: a Bloom filter of bounded size drops most others where they are stored, an exact join the rest.
    """
    posted = lines.select("k", "line").mapInArrow(_posted, "slot long, k long, sketch long")
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    more = [f"{kind}{i}" for kind in "wg" for i in range(len(MORE_SEEDS))]

    def held_of(wanted: DataFrame) -> DataFrame:
        """Lines of the wanted k with what ``_longer_sketches`` adds."""
        # grouped by k alone, so that the join needs no other shuffle; a key has 16 bytes
        stored = sieve(lines.select("key", "k", "line"), F.col("k"), wanted).groupBy("k").agg(F.collect_set(F.concat("key", "line")).alias("texts"))
        # an inner join, since a semi-join would be moved before the filter
        held = stored.join(wanted, "k").select("k", F.explode("texts").alias("text"))
        held = held.select(F.expr("substring(text, 1, 16)").alias("key"), "k", F.expr("substring(text, 17)").alias("line"))
        longer = ", ".join(f"{name} long" for name in more)
        return written(held.select("key", "k", "line").mapInArrow(_longer_sketches, f"key binary, k long, line binary, {longer}, kinds binary, chars int"))

    def told_by(side: str) -> list[Column]:
        return [F.col(name).alias(f"{name}{side}") for name in (*more, "kinds", "chars")]

    def apart(kind: str) -> Column:
        return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{kind}{i}a").bitwiseXOR(F.col(f"{kind}{i}b"))) for i in range(len(MORE_SEEDS))])

    # over words if both lines have enough of them
    alike = F.coalesce(apart("w") <= MORE_WORD_BITS, apart("g") <= MORE_GRAM_BITS)

    def allowed(met: DataFrame) -> DataFrame:
        """Pairs that the longer SimHashes and the characters allow; what they are told by comes along in the rows of a join."""
        near = met.where(alike).select("a", "b", "kindsa", "kindsb", "charsa", "charsb")
        return cut(near.mapInArrow(_by_letters(similarity), "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def linked(near: DataFrame, held: DataFrame) -> DataFrame:
        left, right = (held.select(F.col("k").alias(name), F.col("key").alias(f"k{name}"), F.col("line").alias(f"l{name}")) for name in "ab")
        # few bytes, but much work a byte: the number of tasks is set, so that they are not merged
        both = near.join(left, "a").repartition(tasks, "b").join(right, "b").select("a", "b", "ka", "kb", "la", "lb")
        return cut(both.mapInArrow(_verified(similarity), "a long, b long, ka binary, kb binary"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.distinct())
        release(lines.sparkSession)
        held = held_of(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct())
        sides = [held.select(F.col("k").alias(name), *told_by(name)) for name in "ab"]
        return linked(allowed(pairs.join(sides[0], "a").join(sides[1], "b")), held)

    whole = Window.partitionBy("slot")
    least = F.min(F.struct("k", "sketch")).over(whole)
    dealt = posted.withColumns({"n": F.count(F.lit(1)).over(whole), "most": F.max("k").over(whole), "least": least}).where(F.col("least.k") < F.col("most"))
    open_ = F.col("k") != F.col("least.k")
    near_least = open_ & _near(F.col("sketch"), F.col("least.sketch"), similarity)
    dealt = dealt.where((F.col("n") > 2) | near_least).select("slot", "k", "sketch", "n", F.col("least.k").alias("r"), near_least.alias("near"))
    met = written(dealt.dropDuplicates(["slot", "k"]))
    release(lines.sparkSession)
    one = verified(met.where("near").select(F.col("k").alias("a"), F.col("r").alias("b")))
    parts = cut(components(one.select("a", "b")))
    release(lines.sparkSession)
    # members by posting; where all are of one component, nothing is left to compare
    members = met.where("n > 2").select("slot", "k", "sketch", (F.col("k") == F.col("r")).alias("first"))

    def parted(members: DataFrame, parts: DataFrame) -> DataFrame:
        """``members`` of postings of several parts with their part, whether it is not the posting's largest, and how many are so."""
        named = members.join(parts.select(F.col("node").alias("k"), "component"), "k", "left")
        named = named.select("slot", "k", "sketch", "first", F.coalesce("component", "k").alias("part")).repartition(tasks, "slot")
        sized = named.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("slot", "part")))
        told = sized.withColumns({"main": F.max(F.struct("size", "part")).over(whole), "least_part": F.min("part").over(whole), "most_part": F.max("part").over(whole)})
        told = told.where(F.col("least_part") < F.col("most_part")).withColumn("loose", ~F.col("first") & (F.col("part") != F.col("main.part")))
        return written(told.select("slot", "k", "sketch", "first", "part", "loose", F.count(F.when(F.col("loose"), 1)).over(whole).alias("n_loose")))

    told = parted(members, parts)
    release(lines.sparkSession)
    links, left, turn = one, None, 0
    while True:
        crowded = told.where(~F.col("first") & (F.col("n_loose") > CROWDED))
        last, left = left, crowded.where("loose").count()
        if left == 0 or last is not None and 2 * left > last:
            break
        order = Window.partitionBy("slot").orderBy(F.xxhash64("k", F.lit(turn)), "k")
        beside = [F.lag(F.struct("k", "sketch", "part"), i).over(order) for i in range(1, NEIGHBOURS + 1)]
        pairs = crowded.withColumn("beside", F.array(*beside)).select("k", "sketch", "part", F.explode("beside").alias("other"))
        pairs = pairs.where((F.col("part") != F.col("other.part")) & _near(F.col("sketch"), F.col("other.sketch"), similarity))
        found = verified(pairs.select(F.greatest("k", "other.k").alias("a"), F.least("k", "other.k").alias("b")))
        parts = cut(components(found.select("a", "b").unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))))
        links, turn = links.unionByName(found), turn + 1
        told = parted(told.select("slot", "k", "sketch", "first"), parts)
        release(lines.sparkSession)
    told = told.where(~F.col("first") & (F.col("n_loose") > 0)).withColumn("lanes", F.ceil(F.col("n_loose") / PAIRED_POSTING).cast("int"))
    # here pairs may be many more than lines, so that members bring what tells them apart
    held = held_of(told.select("k").distinct())
    signed = written(told.join(held.select("k", *more, "kinds", "chars"), "k"))
    mine = signed.where("loose").select("slot", F.pmod(F.xxhash64("k"), "lanes").cast("int").alias("lane"), F.col("k").alias("a"), "sketch", "part", *told_by("a"))
    every = signed.select("slot", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.col("k").alias("b"), F.col("sketch").alias("other"), F.col("part").alias("other_part"), *told_by("b"))
    second = mine.join(every, ["slot", "lane"]).where((F.col("part") != F.col("other_part")) & _near(F.col("sketch"), F.col("other"), similarity) & alike)
    links = links.unionByName(linked(allowed(second), held))
    release(lines.sparkSession)
    return links.select(F.col("ka").alias("a"), F.col("kb").alias("b"))


def _removed(occurrences: DataFrame, similarity: float) -> DataFrame:
    """(row, removed): for each row of ``occurrences`` that loses lines, their positions from 0."""
    met = occurrences.where("pos >= 0")
    where = F.struct(F.col("id").isNull().alias("void"), "id", "row", "pos")
    lines = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(where).alias("first"))
    parts = components(similar_lines(met.select("key", "k", "line"), similarity)).withColumnRenamed("node", "key")
    grouped = cut(lines.join(parts, "key", "left").where("n > 1 or component is not null").select("key", "first", F.coalesce("component", "key").alias("component")))
    keep = grouped.groupBy("component").agg(F.min("first").alias("keep"))
    decided = cut(grouped.join(keep, "component").select("key", F.col("keep.row").alias("keep_row"), F.col("keep.pos").alias("keep_pos")))
    lanes = met.select("row", "pos", "key", F.pmod(F.xxhash64("row"), F.lit(64)).alias("lane"))
    entries = lanes.select("key", "lane").distinct().join(decided, "key")
    gone = lanes.join(entries, ["key", "lane"]).where("row <> keep_row or pos <> keep_pos")
    return gone.groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("removed"))


def line_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_removed, removed (positions of removed lines, from 0).

    Lines are normalised (case, digits, punctuation); equal ones and those that ``similar_lines`` connects form groups,
    and of each group the occurrence of the smallest (identifier, row, position) stays. Every line that isn't blank
    counts, whatever its length or script.

    Null and empty texts have no lines; blank lines are never removed. Repeated rows: one of them keeps its lines, the
    others lose theirs to it. Null identifiers come last when choosing what stays. An empty table gives an empty result.
    Other columns are ignored.
    """
    occurrences = _occurrences(docs, id_col, text_col)
    gone = _removed(occurrences, similarity)
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    rows = occurrences.where("pos < 0").select("row", "id", "n_lines").join(gone, "row", "left")
    return rows.select(F.col("id").alias(id_col), F.col("n_lines").cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the lines that ``line_dedup_report`` removes; a row all of whose text was removed goes, one that
    lost nothing is as it was. Of rows that repeat identifier and text one stays. An
    empty table stays empty; columns of any name are kept.
    """
    occurrences = _occurrences(docs, id_col, text_col)
    gone = _removed(occurrences, similarity)
    rows = occurrences.where("pos < 0").select("row", "doc_key")
    # of rows with equal identifier and text one keeps its lines, the others lose them all
    by_key = rows.join(gone, "row", "left").groupBy("doc_key").agg(F.min_by("removed", F.struct(F.coalesce(F.size("removed"), F.lit(0)), "row")).alias("removed"))
    mine, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    keyed = docs.select(F.unhex(document_key(mine, text)).alias("doc_key"), packed(docs).alias("doc")).dropDuplicates(["doc_key"])
    whole = F.col("doc").getField(text_col)
    at = F.array_except(F.sequence(F.lit(0), F.size(F.split(whole, "\n")) - 1), "removed")
    kept = let(F.split(whole, "\n"), lambda x: F.array_join(F.transform(at, lambda i: F.get(x, i)), "\n"))
    lost = F.col("removed").isNotNull()
    out = keyed.join(by_key, "doc_key").select("doc", F.when(lost, kept).otherwise(whole).alias("left"), lost.alias("lost"))
    out = out.where(~F.col("lost") | (F.trim(F.translate("left", "\n\t\r", "")) != ""))
    return out.select(*[F.col("left").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns])
