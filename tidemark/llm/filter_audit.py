"""How the filters of a corpus interact: what each removes in every order in which they may be applied."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

#: Filters by letter; bit i of a mask is set if a document fails filter i.
FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
WHITE_SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column, min_words: int = 200, min_distinct: int = 50, max_upper: int = 3) -> Column:
    """The bits of filters A to D, each a function of the text alone, which must not be null.

    A: under ``min_words`` words; B: under ``min_distinct`` percent of the words are distinct; C: over ``max_upper``
    percent of the code points are A-Z; D: it holds one of ``#$%&*|``.
    """

    def bit(at: int, fails: Column) -> Column:
        return F.when(fails, F.lit(1 << at)).otherwise(F.lit(0))

    def of_words(w: Column) -> Column:
        return bit(0, F.size(w) < min_words).bitwiseOR(bit(1, F.size(F.array_distinct(w)) * 100 < F.size(w) * min_distinct))

    upper = F.octet_length(text) - F.octet_length(F.translate(text, _UPPER, ""))
    of_chars = bit(2, upper * 100 > F.length(text) * max_upper).bitwiseOR(bit(3, text.rlike(r"[#$%&*|]")))
    return let(F.array_remove(F.split(text, WHITE_SPACE), ""), of_words).bitwiseOR(of_chars)


def failure_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Document counts (part, mask, n, good, toxic) per part and set of failed filters, all filters evaluated on every document.

    Filter E needs the table: a text fails it if a smaller identifier has the same text. Rows are read once and shuffled
    as digests. Copies are first counted per identifier, then combined where they are read into one entry per text, part
    and label with its smallest identifier and that one's rows, so a text that a third of all rows hold is some entries.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        text_failures(text).alias("mask"),
    )
    flags = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    told = rows.join(flags, "id", "left").select("id", "part", "sha", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    entry = ["sha", "part", "mask", "good", "toxic"]
    counted = told.groupBy("id", *entry).agg(F.count(F.lit(1)).alias("c"))
    # a row without an identifier has no order: it neither fails E nor makes others fail
    named = F.when(F.col("id").isNotNull(), F.struct("id", "c"))
    entries = cut(counted.groupBy(*entry).agg(F.sum("c").alias("n"), F.min(named).alias("low"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("c"))), F.lit(0)).alias("nameless")))
    lowest = entries.groupBy("sha").agg(F.min("low.id").alias("first"))
    first_rows = F.col("nameless") + F.when(F.col("low.id") == F.col("first"), F.col("low.c")).otherwise(F.lit(0))
    split = entries.join(lowest, "sha").select("part", "mask", "good", "toxic", F.explode(F.array(F.struct(F.lit(0).alias("e"), first_rows.alias("n")), F.struct(F.lit(1 << 4).alias("e"), (F.col("n") - first_rows).alias("n")))).alias("s"))
    return (
        split.where("s.n > 0")
        .groupBy("part", F.col("mask").bitwiseOR(F.col("s.e")).alias("mask"))
        .agg(F.sum("s.n").alias("n"), F.sum(F.col("s.n") * F.col("good")).alias("good"), F.sum(F.col("s.n") * F.col("toxic")).alias("toxic"))
    )


def gray_walk(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of active filters: ``cells`` and the result are (parts, 2 ** filters, counts).

    Subsets are visited in the order of the reflected Gray code, so each step toggles one filter. Every mask cell keeps
    a counter of its active failures; a cell whose counter leaves zero leaves the running survivors, one whose counter
    comes back to zero returns.
    """
    masks = np.arange(cells.shape[1])
    failing, alive, active = np.zeros(len(masks), dtype=np.int64), cells.sum(axis=1), 0
    states = np.empty_like(cells)
    states[:, 0] = alive
    for step in range(1, len(masks)):
        toggled = step & -step
        touched = (masks & toggled) > 0
        active ^= toggled
        if active & toggled:
            alive = alive - cells[:, touched & (failing == 0)].sum(axis=1)
            failing[touched] += 1
        else:
            failing[touched] -= 1
            alive = alive + cells[:, touched & (failing == 0)].sum(axis=1)
        states[:, active] = alive
    return states


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, states) from (part, cells), both arrays of ``SUBSETS`` times 3 counts."""
    for batch in batches:
        cells = np.array(batch.column("cells").to_pylist(), dtype=np.int64).reshape(-1, SUBSETS, 3)
        states = pa.array(gray_walk(cells).reshape(len(cells), -1).tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("part"), states], ["part", "states"])


def _steps() -> list[tuple]:
    """(filter_order, step, filter, subset of filters before it) of each order's steps."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            out.append((name, step, f, before))
            before |= 1 << f
    return out


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: what is kept and removed there, and how that overlaps with the others.

    ``kept`` is left after the step and ``removed`` goes there; ``redundant`` fails the step's filter but went before;
    ``unique_fails`` fails this filter alone; ``good_lost`` and ``toxic_lost`` are removed documents of these labels;
    ``shapley`` is what the filter removes, summed over all orders. Documents are counted once into cells of failed
    filters; the ``2 ** 5`` states of survivors follow from a Gray-code walk over them (``gray_walk``), and every column is
    a difference of states.

    Null and empty texts are equal and have no words. Null and empty values of ``part_col`` are one part. Rows without
    identifier are counted, have no labels and never fail E; rows that repeat an identifier and its text don't fail E
    through each other. A document with several label rows has a label if one of them does. An empty table gives an empty
    result. Other columns are ignored.
    """
    cells = failure_cells(docs, labels, id_col, text_col, part_col)
    sums = F.expr("array(" + ", ".join(f"coalesce(sum(case when mask = {m} then {c} end), 0L)" for m in range(SUBSETS) for c in ("n", "good", "toxic")) + ")")
    walked = cells.groupBy("part").agg(sums.alias("cells")).mapInArrow(_states, "part string, states array<long>")
    steps = F.expr("array(" + ", ".join(f"named_struct('filter_order', '{name}', 'step', {step}, 'bit', {1 << f}, 'before', {before})" for name, step, f, before in _steps()) + ")")

    def state(subset, count: int = 0) -> Column:
        return F.element_at("states", subset * 3 + (count + 1))

    none, every = F.lit(0), F.lit(SUBSETS - 1)
    bit, before = F.col("s.bit"), F.col("s.before")
    after = before.bitwiseOR(bit)
    removed = state(before) - state(after)
    # orders in which exactly the filters of a subset come before one more filter, by the subset's size
    orders = F.array(*[F.lit(math.factorial(k) * math.factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))])

    def in_all_orders(total: Column, subset: Column) -> Column:
        gone = (state(subset) - state(subset.bitwiseOR(bit))) * F.element_at(orders, F.bit_count(subset) + 1)
        return total + F.when(subset.bitwiseAND(bit) == 0, gone).otherwise(F.lit(0))

    return walked.select("part", "states", F.explode(steps).alias("s")).select(
        "part",
        "s.filter_order",
        "s.step",
        state(after).alias("kept"),
        removed.alias("removed"),
        (state(none) - state(bit) - removed).alias("redundant"),
        (state(every.bitwiseXOR(bit)) - state(every)).alias("unique_fails"),
        (state(before, 1) - state(after, 1)).alias("good_lost"),
        (state(before, 2) - state(after, 2)).alias("toxic_lost"),
        F.aggregate(F.sequence(none, F.lit(SUBSETS - 2)), F.lit(0).cast("long"), in_all_orders).alias("shapley"),
    )
