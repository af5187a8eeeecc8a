"""Exact deduplication by a tree of merges over digest runs, with DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

RUN = ("sha", "n_bytes", "check")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", lanes_log2: int = 6, fan_in_log2: int = 1) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. ``keep`` names which identifier of a
    group stays, "smallest" or "largest".

    Every row belongs to one of ``2 ** lanes_log2`` lanes by the hash of its identifier. A lane's run holds one entry per
    digest with the row to keep and a count. In each round the lanes that differ in the next ``fan_in_log2`` bits, pairs
    by default, exchange parts of their runs: an entry moves to the lane that has these bits of its digest, and what meets
    there is merged (recursive halving on a binomial tree). Spark sorts the runs by lane and digest and merges what comes
    from many tasks. After the last round each lane holds its share of the digests, merged over all lanes. Entries merge only if SHA-256, byte length and a second hash all agree, so each level verifies its
    merges. Decisions travel back to the (lane, digest) entries of the first level and from there to the rows: a digest
    that a third of all rows share is spread over all lanes in both directions.

    Nulls: a null identifier never stays unless its whole group has none. Repeated rows: of rows with equal identifier and
    text one is kept. An empty table gives an empty result. Other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    mine = F.col(f"`{id_col}`")
    norm = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = cut(
        docs.select(mine.alias("id"), F.monotonically_increasing_id().alias("row"), norm.alias("norm")).select(
            "id",
            "row",
            F.pmod(F.xxhash64("id"), F.lit(1 << lanes_log2)).cast("int").alias("lane"),
            F.sha2("norm", 256).alias("sha"),
            F.octet_length("norm").alias("n_bytes"),
            F.xxhash64("norm").alias("check"),
        )
    )
    last = F.col("id").isNull() if keep == "smallest" else F.col("id").isNotNull()
    first = rows.groupBy("lane", *RUN).agg(best(F.struct(last.alias("last"), "id", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
    digest_bits = F.conv(F.substring("sha", 1, 8), 16, 10).cast("long")

    def exchange(runs: DataFrame, low: int) -> DataFrame:
        mask = ((1 << min(fan_in_log2, lanes_log2 - low)) - 1) << low
        lane = F.col("lane").bitwiseAND(~mask & 0x7FFFFFFF).bitwiseOR(digest_bits.bitwiseAND(mask).cast("int"))
        return runs.withColumn("lane", lane).groupBy("lane", *RUN).agg(best("keep").alias("keep"), F.sum("n").alias("n"))

    merged = reduce(exchange, range(0, lanes_log2, fan_in_log2), first)
    back = first.select("lane", *RUN).join(merged.drop("lane").withColumnRenamed("n", "group_size"), list(RUN))
    return rows.join(back, ["lane", *RUN]).select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
