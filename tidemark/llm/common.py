"""What the corpus operators share: cutting lineage, normalising text, connected components."""

from __future__ import annotations

import gc
import re
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after a count has shown that it has at most so many rows.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder now, so that lost executors cost no recomputation beyond it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table to the checkpoint folder now, and read again: smaller than a checkpoint, and read by columns."""
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of shuffles and checkpoints that no DataFrame refers to any more. Spark deletes them when the driver's garbage is
    collected, which a driver with memory to spare may not do before the disks of the executors are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Words of a Bloom filter, each of 64 bits; its size doesn't grow with the input.
FILTER_WORDS = 1 << 19


def sieve(df: DataFrame, number: Column, wanted: DataFrame, words: int | None = None) -> DataFrame:
    """``df`` without most of the rows whose evenly spread ``number`` is not in ``wanted`` (k), dropped where they are read.

    A Bloom filter of bounded size, so an exact join has to follow; the more numbers are wanted, the less it drops.
    """
    words = words or FILTER_WORDS
    bit = F.expr("shiftleft(1L, cast(k & 63 as int))")
    known = wanted.select(F.shiftrightunsigned(F.col("k").bitwiseAND(words * 64 - 1), 6).alias("__word"), bit.alias("m")).groupBy("__word").agg(F.bit_or("m").alias("__bits"))
    told = df.withColumn("__n", number).withColumn("__word", F.shiftrightunsigned(F.col("__n").bitwiseAND(words * 64 - 1), 6))
    kept = told.join(F.broadcast(known), "__word").where(F.expr("shiftleft(1L, cast(__n & 63 as int))").bitwiseAND(F.col("__bits")) != 0)
    return kept.drop("__word", "__n", "__bits")


def packed(df: DataFrame) -> Column:
    """The columns of ``df`` as one struct, so that no column made here can clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text without other letters than ASCII takes the quicker built-in."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def document_key(identifier: Column, text: Column) -> Column:
    """A key of identifier and text. Rows are told by it across scans, since positions in a scan may change when executors are lost."""
    name = F.when(identifier.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), identifier.cast("string")))
    return F.md5(F.concat(name, F.lit("\x00"), F.coalesce(text, F.lit(""))))


def bounded_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the counted ``rows`` allow it; otherwise leave the join to shuffle."""
    return F.broadcast(df) if rows <= limit else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row ``(node, component)`` per node, component the smallest node.

    Alternating large-star and small-star rounds over the edge list: every round is two aggregations and two joins on
    the edges, none gathers a component. A round's edges are checkpointed; the loop ends when a round changes nothing.
    """
    kind = edges.schema["a"].dataType
    now = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = cut(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
    members = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = members.select(F.col("component").alias("node"), "component").distinct()
    return members.unionByName(roots).select(F.col("node").cast(kind), F.col("component").cast(kind))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it in ``body``; plain columns used in a lambda could be inlined and evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def spread_join(rows: DataFrame, side: DataFrame, key: str, spread_by: str, lanes: int = 64) -> DataFrame:
    """Left join ``rows`` with ``side`` (one row per ``key``) where a few keys may hold a large part of ``rows``.

    Only distinct (key, lane) pairs meet ``side``; rows then meet the pairs, so that a hot key is spread over all lanes.
    ``rows`` is used twice and should be cheap to read again.
    """
    laned = rows.withColumn("__lane", F.pmod(F.xxhash64(spread_by), F.lit(lanes)).cast("int"))
    entries = laned.select(key, "__lane").distinct().join(side, key, "left")
    return laned.join(entries, [key, "__lane"], "left").drop("__lane")
