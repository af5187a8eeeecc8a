"""SimHash near-duplicates: a byte-position inverted index with count filtering."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, components, cut, document_key, let, packed, spread_join

WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Members of a posting up to which its pairs are listed; beyond it links come from one-bit neighbours.
PAIRED_POSTING = 64


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def shingle_hashes(text: Column, words: int) -> Column:
    """XXH64 (seed 42) of every run of ``words`` words; of the whole sequence if it is shorter; none if it is empty."""

    def hashes(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(1), n - (words - 1)), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(w, i, F.lit(words)))))
        return F.when(n >= words, runs).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", w))))

    return let(F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WHITE_SPACE), ""), hashes)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """(row, id, fp) per row of ``docs``: a bit is 1 if set in over half of the shingle hashes, repeats included.

    Two counters share a 64-bit sum, so that 32 sums count all 64 bits of a document without a row per bit.
    """
    hashed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), shingle_hashes(F.col(f"`{text_col}`"), words).alias("hs"))
    shingles = hashed.select("row", "id", F.explode_outer("hs").alias("h"))
    pair = F.lit((1 << 32) | 1)
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(pair)).alias(f"s{i}") for i in range(32)]
    counted = shingles.groupBy("row", "id").agg(F.count("h").alias("n"), *sums)
    half = F.col("n")
    low = [F.when(F.col(f"s{i}").bitwiseAND(0xFFFFFFFF) * 2 > half, F.lit(_signed(1 << i))).otherwise(F.lit(0).cast("long")) for i in range(32)]
    high = [F.when(F.shiftrightunsigned(f"s{i}", 32) * 2 > half, F.lit(_signed(1 << (i + 32)))).otherwise(F.lit(0).cast("long")) for i in range(32)]
    return counted.select("row", "id", F.when(half > 0, reduce(Column.bitwiseOR, low + high)).otherwise(F.lit(0).cast("long")).alias("fp"))


def hamming_links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Links (a, b) that connect exactly what pairs of distinct fingerprints (column fp) at ``bits`` or fewer differing bits connect.

    The inverted index posts each fingerprint under bytes with their positions, four bytes a posting: its four 16-bit
    words, two at a time. Differing bits spoil at most ``bits`` bytes and as many words, so a linked pair shares at least
    two words and meets in a posting, and it shares at least ``8 - bits`` positional bytes. Pairs that met share four
    bytes for certain; their shared positional bytes are tallied, pairs below the guaranteed minimum go, and the differing
    bits verify the rest.

    A posting holds distinct fingerprints that agree in 32 bits. In one of over ``PAIRED_POSTING`` members pairs are not
    listed: members are linked through the values that differ from them in one of the free bits. With 2 bits all that
    share such a value are within 2 bits of each other; with 1 bit one of the two is the value itself.
    """
    if bits not in (1, 2):
        raise ValueError("bits is 1 or 2")
    masks = [_signed(sum(0xFFFF << (16 * w) for w in kept)) for kept in combinations(range(4), 2)]
    posted = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")).withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
    postings = cut(posted.groupBy("mask", "part").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1))
    listed = (
        postings.where(F.size("members") <= PAIRED_POSTING)
        .select("members", F.posexplode("members").alias("i", "a"))
        .select("a", F.explode(F.slice("members", F.col("i") + 2, F.size("members"))).alias("b"))
    )
    met = listed.select("a", "b", shared_bytes(F.col("a"), F.col("b")).alias("tally")).where(F.col("tally") >= 8 - bits)
    pairs = met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    free = F.filter(flips, lambda f: f.bitwiseAND(F.col("mask")) == 0)
    near = (
        postings.where(F.size("members") > PAIRED_POSTING)
        .select("mask", F.explode("members").alias("a"))
        .select("a", F.explode(free).alias("f"))
        .select("a", F.col("a").bitwiseXOR(F.col("f")).alias("via"))
        .distinct()
    )
    if bits == 1:
        through = near.where("a <> via").join(near.where("a = via").select("via", F.col("a").alias("b")), "via").select("a", "b")
    else:
        through = near.join(near.groupBy("via").agg(F.min("a").alias("b")), "via").where("a <> b").select("a", "b")
    return pairs.unionByName(through.distinct())


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the 8 positional bytes agree."""
    apart = a.bitwiseXOR(b)
    return reduce(lambda x, y: x + y, [(apart.bitwiseAND(_signed(0xFF << (8 * p))) == 0).cast("int") for p in range(8)])


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest identifier reachable).

    Documents link if their fingerprints differ in ``bits`` or fewer bits; exact copies meet as one fingerprint and are
    never paired. Empty and null texts have fingerprint zero and link like any other. Null identifiers count only where
    a component has no other. Repeated rows give one result each. An empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words))
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("low")))
    parts = components(hamming_links(fps.select("fp"), bits))
    rooted = fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    side = rooted.join(lowest, "root").select("fp", "component_id")
    return spread_join(rows, side, "fp", "row").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group of ``simhash_groups``: that of the smallest identifier; of rows that repeat identifier and text one stays."""
    mine, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    keyed = docs.select(mine.alias("id"), text.alias("text"), document_key(mine, text).alias("key"), packed(docs).alias("doc"))
    ids = F.struct(F.col("id").isNull().alias("void"), "id", "key")
    groups = simhash_groups(keyed.select(ids.alias("id"), "text"), "id", "text", words, bits)
    kept = groups.select(F.col("component_id.key").alias("key")).distinct()
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")
