"""What needs the order of rows within a key, without a key's rows in one task: neighbours and exact quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import checkpoint_dir

#: Buckets into which a range of values is cut in one round, and how many values of a range are few enough to be sorted.
BUCKETS, FEW = 1024, 4096


def lag_in_order(df: DataFrame, by: list[str], order: list[str], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with the ``value`` of the row before in the ``order`` of its key ``by`` as ``name``; null for a key's first row.

    Rows are dealt into sorted ranges, so a key of any size is spread over them. Within a range the row before is found by
    a window; where a key goes on from an earlier range, that range's last value of it is carried over: at most one value
    for each range.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    checkpoint_dir(spark)
    # positions and edges have to be of one evaluation
    ranged = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("__pos", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__pos", 33)).checkpoint()
    within = Window.partitionBy("__range", *by).orderBy("__pos")
    found = ranged.withColumns({name: F.lag(value).over(within), "__first": F.row_number().over(within) == 1})
    edges = ranged.groupBy(*by, "__range").agg(F.max_by(F.struct(value), "__pos").alias("__edge"))
    carried = edges.withColumn("__edge", F.lag("__edge").over(Window.partitionBy(*by).orderBy("__range"))).where("__edge is not null")
    out = found.join(F.broadcast(carried), [*by, "__range"], "left")  # a row for each range at most
    return out.select(*df.columns, F.when(F.col("__first"), F.col(f"__edge.{value}")).otherwise(F.col(name)).alias(name))


def scan_in_order(df: DataFrame, by: list[str], order: list[str], fields: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` with each of ``fields`` replaced by its last value that isn't null up to the row, in the ``order`` of its key ``by``.

    A row is a change of state that sets some fields; changes compose to the last value of each. They are composed within
    sorted ranges by a window, and over ranges from one composed change a range and key, so a key of any size is spread.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    checkpoint_dir(spark)
    ranged = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("__pos", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__pos", 33)).checkpoint()
    so_far = Window.partitionBy("__range", *by).orderBy("__pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = ranged.withColumns({f: F.last(f, ignorenulls=True).over(so_far) for f in fields})
    edges = ranged.groupBy(*by, "__range").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("__pos"))).alias(f"__{f}") for f in fields])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(*by, "__range", F.row_number().over(Window.partitionBy(*by).orderBy("__range")).alias("__nth"), *[F.last(f"__{f}", ignorenulls=True).over(earlier).alias(f"__{f}") for f in fields])
    out = within.join(F.broadcast(carried.where("__nth > 1").drop("__nth")), [*by, "__range"], "left")  # a row for each range at most
    return out.select(*[F.coalesce(c, f"__{c}").alias(c) if c in fields else F.col(c) for c in df.columns])


def exact_quantiles(df: DataFrame, by: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """(by, q, value): exact quantiles of the values of each key, interpolated between neighbours; nulls don't count.

    The ranks that a quantile lies between are selected from all tasks at once: values in the range that holds a rank are
    counted in ``BUCKETS`` buckets, and the bucket that holds it becomes the range, until it has one value or a few
    (``FEW``), which are ranked. A round is one aggregation of counts; no key's values meet in one task.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)] or [F.lit(0).alias("__k0")]
    names = [f"__k{i}" for i in range(max(len(by), 1))]
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v")).checkpoint()
    ends = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    at = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q")
    placed = ends.select(*names, "n", "low", "high", at).withColumn("pos", F.col("q") * (F.col("n") - 1))
    asked = placed.select(*names, "q", "pos", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))).alias("rank"))
    wants = asked.select(*names, "rank").distinct().join(ends.withColumn("below", F.lit(0).cast("long")), names).checkpoint()

    def inside(wanted: DataFrame) -> DataFrame:
        small = F.broadcast(wanted) if not by else wanted  # without keys a few ranks
        return rows.join(small, names).where("v between low and high")

    open_ = (F.col("n") > FEW) & (F.col("low") < F.col("high"))
    while not wants.where(open_).isEmpty():
        bucket = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS), F.lit(BUCKETS - 1))
        counts = inside(wants.where(open_)).groupBy(*names, "rank", "below", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = Window.partitionBy(*names, "rank").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        narrowed = counts.withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(upto), F.lit(0))).where("rank >= below and rank < below + n")
        wants = narrowed.select(wants.columns).unionByName(wants.where(~open_)).checkpoint()
    single = wants.where("low = high").select(*names, "rank", F.col("low").alias("v"))
    few = inside(wants.where("low < high"))
    ranked = few.withColumn("i", F.col("below") + F.row_number().over(Window.partitionBy(*names, "rank").orderBy("v")) - 1).where("i = rank").select(*names, "rank", "v")
    values = single.unionByName(ranked)
    low, high = F.min("v"), F.max("v")
    share = F.first("pos") - F.floor(F.first("pos"))
    told = asked.join(values, [*names, "rank"]).groupBy(*names, "q").agg(((1 - share) * low + share * high).alias(value))
    return told.select(*[F.col(n).alias(c) for n, c in zip(names, by)], "q", value)
