"""Sweeps, gaps and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reads import live


def stale(df: DataFrame, cutoff: str, now: str | None = None, displayed: bool = False, checked: str = "last_checked_at") -> DataFrame:
    """Live rows last checked before the cutoff, oldest first: open ones, or closed ones that are still displayed."""
    out = live(df).where(F.coalesce(F.col(checked), F.lit("0001-01-01").cast("timestamp_ntz")) < F.lit(cutoff).cast("timestamp_ntz"))
    if "state" in df.columns:
        out = out.where((F.col("state") != "open") & (F.col("display_until") > F.lit(now).cast("timestamp_ntz"))) if displayed else out.where("state = 'open'")
    return out.orderBy(checked)


def schedule_plan(df: DataFrame) -> DataFrame:
    """Per staleness bound (bound_s, now): cadence three quarters, headroom a fifth, and the time before which a check is due."""
    b = F.col("bound_s")
    return df.withColumns({"cadence_s": b * 3 / 4, "headroom_s": b / 5, "due_before_us": F.unix_micros(F.col("now").cast("timestamp")) - F.floor(b * 3 / 4 * 1_000_000)})


def spread(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Refreshes spread evenly: the i-th of n at now + cadence * i / (n - 1), between now and deadline less headroom. df: now_us, cadence_us, deadline_us, headroom_us."""
    w = Window.partitionBy(*group)
    i, n = F.row_number().over(w.orderBy(*order)) - 1, F.count(F.lit(1)).over(w)
    at = F.col("now_us") + F.when(n > 1, F.floor(F.col("cadence_us") * i / (n - 1))).otherwise(0)
    return df.withColumn("at_us", F.greatest("now_us", F.least(at, F.col("deadline_us") - F.col("headroom_us"))))


def missing_keys(cached: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    """Live cached keys that a complete listing didn't show."""
    return live(cached).select(*on).join(seen, on, "left_anti")


def accumulate_seen(seen: DataFrame, page: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The seen keys with a page's, and the new ones among them."""
    new = page.select(*on).distinct().join(seen, on, "left_anti")
    return seen.select(*on).unionByName(new), new


def reap_scopes(cursors: DataFrame, repos: DataFrame) -> DataFrame:
    """Cursors whose repository is no longer live."""
    return cursors.join(live(repos).select(F.col("full_name").alias("scope")), "scope", "left_anti")


def delivery_gaps(listed: DataFrame, log: DataFrame, cutoff: str) -> DataFrame:
    """Identifiers that the sender lists since the cutoff and the log lacks."""
    recent = listed.where((F.coalesce("delivery_guid", F.lit("")) != "") & (F.col("delivered_at") >= F.lit(cutoff).cast("timestamp_ntz")))
    return recent.select("delivery_guid").distinct().join(log.select("delivery_guid"), "delivery_guid", "left_anti")


def gap_pass_extent(pages: DataFrame, boundary_id: int | None, cutoff: str) -> DataFrame:
    """How far a pass over listing pages (page, delivery_id, delivered_at; newest first) goes: an incremental one to the page that holds the boundary, else to the first page wholly older than the cutoff; and the newest time."""
    old = F.col("delivered_at") < F.lit(cutoff).cast("timestamp_ntz")
    per = pages.groupBy("page").agg(F.min(old).alias("all_old"), F.max("delivered_at").alias("newest"), F.max(F.col("delivery_id") == F.lit(boundary_id)).alias("boundary") if boundary_id is not None else F.lit(False).alias("boundary"))
    stop = per.agg(F.min(F.when(F.col("boundary"), F.col("page"))).alias("boundary_page"), F.min(F.when(F.col("all_old"), F.col("page"))).alias("deep_page"), F.max("page").alias("last_page"), F.max("newest").alias("high_watermark"))
    return stop.withColumn("stop_page", F.coalesce("boundary_page", "deep_page", "last_page"))


def orphans(generations: DataFrame, jobs: DataFrame, cutoff: str) -> DataFrame:
    """Outstanding generations older than the cutoff without a live job, with the state in which the last job ended."""
    late = generations.where((F.col("completed_generation") < F.col("generation")) & (F.col("updated_at") < F.lit(cutoff).cast("timestamp_ntz")))
    running = jobs.where(F.col("state").isin("available", "scheduled", "running", "retryable", "pending"))
    last = jobs.groupBy("kind", "refresh_key").agg(F.max_by("state", "job_id").alias("last_state"))
    return late.join(running, ["kind", "refresh_key"], "left_anti").join(last, ["kind", "refresh_key"], "left")


def backfill_status(children: DataFrame) -> DataFrame:
    """Per repository: pending children, and whether it is settled. A child is done once its generation completed. children: repo_id, child_key, generation, completed_generation."""
    pending = F.coalesce(F.col("completed_generation") < F.col("generation"), F.lit(True))
    return children.groupBy("repo_id").agg(F.count(F.lit(1)).alias("children"), F.count_if(pending).alias("pending"), F.bool_and(~pending).alias("settled"))


def prune_payloads(df: DataFrame, cutoff: str, now: str) -> DataFrame:
    """Bodies of processed deliveries older than the cutoff go; the identifiers stay."""
    old = (F.col("status") == "processed") & (F.col("received_at") < F.lit(cutoff).cast("timestamp_ntz")) & F.col("payload_pruned_at").isNull()
    return df.withColumns({"body": F.when(~old, F.col("body")), "payload_pruned_at": F.when(old, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("payload_pruned_at"))})


def prune_rows(df: DataFrame, col: str, cutoff: str) -> DataFrame:
    """Rows whose time is null or not before the cutoff."""
    return df.where(F.col(col).isNull() | (F.col(col) >= F.lit(cutoff).cast("timestamp_ntz")))
