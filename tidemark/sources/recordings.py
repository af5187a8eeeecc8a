"""Recorded timelines: a header line and events, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_SCHEMA = "type string, version int, repository string, since timestamp, until timestamp, started_at timestamp, synthesize_stacks boolean, seed long"
EVENT_SCHEMA = (
    "seq long, at_ms long, kind string, action string, repository string, previous_base string, pull_request struct<number:long,state:string,head_ref:string,head_sha:string,base_ref:string,base_sha:string>, "
    "review struct<id:string,state:string>, issue_comment struct<id:string>, review_thread struct<id:string,resolved:boolean>, review_comment struct<id:string>, check_suite struct<id:long,head_sha:string>, "
    "check_run struct<id:long,head_sha:string,status:string>, commit struct<sha:string>, push struct<ref:string,before:string,after:string>, stack struct<number:long>"
)


def read_recording(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The header row and the events of a recording."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    is_header = F.get_json_object("value", "$.type") == "recording"
    header = lines.where(is_header).select(F.from_json("value", HEADER_SCHEMA).alias("h")).select("h.*")
    events = lines.where(~F.coalesce(is_header, F.lit(False))).select(F.from_json("value", EVENT_SCHEMA).alias("e")).select("e.*")
    return header, events
