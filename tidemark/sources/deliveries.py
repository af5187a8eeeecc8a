"""The delivery log: source, payload decoding, envelope, dead letters, conformance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIVERY_SCHEMA = "delivery_guid string, event string, content_type string, body string, received_at timestamp, status string, attempts int, arrival long"

_PATHS = "struct<added:array<string>,modified:array<string>,removed:array<string>>"
ENVELOPE_SCHEMA = (
    "action string, number long, ref string, before string, after string, created boolean, deleted boolean, forced boolean, "
    f"repository struct<full_name:string,default_branch:string>, commits array<{_PATHS}>, head_commit {_PATHS}, "
    "pull_request struct<number:long,stack:struct<id:long,number:long,size:long,position:long,base:struct<ref:string,sha:string>>>, "
    "issue struct<number:long,pull_request:struct<url:string>>, stack struct<number:long>, check_run struct<head_sha:string>, check_suite struct<head_sha:string>"
)


def read_deliveries(spark: SparkSession, path: str, stream: bool = False, fmt: str = "parquet", schema: str = DELIVERY_SCHEMA) -> DataFrame:
    """The append-only delivery log as a batch or a stream of files."""
    return (spark.readStream if stream else spark.read).schema(schema).format(fmt).load(path)


def _once(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are costly to make: they come out of a generator of one row, so that each filter and field that reads them doesn't make them again."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in new.items()]))).alias("__made")
    return df.select(*[c for c in df.columns if c not in new], made).select(*[c for c in df.columns if c not in new], *[F.col(f"__made.{n}").alias(n) for n in new])


def decode_payload(df: DataFrame) -> DataFrame:
    """``df`` (content_type, body) with payload (JSON text of an object) or decode_error.

    JSON is taken as it is, also where the type is missing; a form holds it in exactly one field named payload.
    """
    kind = F.lower(F.trim(F.split(F.coalesce(F.col("content_type"), F.lit("")), ";")[0]))
    fields = F.filter(F.split(F.coalesce("body", F.lit("")), "&"), lambda f: f.startswith("payload="))
    form = kind == "application/x-www-form-urlencoded"
    raw = F.when(kind.isin("", "application/json"), F.col("body")).when(form & (F.size(fields) == 1), F.try_url_decode(F.substring(fields[0], 9, 1 << 30)))
    parsed = F.try_parse_json(raw)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    error = (
        F.when(~kind.isin("", "application/json", "application/x-www-form-urlencoded"), "unsupported content type")
        .when(form & (F.size(fields) != 1), "form needs exactly one payload field")
        .when(~is_object, "payload is not a JSON object")
    )
    return _once(df, {"payload": F.when(is_object, raw), "decode_error": error})


def project_envelope(df: DataFrame) -> DataFrame:
    """``df`` (payload) with the typed envelope as column p."""
    return _once(df, {"p": F.from_json("payload", ENVELOPE_SCHEMA)})


def split_poison(df: DataFrame, error: str = "decode_error") -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error."""
    return df.where(F.col(error).isNull()), df.where(F.col(error).isNotNull())


def conformance_report(df: DataFrame, field_rules: DataFrame) -> DataFrame:
    """Violations per event, action and field. ``df``: event, action, payload. ``field_rules``: event, action ('*' any), path, type, required, nullable, allowed (array or null).

    The rules are a small table, broadcast; each payload is read once per rule that applies to it.
    """
    rules = F.broadcast(field_rules.select(*[F.col(c).alias(f"r_{c}") for c in ("event", "action", "path", "type", "required", "nullable", "allowed")]))
    met = df.join(rules, (F.col("event") == F.col("r_event")) & ((F.col("r_action") == "*") | (F.col("r_action") == F.col("action"))))
    text = F.try_variant_get(F.try_parse_json("payload"), F.col("r_path"), "string")
    kind = F.lower(F.schema_of_variant(F.try_variant_get(F.try_parse_json("payload"), F.col("r_path"), "variant")))
    family = F.when(kind == "bigint", "integer").when(kind.startswith("object"), "object").when(kind.startswith("array"), "array").when(kind == "void", "null").otherwise(kind)
    missing, void = kind.isNull(), family == "null"
    problem = (
        F.when(missing & F.col("r_required"), "missing")
        .when(void & ~F.col("r_nullable"), "null")
        .when(~missing & ~void & (family != F.col("r_type")), "type")
        .when(~missing & ~void & F.col("r_allowed").isNotNull() & ~F.array_contains("r_allowed", text), "enum")
    )
    return (
        met.withColumn("problem", problem)
        .groupBy("event", "action", F.col("r_path").alias("path"))
        .agg(F.count(F.lit(1)).alias("checked"), *[F.count_if(F.col("problem") == p).alias(f"bad_{p}") for p in ("missing", "null", "type", "enum")])
    )
