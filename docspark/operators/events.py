"""Event messages: decoding, encoding, dead letters, audit rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = "event_type string, doc_id string, vault_id string, file_type string, storage_path string, original_filename string, uploaded_by string, deleted_by string, timestamp timestamp"
NEEDED = {"file.uploaded": ("doc_id", "vault_id", "file_type", "storage_path", "original_filename", "uploaded_by", "timestamp"), "file.deleted": ("doc_id", "vault_id", "deleted_by", "timestamp")}


def decode(raw: DataFrame) -> DataFrame:
    """raw (value) with event (the union of both kinds' fields) and `malformed`: no JSON, another type or a field that's missing."""
    event = F.col("_event")
    whole = lambda k: reduce(lambda a, b: a & b, [event[c].isNotNull() for c in NEEDED[k]])
    good = F.when(event["event_type"] == "file.uploaded", whole("file.uploaded")).when(event["event_type"] == "file.deleted", whole("file.deleted")).otherwise(False)
    parsed = raw.withColumn("_event", F.from_json("value", FIELDS))
    return parsed.select(*[F.col(c) for c in raw.columns], "_event.*", (~F.coalesce(good, F.lit(False))).alias("malformed"))


def encode(rows: DataFrame, columns: list[str], key: str = "vault_id") -> DataFrame:
    """(key, value): rows of one vault keep their order on a keyed topic."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*columns)).alias("value"))


def dead_letters(raw: DataFrame, topic: str, error: Column, kind: Column, at: Column) -> DataFrame:
    envelope = F.struct(F.lit(topic).alias("original_topic"), F.col("value").alias("original_event"), F.substring(error, 1, 500).alias("error_message"), kind.alias("error_type"), F.lit(0).alias("retry_count"), at.alias("failed_at"))
    return raw.select(F.to_json(envelope).alias("value"))


def audit_rows(events: DataFrame) -> DataFrame:
    """events (event_type, vault_id, doc_id, payload map) as rows of the audit log; an empty payload is null."""
    return events.select("event_type", "vault_id", "doc_id", F.when(F.size("payload") > 0, F.to_json("payload")).alias("payload"))
