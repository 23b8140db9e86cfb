"""File events as a stream: micro-batches into tables, malformed events into dead letters, repeats ignored.

Any streaming source with a `value` column will do: a message topic, or JSON text files. Every table is written under a
folder named by the batch's number, so a batch that runs twice writes the same place twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspark.operators import events as E


#: How long the stream remembers what has arrived.
REPEATS = "1 day"


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 20) -> DataFrame:
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)


def topic_stream(spark: SparkSession, servers: str, topic: str, most: int = 20) -> DataFrame:
    """A message topic from its beginning; needs the connector on the class path."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return stream.option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", most).load().selectExpr("cast(value as string) AS value")


def decoded(raw: DataFrame, late: str = "1 day") -> DataFrame:
    """Well-formed events, each (doc_id, event_type) once within `late`."""
    good = E.decode(raw).where("not malformed").withWatermark("timestamp", late)
    return good.dropDuplicatesWithinWatermark(["doc_id", "event_type"])


def latest(events: DataFrame) -> DataFrame:
    """The last event of each document: an upload followed by its delete is a delete."""
    fields = [c for c in events.columns if c != "doc_id"]
    order = F.struct("timestamp", (F.col("event_type") == "file.deleted").alias("deleted"))
    return events.groupBy("doc_id").agg(F.max_by(F.struct(*fields), order).alias("e")).select("doc_id", "e.*")


def run(raw: DataFrame, folder: str, handle: Callable[[DataFrame], DataFrame] = latest, as_of: str | None = None, once: bool = True) -> StreamingQuery:
    """Start the stream: folder/events has handle()'s rows, folder/dead_letters and folder/audit what their names say.

    An event, or a malformed message, that comes again within REPEATS of its first arrival is passed over, in whatever batch.
    """
    now = F.expr(f"TIMESTAMP '{as_of}'") if as_of else F.current_timestamp()

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        try:
            good, bad = rows.where("not malformed"), rows.where("malformed")
            handle(good.drop("malformed", "value")).write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
            E.dead_letters(bad, "file.events", F.lit("not a file event"), F.lit("ValidationError"), now).write.mode("overwrite").text(f"{folder}/dead_letters/batch={number}")
            audit = good.select("event_type", "vault_id", "doc_id", F.create_map(F.lit("name"), F.coalesce("original_filename", F.lit(""))).alias("payload"))
            E.audit_rows(audit).write.mode("overwrite").parquet(f"{folder}/audit/batch={number}")
        finally:
            rows.unpersist()

    arrived = E.decode(raw).withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", REPEATS)
    arrived = arrived.withColumn("_letter", F.when(F.col("malformed"), F.sha2("value", 256)))
    once_each = arrived.dropDuplicatesWithinWatermark(["doc_id", "event_type", "_letter"]).drop("_arrived", "_letter")
    writer = once_each.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def flush_segments(segments: DataFrame, folder: str, once: bool = True) -> StreamingQuery:
    """Segments into folder, one row of each (session_id, segment_index) a batch; a batch that runs again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.dropDuplicates(["session_id", "segment_index"]).write.mode("overwrite").parquet(f"{folder}/segments/batch={number}")

    writer = segments.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()
