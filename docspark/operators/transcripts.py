"""Operators on transcript words, segments, claims and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.sources.shared import written

LEAST_CONFIDENCE, LEAST_WORDS, CONTEXT, BUFFER = 0.5, 3, 10, 100


def filter_segments(segments: DataFrame) -> DataFrame:
    """Confident segments of three words or more, or with an id, an amount or a business word."""
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    return segments.where((F.col("confidence") >= LEAST_CONFIDENCE) & ((words >= LEAST_WORDS) | T.entity_anchor(F.col("text"))))


def islands(rows: DataFrame, by: list[str], order: list, breaks: Column) -> DataFrame:
    """rows with `island`, which counts up within `by` wherever `breaks` (over the window of the row before) holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_break", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn("island", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def words_to_segments(words: DataFrame) -> DataFrame:
    """(session_id, island, speaker, text, start_s, end_s, confidence, n_words) of runs of one speaker."""
    w = Window.partitionBy("session_id").orderBy("position")
    runs = islands(words, ["session_id"], ["position"], F.lag("speaker").over(w) != F.col("speaker"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "word"))), lambda x: x["word"]), " ")
    return runs.groupBy("session_id", "island", "speaker").agg(said.alias("text"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_words"))


def transcript_blocks(segments: DataFrame, gap: float = 5.0) -> DataFrame:
    """segments with `block`: it goes on while the speaker stays and at most `gap` seconds pass."""
    w = Window.partitionBy("session_id").orderBy("segment_index")
    breaks = (F.lag("speaker").over(w) != F.col("speaker")) | (F.round(F.col("start_s") - F.lag("end_s").over(w), 6) > gap)
    return islands(segments, ["session_id"], ["segment_index"], breaks).withColumnRenamed("island", "block")


def majority_speaker(words: DataFrame, by: list[str]) -> DataFrame:
    """The speaker with most words, the first heard on ties."""
    counts = words.groupBy(*by, "speaker").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    return counts.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first"))).where("_n = 1").select(*by, "speaker")


def result_to_segment(words: DataFrame, by: list[str], channel: Column) -> DataFrame:
    """One segment of each result's words: majority speaker, first and last time, mean confidence; results without text have none."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "word"))), lambda x: x["word"]), " ")
    rows = words.withColumn("_channel", channel).groupBy(*by).agg(said.alias("text"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.avg("confidence").alias("confidence"), F.min("_channel").alias("_channel"))
    return rows.where(F.trim("text") != "").join(majority_speaker(words, by), by).withColumn("speaker", T.remap_speaker(F.col("_channel"), F.col("speaker"))).drop("_channel")


def collapse_interim(messages: DataFrame) -> DataFrame:
    """Final messages, and a session's last one if it is interim: each message replaces an interim one before it."""
    last = F.lead("segment_index").over(Window.partitionBy("session_id").orderBy("segment_index")).isNull()
    return messages.withColumn("_last", last).where(F.col("is_final") | F.col("_last")).drop("_last")


def rolling_buffer(segments: DataFrame, most: int = BUFFER) -> DataFrame:
    """The last `most` final segments of each session, with their place in the buffer."""
    final = segments.where("is_final")
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("segment_index")))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("segment_index")) - 1
    return final.withColumn("_back", back).where(F.col("_back") <= most).withColumn("place", place).drop("_back")


def claim_context(segments: DataFrame, n: int = CONTEXT) -> DataFrame:
    """segments with `context`: the texts of up to n segments before."""
    w = Window.partitionBy("session_id").orderBy("segment_index").rowsBetween(-n, -1)
    return segments.withColumn("context", F.array_join(F.collect_list("text").over(w), "\n"))


KINDS = ("reference_numbers", "numeric_ids", "amounts")


def entity_mentions(segments: DataFrame) -> DataFrame:
    """(session_id, kind, value, segment_index) of the first mention of each value in its session: it holds from that segment on."""
    m = T.extract_mentions(F.col("text"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), m[k].alias("values")) for k in KINDS])
    each = segments.select("session_id", "segment_index", F.explode(kinds).alias("_k")).select("session_id", "segment_index", "_k.kind", F.explode("_k.values").alias("value"))
    return each.groupBy("session_id", "kind", "value").agg(F.min("segment_index").alias("segment_index"))


def entity_summary(segments: DataFrame) -> DataFrame:
    """segments with what the session has named so far: reference_numbers, numeric_ids and amounts, ascending.

    Only first mentions are gathered, once a session; a segment takes those that its place has come to.
    """
    own = {k: f"_{k}" for k in KINDS}
    pairs = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("value", "segment_index"))))
    named = entity_mentions(segments).groupBy(F.col("session_id").alias("_session")).agg(*[pairs(k).alias(c) for k, c in own.items()])
    joined = segments.join(named, segments["session_id"].eqNullSafe(F.col("_session")), "left")
    so_far = lambda c: F.transform(F.filter(c, lambda x: x["segment_index"] <= F.col("segment_index")), lambda x: x["value"])
    return joined.withColumns({k: F.coalesce(so_far(c), F.array().cast("array<string>")) for k, c in own.items()}).drop("_session", *own.values())


def session_stats(segments: DataFrame, claims: DataFrame) -> DataFrame:
    s = segments.groupBy("session_id").agg(F.count("*").alias("segment_count"), F.count_distinct("speaker").alias("speaker_count"), (F.floor(F.round((F.max("end_s") - F.min("start_s")) * 1000) / 10 + 0.5) / 100).alias("duration_seconds"))
    c = claims.groupBy("session_id").agg(F.count("*").alias("claim_count"))
    return s.join(c, "session_id", "left").withColumn("claim_count", F.coalesce("claim_count", F.lit(0)))


def transcript_summary(segments: DataFrame) -> DataFrame:
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "text"))), lambda x: x["text"]), " ")
    return segments.groupBy("session_id").agg(F.count("*").alias("n_segments"), F.greatest(F.count_distinct("speaker"), F.lit(1)).alias("n_speakers"), said.alias("full_text"), F.max("end_s").alias("duration"))


def alignment_candidates(asked: DataFrame, heard: DataFrame) -> DataFrame:
    """(_a, segment_index, times, score) of the segments that may be a statement's best: score is the words in common, two more for the same speaker.

    asked (_a, session_id, _speaker, _words) and heard (_h, session_id, speaker, words, segment_index, times) are written
    tables. A statement meets the segments that hold its rarest word first. Whoever is to reach the best score found must
    share so many words that one of them is among the rarest m - score + 1 of the statement's m words that were said at
    all, or m - score + 3 for the same speaker; only by those does it meet more. What everyone says comes last, and as a rule isn't looked up.
    """
    said = heard.select("session_id", "_h", "speaker", F.explode("words").alias("word"))
    often = said.groupBy("session_id", "word").agg(F.count("*").alias("df"))
    mine = Window.partitionBy("_a")
    own = asked.select("_a", "session_id", "_speaker", F.explode("_words").alias("word")).join(often, ["session_id", "word"])
    own = written(own.withColumn("place", F.row_number().over(mine.orderBy("df", "word"))).withColumn("m", F.count("*").over(mine)).drop("df"), "asked-words")

    bonus = F.when(F.col("speaker") == F.col("_speaker"), 2).otherwise(0)

    def met(words: DataFrame, last: Column) -> DataFrame:
        pairs = words.join(said, ["session_id", "word"]).where(F.col("place") <= last).select("_a", "_h").distinct()
        both = pairs.join(asked.select("_a", "_speaker", "_words"), "_a").join(heard.select("_h", "speaker", "words", "segment_index", "times"), "_h")
        score = F.size(F.array_intersect("_words", "words")) + bonus
        return both.select("_a", "segment_index", "times", score.cast("long").alias("score"))

    first = written(met(own.where("place = 1"), F.lit(1)), "aligned")
    least = first.groupBy("_a").agg(F.max("score").alias("least"))
    return first.unionByName(met(own.join(least, "_a").where("place > 1"), F.col("m") - F.col("least") + 1 + bonus))


def align_statements(statements: DataFrame, segments: DataFrame) -> DataFrame:
    """(statement_id, start_s, end_s) of the segment with most words in common, two more for the same speaker; the first on ties.

    A statement that no segment scores for spans the session.
    """
    bag = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")))
    s = statements.select("statement_id", "session_id", F.col("speaker").alias("_speaker"), bag("text").alias("_words"))
    g = segments.select("session_id", "segment_index", "start_s", "end_s", "speaker", bag("text").alias("words"))
    # Of segments that score alike for any statement, and of statements that ask alike, one is enough.
    asked = written(s.select("session_id", "_speaker", "_words").distinct().withColumn("_a", F.monotonically_increasing_id()), "asked")
    times = F.struct("start_s", "end_s")
    heard = g.groupBy("session_id", "speaker", "words").agg(F.min("segment_index").alias("segment_index"), F.min_by(times, "segment_index").alias("times"))
    shared = alignment_candidates(asked, written(heard.withColumn("_h", F.monotonically_increasing_id()), "heard"))
    own = g.where("speaker IS NOT NULL").groupBy("session_id", F.col("speaker").alias("_speaker")).agg(F.min("segment_index").alias("segment_index"), F.min_by(times, "segment_index").alias("times"), F.lit(2).cast("long").alias("score"))
    best = shared.unionByName(asked.join(own, ["session_id", "_speaker"]).select("_a", "segment_index", "times", "score"))
    best = best.groupBy("_a").agg(F.max_by("times", F.struct("score", -F.col("segment_index"))).alias("best"))
    best = asked.join(best, "_a").select(F.col("session_id").alias("_s"), F.col("_speaker").alias("_p"), F.col("_words").alias("_w"), "best")
    spans = g.groupBy("session_id").agg(F.min_by("start_s", "segment_index").alias("first"), F.max_by("end_s", "segment_index").alias("last"))
    rows = s.join(spans, "session_id")
    rows = rows.join(best, (rows["session_id"] == best["_s"]) & rows["_speaker"].eqNullSafe(best["_p"]) & (rows["_words"] == best["_w"]), "left")
    return rows.select("statement_id", F.coalesce("best.start_s", "first").alias("start_s"), F.coalesce("best.end_s", "last").alias("end_s"))


def trailing_history(turns: DataFrame, n: int = 10) -> DataFrame:
    """The last 2n messages of each conversation, less the blank ones among them."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("_back", back).where((F.col("_back") <= 2 * n) & (F.trim("text") != "")).drop("_back")


def idle_batches(segments: DataFrame, idle: float = 2.0) -> DataFrame:
    """segments with `batch`, which ends when `idle` seconds pass without one."""
    w = Window.partitionBy("session_id").orderBy("segment_index")
    return islands(segments, ["session_id"], ["segment_index"], F.round(F.col("start_s") - F.lag("end_s").over(w), 6) >= idle).withColumnRenamed("island", "batch")
