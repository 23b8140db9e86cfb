"""Queries over transcript segments, sessions, conversations and claims."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import claims as K
from docspark.operators import transcripts as X
from docspark.plans.scalars import ANCHOR_SQL, BAG_SQL, CLASS_SQL, _FINGER, _NORM, _Q
from docspark.sources.tables import cte, read

C = F.col
QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _segments(spark, sf_dir):
    return read(spark, sf_dir, "segments").withColumn("end_s", F.round(C("start_s") + 2, 3))


_SEG = f"{cte('segments')}, seg AS (SELECT *, round(start_s + 2, 3) AS end_s FROM segments_v)"


def _words(spark, sf_dir):
    split = _segments(spark, sf_dir).select("session_id", "segment_index", "speaker", "event_id", "start_s", "confidence", F.posexplode(F.split("text", " ")).alias("k", "word"))
    return split.select("session_id", "event_id", (C("segment_index") * 100 + C("k")).alias("position"), ((C("speaker") + F.floor(C("k") / 4)) % 3).cast("int").alias("speaker"), "word", F.round(C("start_s") + C("k") / 10, 3).alias("start_s"), F.round(C("start_s") + C("k") / 10 + 0.1, 3).alias("end_s"), "confidence")


_WORDS = f"""{_SEG}, w AS (SELECT session_id, event_id, segment_index * 100 + k AS position, ((speaker + k // 4) % 3)::INT AS speaker, word, round(start_s + k / 10, 3) AS start_s, round(start_s + k / 10 + 0.1, 3) AS end_s, confidence
  FROM (SELECT *, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS k FROM seg))"""


@query(f"{_SEG} SELECT event_id FROM seg WHERE confidence >= 0.5 AND (len(string_split(trim(text), ' ')) >= 3 OR {ANCHOR_SQL})")
def filter_segments(spark, sf_dir):
    return X.filter_segments(_segments(spark, sf_dir)).select("event_id")


_ISLANDS = "SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY session_id ORDER BY position) <> speaker THEN 1 ELSE 0 END AS brk FROM w)"


@query(f"{_WORDS}, i AS ({_ISLANDS}) SELECT session_id, position, island::BIGINT AS island FROM i")
def speaker_islands(spark, sf_dir):
    words = _words(spark, sf_dir)
    w = Window.partitionBy("session_id").orderBy("position")
    return X.islands(words, ["session_id"], ["position"], F.lag("speaker").over(w) != C("speaker")).select("session_id", "position", "island")


@query(f"{_WORDS}, i AS ({_ISLANDS}) SELECT session_id, island::BIGINT AS island, speaker, string_agg(word, ' ' ORDER BY position) AS text, min(start_s) AS start_s, max(end_s) AS end_s, round(avg(confidence), 6) AS confidence, count(*) AS n_words FROM i GROUP BY ALL")
def words_to_segments(spark, sf_dir):
    return X.words_to_segments(_words(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(f"""{_SEG}, b AS (SELECT *, CASE WHEN lag(speaker) OVER w <> speaker OR round(start_s - lag(end_s) OVER w, 6) > 5 THEN 1 ELSE 0 END AS brk FROM seg WINDOW w AS (PARTITION BY session_id ORDER BY segment_index))
  SELECT session_id, segment_index, sum(brk) OVER (PARTITION BY session_id ORDER BY segment_index ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM b""")
def transcript_blocks(spark, sf_dir):
    return X.transcript_blocks(_segments(spark, sf_dir)).select("session_id", "segment_index", "block")


@query(f"""{_SEG}, b AS (SELECT *, CASE WHEN round(start_s - lag(end_s) OVER (PARTITION BY session_id ORDER BY segment_index), 6) >= 2 THEN 1 ELSE 0 END AS brk FROM seg)
  SELECT session_id, batch, count(*) AS n, min(segment_index) AS first_segment FROM (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY segment_index ROWS UNBOUNDED PRECEDING)::BIGINT AS batch FROM b) GROUP BY ALL""")
def idle_batches(spark, sf_dir):
    return X.idle_batches(_segments(spark, sf_dir)).groupBy("session_id", "batch").agg(F.count("*").alias("n"), F.min("segment_index").alias("first_segment"))


_MAJOR = "major AS (SELECT event_id, speaker FROM (SELECT event_id, speaker, row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, min(position)) AS n FROM w GROUP BY event_id, speaker) WHERE n = 1)"


@query(f"{_WORDS}, {_MAJOR} SELECT event_id, speaker FROM major")
def majority_speaker(spark, sf_dir):
    return X.majority_speaker(_words(spark, sf_dir), ["event_id"])


@query(f"{_WORDS}, {_MAJOR} SELECT w.event_id, string_agg(word, ' ' ORDER BY position) AS text, min(start_s) AS start_s, max(end_s) AS end_s, round(avg(confidence), 6) AS confidence, CASE WHEN w.event_id % 2 = 0 THEN 0 ELSE major.speaker + 1 END AS speaker FROM w JOIN major ON major.event_id = w.event_id GROUP BY w.event_id, major.speaker")
def result_to_segment(spark, sf_dir):
    return X.result_to_segment(_words(spark, sf_dir), ["event_id"], C("event_id") % 2).withColumn("confidence", F.round("confidence", 6))


@query(f"{_SEG} SELECT session_id, segment_index FROM (SELECT *, lead(segment_index) OVER (PARTITION BY session_id ORDER BY segment_index) AS nxt FROM seg) WHERE is_final OR nxt IS NULL")
def collapse_interim(spark, sf_dir):
    return X.collapse_interim(_segments(spark, sf_dir)).select("session_id", "segment_index")


_UTT = "u AS (SELECT session_id, segment_index, speaker, text, segment_index % 2 = 0 AS has FROM seg)"


@query(f"""{_WORDS}, i AS ({_ISLANDS}), {_UTT}, s AS (SELECT session_id, bool_or(has AND speaker = 1) AS prefer FROM u GROUP BY 1)
  SELECT u.session_id, u.speaker, u.text, 'utterance' AS source FROM u JOIN s USING (session_id) WHERE prefer AND has UNION ALL SELECT i.session_id, i.speaker, string_agg(word, ' ' ORDER BY position), 'words' FROM i JOIN s USING (session_id) WHERE NOT prefer GROUP BY i.session_id, i.island, i.speaker""")
def utterances_or_words(spark, sf_dir):
    seg = _segments(spark, sf_dir).withColumn("has", C("segment_index") % 2 == 0)
    prefer = seg.groupBy("session_id").agg(F.bool_or(C("has") & (C("speaker") == 1)).alias("prefer"))
    first = seg.join(prefer, "session_id").where("prefer and has").select("session_id", "speaker", "text", F.lit("utterance").alias("source"))
    other = X.words_to_segments(_words(spark, sf_dir)).join(prefer, "session_id").where("not prefer").select("session_id", "speaker", "text", F.lit("words").alias("source"))
    return first.unionByName(other)


@query(f"{_SEG} SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY segment_index) - 1 AS dense_index FROM seg WHERE is_final")
def segment_index(spark, sf_dir):
    dense = F.row_number().over(Window.partitionBy("session_id").orderBy("segment_index")) - 1
    return _segments(spark, sf_dir).where("is_final").select("session_id", "event_id", dense.alias("dense_index"))


@query(f"{_SEG}, f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY segment_index DESC) AS back FROM seg WHERE is_final) SELECT session_id, segment_index, row_number() OVER (PARTITION BY session_id ORDER BY segment_index) - 1 AS place FROM f WHERE back <= 100")
def rolling_buffer(spark, sf_dir):
    return X.rolling_buffer(_segments(spark, sf_dir)).select("session_id", "segment_index", "place")


@query(f"{_SEG} SELECT event_id, coalesce(array_to_string(list(text) OVER (PARTITION BY session_id ORDER BY segment_index ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), chr(10)), '') AS context FROM seg")
def claim_context(spark, sf_dir):
    return X.claim_context(_segments(spark, sf_dir)).select("event_id", "context")


_FOUND = "list_sort(list_distinct(flatten(list({0}) OVER (PARTITION BY session_id ORDER BY segment_index ROWS UNBOUNDED PRECEDING))))"


@query(f"{_SEG}, m AS (SELECT *, regexp_extract_all(text, {_Q(T.REFERENCE)}, 1) AS r, regexp_extract_all(text, {_Q(chr(92) + 'b(' + chr(92) + 'd{5,})' + chr(92) + 'b')}, 1) AS i, regexp_extract_all(text, {_Q(T.MONEY)}) AS a FROM seg) SELECT event_id, {_FOUND.format('r')} AS reference_numbers, {_FOUND.format('i')} AS numeric_ids, {_FOUND.format('a')} AS amounts FROM m")
def entity_summary(spark, sf_dir):
    return X.entity_summary(_segments(spark, sf_dir)).select("event_id", "reference_numbers", "numeric_ids", "amounts")


@query(f"{_SEG} SELECT session_id, count(*) AS segment_count, count(DISTINCT speaker) AS speaker_count, floor(round((max(end_s) - min(start_s)) * 1000) / 10 + 0.5) / 100 AS duration_seconds, count(*) FILTER (event_id % 4 = 0) AS claim_count FROM seg GROUP BY 1")
def session_stats(spark, sf_dir):
    seg = _segments(spark, sf_dir)
    return X.session_stats(seg, seg.where("event_id % 4 = 0"))


@query(f"{_SEG} SELECT session_id, count(*) AS n_segments, greatest(count(DISTINCT speaker), 1) AS n_speakers, md5(string_agg(text, ' ' ORDER BY segment_index)) AS full_text, max(end_s) AS duration FROM seg GROUP BY 1")
def transcript_summary(spark, sf_dir):
    return X.transcript_summary(_segments(spark, sf_dir)).withColumn("full_text", F.md5("full_text"))


@query(f"{cte('sessions')} SELECT user_id, count(*) AS recording, count(*) >= 3 AS at_quota FROM sessions_v WHERE status = 'recording' GROUP BY 1")
def session_quota(spark, sf_dir):
    return read(spark, sf_dir, "sessions").where("status = 'recording'").groupBy("user_id").agg(F.count("*").alias("recording"), (F.count("*") >= 3).alias("at_quota"))


@query(f"{cte('sessions')} SELECT session_id, CASE WHEN late THEN 'failed' ELSE status END AS status, CASE WHEN late THEN TIMESTAMP '2024-06-15 00:00:00' END AS ended_at FROM (SELECT *, status = 'recording' AND started_at < TIMESTAMP '2024-06-15 00:00:00' - INTERVAL 30 MINUTES AS late FROM sessions_v)")
def stale_sessions(spark, sf_dir):
    now = F.expr("TIMESTAMP '2024-06-15 00:00:00'")
    late = (C("status") == "recording") & (C("started_at") < now - F.expr("INTERVAL 30 MINUTES"))
    return read(spark, sf_dir, "sessions").select("session_id", F.when(late, "failed").otherwise(C("status")).alias("status"), F.when(late, now).alias("ended_at"))


@query(f"{cte('sessions', 'vaults')} SELECT session_id, title, v.name AS vault_name, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, session_id) AS position FROM sessions_v s JOIN vaults_v v USING (vault_id)")
def session_list(spark, sf_dir):
    joined = read(spark, sf_dir, "sessions").join(read(spark, sf_dir, "vaults").select("vault_id", C("name").alias("vault_name")), "vault_id")
    return joined.select("session_id", "title", "vault_name", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("started_at"), "session_id")).alias("position"))


@query(f"{_SEG} SELECT session_id, md5(string_agg(segment_index || ':' || text, '|' ORDER BY segment_index)) AS segments, md5(coalesce(string_agg(event_id || ':' || text, '|' ORDER BY start_s, event_id) FILTER (event_id % 4 = 0), '')) AS claims FROM seg GROUP BY 1")
def session_detail(spark, sf_dir):
    line = lambda a: F.concat(C(a).cast("string"), F.lit(":"), C("text"))
    segments = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_index", line("segment_index").alias("x")))), lambda s: s["x"]), "|")
    claims = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(C("event_id") % 4 == 0, F.struct("start_s", "event_id", line("event_id").alias("x"))))), lambda s: s["x"]), "|")
    return _segments(spark, sf_dir).groupBy("session_id").agg(F.md5(segments).alias("segments"), F.md5(claims).alias("claims"))


@query(f"{cte('turns')} SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns_v) WHERE back <= 20 AND trim(text) <> ''")
def trailing_history(spark, sf_dir):
    return X.trailing_history(read(spark, sf_dir, "turns")).select("conv_id", "turn")


_HISTORY = "CASE WHEN trim(text) <> '' THEN upper(role[1]) || lower(role[2:]) || ': ' || CASE WHEN role = 'assistant' AND length(trim(text)) > 500 THEN substr(trim(text), 1, 500) || '...' ELSE trim(text) END END"


@query(f"{cte('turns')} SELECT conv_id, turn, md5({_HISTORY}) AS line FROM turns_v")
def format_history(spark, sf_dir):
    return read(spark, sf_dir, "turns").select("conv_id", "turn", F.md5(T.history_line(C("role"), C("text"))).alias("line"))


_UNQUOTED = _NORM.format("trim(made, '\"''')")


@query(rf"""{cte('turns')}, h AS (SELECT conv_id, string_agg({_HISTORY}, chr(10) ORDER BY turn) AS prompt, max_by(text, turn) AS last_text, count(*) AS n, string_agg({_HISTORY}, chr(10) ORDER BY turn) FILTER (back > 1) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns_v) WHERE back <= 20 GROUP BY 1),
  m AS (SELECT *, {_NORM.format('trim(last_text)')} AS plain, trim('"' || last_text || ' of ' || regexp_extract(history, '[a-z]{{7,}}') || '"') AS made FROM h)
  SELECT conv_id, md5(CASE WHEN n = 1 THEN plain ELSE coalesce(prompt, '') END) AS prompt, md5(CASE WHEN trim(coalesce(last_text, '')) = '' THEN last_text WHEN made <> '' AND length(made) <= 300 AND trim(coalesce(history, '')) <> '' THEN {_UNQUOTED} ELSE plain END) AS rewritten FROM m""")
def rewrite_queries(spark, sf_dir):
    """A rewriter that names the first long word of the history, in quotes; answers above 300 characters are not used."""
    from docspark.operators.verify import rewrite_query

    turns = read(spark, sf_dir, "turns").withColumn("_back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("_back <= 20")
    line = T.history_line(C("role"), C("text"))
    lines = lambda when: F.filter(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("turn", line.alias("line"))))), lambda x: x["line"]), lambda x: x.isNotNull())
    h = turns.groupBy("conv_id").agg(F.array_join(lines(F.lit(True)), "\n").alias("prompt"), F.array_join(lines(C("_back") > 1), "\n").alias("history"), F.max_by("text", "turn").alias("last"), F.count("*").alias("n"))
    rewriter = lambda q, old: F.concat(F.lit('"'), q, F.lit(" of "), F.regexp_extract(old, "[a-z]{7,}", 0), F.lit('"'))
    return h.select("conv_id", F.md5(F.when(C("n") == 1, T.normalize_numbers(F.trim("last"))).otherwise(C("prompt"))).alias("prompt"), F.md5(rewrite_query(C("last"), C("history"), rewriter, 300)).alias("rewritten"))


@query(f"{cte('turns')} SELECT conv_id, CASE WHEN length(q) > 60 THEN substr(q, 1, 60) ELSE q END AS title FROM (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS q FROM turns_v GROUP BY 1)")
def conversation_title(spark, sf_dir):
    first = F.min_by("text", F.when(C("role") == "user", C("turn")))
    return read(spark, sf_dir, "turns").groupBy("conv_id").agg(F.substring(first, 1, 60).alias("title"))


@query(f"{cte('turns')} SELECT user_id, conv_id FROM (SELECT conv_id // 70 AS user_id, conv_id, row_number() OVER (PARTITION BY conv_id // 70 ORDER BY max(turn) DESC, conv_id DESC) AS n FROM turns_v GROUP BY conv_id) WHERE n <= 50")
def recent_conversations(spark, sf_dir):
    each = read(spark, sf_dir, "turns").groupBy("conv_id").agg(F.max("turn").alias("latest")).withColumn("user_id", F.floor(C("conv_id") / 70))
    return each.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("latest"), F.desc("conv_id")))).where("n <= 50").select("user_id", "conv_id")


@query(f"""{_SEG}, st AS (SELECT event_id AS statement_id, session_id, speaker, list_distinct(string_split(lower(text), ' ')) AS words FROM seg),
  g AS (SELECT statement_id, start_s, end_s, row_number() OVER (PARTITION BY statement_id ORDER BY len(list_intersect(st.words, string_split(lower(s.text), ' '))) + CASE WHEN s.speaker = st.speaker THEN 2 ELSE 0 END DESC, segment_index) AS n FROM st JOIN seg s USING (session_id)) SELECT statement_id, start_s, end_s FROM g WHERE n = 1""")
def align_statements(spark, sf_dir):
    seg = _segments(spark, sf_dir)
    return X.align_statements(seg.select(C("event_id").alias("statement_id"), "session_id", "speaker", "text"), seg)


@query(f"""WITH b AS (SELECT {BAG_SQL} AS bag, min(doc_id) AS id FROM documents GROUP BY 1), w AS (SELECT id, len(bag) AS n, unnest(bag) AS word FROM b WHERE len(bag) > 0),
  s AS (SELECT x.id AS a, y.id AS b, count(*) AS n, x.n + y.n AS m FROM w x JOIN w y ON x.word = y.word AND x.id < y.id GROUP BY x.id, y.id, x.n, y.n) SELECT a, b, round(n / (m - n), 9) AS similarity FROM s WHERE n / (m - n) >= 0.8""")
def near_duplicate_pairs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(C("doc_id").alias("statement_id"), "text")
    return K.near_duplicate_pairs(docs).withColumn("similarity", F.round("similarity", 9))


@query(f"""WITH d AS (SELECT doc_id, {BAG_SQL} AS bag FROM documents), c AS (SELECT bag, min(doc_id) AS id FROM d WHERE len(bag) > 0 GROUP BY 1), w AS (SELECT id, len(bag) AS n, unnest(bag) AS word FROM c),
  s AS (SELECT x.id AS a, y.id AS b, count(*) AS n, x.n + y.n AS m FROM w x JOIN w y ON x.word = y.word AND x.id < y.id GROUP BY x.id, y.id, x.n, y.n), p AS (SELECT a, b FROM s WHERE n / (m - n) >= 0.8),
  l AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY 1) SELECT doc_id AS statement_id, coalesce(c.id, doc_id) AS class_id, coalesce(l.n, 0) AS n_links FROM d LEFT JOIN c ON c.bag = d.bag LEFT JOIN l ON l.id = c.id""")
def near_duplicate_members(spark, sf_dir):
    return K.near_duplicate_members(read(spark, sf_dir, "documents").select(C("doc_id").alias("statement_id"), "text"))


@query(None)
def dedup_claims(spark, sf_dir):
    return K.dedup_claims(_segments(spark, sf_dir).select("session_id", "segment_index", "event_id", "text"))


_MENTIONS = " UNION ALL ".join(f"SELECT session_id, segment_index, '{k}' AS kind, unnest(regexp_extract_all(text, {_Q(p)}, {g})) AS value FROM seg" for k, p, g in (("reference_numbers", T.REFERENCE, 1), ("numeric_ids", T.NUMERIC_ID, 1), ("amounts", T.MONEY, 0)))


@query(f"{_SEG} SELECT session_id, kind, value, min(segment_index) AS segment_index FROM ({_MENTIONS}) GROUP BY ALL")
def entity_mentions(spark, sf_dir):
    return X.entity_mentions(_segments(spark, sf_dir))


_PROMPTS = f"""m AS (SELECT *, regexp_extract_all(text, {_Q(T.REFERENCE)}, 1) AS r FROM seg), p AS (SELECT event_id, speaker, text, CASE WHEN len({_FOUND.format('r')}) > 0 THEN 'KNOWN ENTITIES IN THIS CONVERSATION:' || chr(10) || array_to_string({_FOUND.format('r')}, ', ') || chr(10) || chr(10) ELSE '' END
  || CASE WHEN count(*) OVER w > 0 THEN 'PRIOR CONTEXT:' || chr(10) || array_to_string(list(text) OVER w, chr(10)) || chr(10) || chr(10) ELSE '' END || 'TRANSCRIPT:' || chr(10) || 'Speaker ' || speaker || ': ' || text AS prompt FROM m WINDOW w AS (PARTITION BY session_id ORDER BY segment_index ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"""


def _prompts(spark, sf_dir):
    known = X.entity_summary(_segments(spark, sf_dir)).select("event_id", F.array_join("reference_numbers", ", ").alias("known"))
    heard = X.claim_context(_segments(spark, sf_dir)).join(known, "event_id")
    said = F.concat(F.lit("Speaker "), C("speaker").cast("string"), F.lit(": "), "text")
    return heard.select("event_id", K.extraction_prompt(C("known"), C("context"), said).alias("prompt"))


@query(f"{_SEG}, {_PROMPTS} SELECT event_id, md5(prompt) AS prompt FROM p")
def extraction_prompt(spark, sf_dir):
    return _prompts(spark, sf_dir).withColumn("prompt", F.md5("prompt"))


@query(f"{_SEG}, {_PROMPTS} SELECT event_id, trim(text) AS text, 0 AS speaker, '' AS context FROM p WHERE trim(text) <> ''")
def extract_statements(spark, sf_dir):
    """An extractor that answers with the last line of its prompt."""
    said = lambda p: F.regexp_extract(p, r"Speaker \d+: ([^\n]*)$", 1)
    return K.extract_statements(_prompts(spark, sf_dir), lambda p: F.to_json(F.struct(F.array(F.struct(said(p).alias("text"))).alias("statements"))))


@query(f"{_SEG} SELECT event_id, session_id, speaker, text FROM seg WHERE is_final AND confidence >= 0.5 AND {ANCHOR_SQL} AND len(string_split(trim(text), ' ')) >= 3")
def extract_statements_rules(spark, sf_dir):
    kept = X.filter_segments(_segments(spark, sf_dir).where("is_final"))
    return kept.where(T.entity_anchor(C("text")) & (F.size(F.split(F.trim("text"), " ")) >= 3)).select("event_id", "session_id", "speaker", "text")


_KEY = f"'verdict_cache:' || vault_id || ':v1:' || sha256({_FINGER.format(_NORM.format('text'))})"


@query(f"{cte('statements')}, k AS (SELECT *, {_KEY} AS cache_key FROM statements_v), cache AS (SELECT cache_key, min(statement_id) AS id FROM k GROUP BY 1), fresh AS (SELECT cache_key, CASE WHEN id % 2 = 0 THEN 'supported' ELSE 'unverifiable' END AS verdict FROM cache WHERE id % 600 <= 300) SELECT statement_id, f.cache_key IS NOT NULL AS cache_hit, verdict FROM k LEFT JOIN fresh f USING (cache_key)")
def verdict_cache_lookup(spark, sf_dir):
    keyed = read(spark, sf_dir, "statements").withColumn("cache_key", T.verdict_cache_key(C("vault_id"), F.lit("v1"), C("text")))
    now = F.expr("TIMESTAMP '2024-01-01 00:10:00'")
    cache = keyed.groupBy("cache_key").agg(F.min("statement_id").alias("id")).select("cache_key", F.when(C("id") % 2 == 0, "supported").otherwise("unverifiable").alias("verdict"), F.timestamp_seconds(F.unix_timestamp(now) - C("id") % 600).alias("cached_at"))
    hits, misses = K.cache_lookup(keyed, cache, now)
    return hits.select("statement_id", F.lit(True).alias("cache_hit"), "verdict").unionByName(misses.select("statement_id", F.lit(False).alias("cache_hit"), F.lit(None).cast("string").alias("verdict")))


@query(f"{_SEG}, v AS (SELECT event_id // 2 * 2 AS claim_id, event_id AS heard, CASE WHEN event_id % 3 = 0 THEN 'supported' ELSE 'contradicted' END AS verdict FROM seg), l AS (SELECT claim_id, max_by(verdict, heard) AS verdict FROM v GROUP BY 1) SELECT event_id AS claim_id, coalesce(verdict, 'pending') AS verdict FROM seg LEFT JOIN l ON l.claim_id = event_id")
def claim_status(spark, sf_dir):
    seg = _segments(spark, sf_dir)
    verdicts = seg.select((F.floor(C("event_id") / 2) * 2).alias("claim_id"), C("event_id").alias("at"), F.when(C("event_id") % 3 == 0, "supported").otherwise("contradicted").alias("verdict"))
    return K.claim_status(seg.select(C("event_id").alias("claim_id")), verdicts)


def _responses(spark, sf_dir):
    """Model responses as JSON made of events: good ones, odd verdicts, fields left out, broken JSON."""
    e = read(spark, sf_dir, "events")
    kind = C("event_id") % 5
    good = F.to_json(F.struct(F.when(kind == 1, "maybe").otherwise("supported").alias("verdict"), (C("value") / 100).alias("confidence"), C("event_type").alias("explanation"), F.array(F.struct(F.lit("a.pdf").alias("doc_title"), C("props").alias("quote"))).alias("evidence")))
    return e.select("event_id", F.when(kind == 0, F.substring(good, 1, 12)).when(kind == 2, F.lit('{"verdict": "contradicted"}')).otherwise(good).alias("raw"), "event_type", "props", "value")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'unverifiable' WHEN 1 THEN 'unverifiable' WHEN 2 THEN 'contradicted' ELSE 'supported' END AS verdict, CASE WHEN event_id % 5 IN (0, 2) THEN 0 ELSE greatest(0, least(1, round(value / 100, 9))) END AS confidence,
  CASE WHEN event_id % 5 IN (0, 2) THEN '' ELSE event_type END AS explanation, CASE WHEN event_id % 5 IN (0, 2) THEN 0 ELSE 1 END AS n_evidence, CASE WHEN event_id % 5 NOT IN (0, 2) THEN coalesce(props, '') END AS quote FROM events""")
def parse_verdict_json(spark, sf_dir):
    v = _responses(spark, sf_dir).select("event_id", K.parse_verdict(C("raw")).alias("v"))
    return v.select("event_id", "v.verdict", F.round("v.confidence", 9).alias("confidence"), "v.explanation", F.size("v.evidence").alias("n_evidence"), F.try_element_at("v.evidence", F.lit(1))["quote"].alias("quote"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'other' ELSE 'invoice' END AS document_type, CASE WHEN event_id % 5 = 0 THEN [] ELSE [event_type] END AS keywords, CASE WHEN event_id % 5 > 0 THEN event_id::VARCHAR END AS entity_id,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 3 THEN NULL ELSE DATE '2016-07-04' END AS order_date, CASE WHEN event_id % 5 > 0 THEN 1000 + event_id END::DOUBLE AS total_price FROM events""")
def parse_metadata_json(spark, sf_dir):
    kind, number = C("event_id") % 5, C("event_id").cast("string")
    entities = F.create_map(F.lit("entity_id"), number, F.lit("customer_id"), F.lit("None"), F.lit("date"), F.when(kind == 3, "2016-13-77").otherwise("2016-07-04"), F.lit("total_amount"), F.concat(F.lit("$"), F.format_number(C("event_id") + 1000, 0)))
    good = F.to_json(F.struct(F.when(kind == 1, "poem").otherwise("invoice").alias("document_type"), F.array(C("event_type"), F.lit("")).alias("keywords"), entities.alias("entities")))
    raw = F.when(kind == 0, "{broken").when(kind == 2, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).otherwise(good)
    m = read(spark, sf_dir, "events").select("event_id", K.parse_metadata(raw).alias("m"))
    return m.select("event_id", "m.document_type", "m.keywords", "m.entity_id", "m.order_date", "m.total_price")


@query("SELECT event_id, event_type AS text, 0 AS speaker FROM events WHERE event_id % 5 <> 0")
def parse_statements_json(spark, sf_dir):
    good = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit(" "), C("event_type")).alias("text")), F.struct(F.lit("  ").alias("text"))).alias("statements")))
    raw = F.when(C("event_id") % 5 == 0, "[]").otherwise(good)
    return read(spark, sf_dir, "events").select("event_id", F.explode(K.parse_statements(raw)).alias("s")).select("event_id", "s.text", "s.speaker")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS answer, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS n_citations FROM events")
def parse_answer_json(spark, sf_dir):
    good = F.to_json(F.struct(C("event_type").alias("answer"), F.array(F.struct(C("props").alias("quote"))).alias("citations")))
    raw = F.when(C("event_id") % 5 == 0, "{oops").otherwise(good)
    a = read(spark, sf_dir, "events").select("event_id", F.from_json(raw, "answer string, citations array<struct<quote:string>>").alias("a"))
    return a.select("event_id", F.coalesce("a.answer", F.lit("")).alias("answer"), F.coalesce(F.size("a.citations"), F.lit(0)).alias("n_citations")).withColumn("n_citations", F.greatest("n_citations", F.lit(0)))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN [] ELSE [event_id, 1] END AS loaded FROM events")
def safe_json(spark, sf_dir):
    raw = F.when(C("event_id") % 7 == 0, F.lit(None)).when(C("event_id") % 5 == 0, "[1, oops").otherwise(F.concat(F.lit("["), C("event_id").cast("string"), F.lit(", 1]")))
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json(raw, "array<bigint>"), F.array().cast("array<bigint>")).alias("loaded"))


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total, len(embedding) AS n FROM embeddings WHERE vec_id % 10 <> 0 UNION ALL SELECT vec_id, NULL, NULL FROM embeddings WHERE vec_id % 10 = 0")
def parse_vector(spark, sf_dir):
    text = F.when(C("vec_id") % 10 == 0, "not a vector").otherwise(F.to_json("embedding"))
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.from_json(text, "array<double>").alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.when(C("v").isNotNull(), F.size("v")).alias("n"))


@query("SELECT event_id, event_type AS explanation FROM events WHERE event_type NOT LIKE 'c%'")
def cacheable_verdicts(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.when(C("event_type").startswith("c"), F.concat(F.lit("Verification timed out: "), C("event_type"))).otherwise(C("event_type")).alias("explanation"))
    return e.where(K.is_cacheable(C("explanation"))).select("event_id", "explanation")


@query(f"{_SEG} SELECT event_id AS claim_id, 1 AS n_evidence, 'segment ' || segment_index AS title, text AS quote FROM seg")
def claim_evidence(spark, sf_dir):
    stored = _segments(spark, sf_dir).select(C("event_id").alias("claim_id"), F.to_json(F.array(F.struct(F.concat(F.lit("segment "), C("segment_index").cast("string")).alias("doc_title"), C("text").alias("quote")))).alias("evidence_json"))
    back = stored.select("claim_id", F.coalesce(F.from_json("evidence_json", K.EVIDENCE), F.array().cast(K.EVIDENCE)).alias("e"))
    return back.select("claim_id", F.size("e").alias("n_evidence"), C("e")[0]["doc_title"].alias("title"), C("e")[0]["quote"].alias("quote"))


_RULED = rf"""p AS (SELECT *, {_NORM.format('text')} AS plain FROM statements_v), e AS (SELECT *, CASE statement_id % 3 WHEN 0 THEN 'nothing here' WHEN 1 THEN 'invoice ' || regexp_extract(plain, 'invoice (\d+)', 1) || ' total $' || regexp_extract(plain, '\$(\d+)', 1) ELSE 'invoice ' || regexp_extract(plain, 'invoice (\d+)', 1) || ' total $7' END AS evidence,
  regexp_extract_all(plain, '\b\d{{4,}}\b') AS ids, regexp_extract_all(plain, '\$(\d+(?:\.\d+)?)', 1) AS amounts FROM p)"""


@query(f"{cte('statements')}, {_RULED} SELECT statement_id, CASE WHEN len(list_filter(ids, lambda x: contains(evidence, x))) = 0 THEN 'unverifiable' WHEN len(amounts) = 0 OR len(list_filter(amounts, lambda x: contains(evidence, x))) > 0 THEN 'supported' ELSE 'contradicted' END AS verdict FROM e")
def verify_point_rules(spark, sf_dir):
    s = read(spark, sf_dir, "statements")
    plain = T.normalize_numbers(C("text"))
    own = F.concat(F.lit("invoice "), F.regexp_extract(plain, r"invoice (\d+)", 1))
    evidence = F.when(C("statement_id") % 3 == 0, "nothing here").when(C("statement_id") % 3 == 1, F.concat(own, F.lit(" total $"), F.regexp_extract(plain, r"\$(\d+)", 1))).otherwise(F.concat(own, F.lit(" total $7")))
    return s.select("statement_id", K.rule_verdict(C("text"), evidence).alias("verdict"))


@query(f"{cte('turns')} SELECT conv_id, turn, count(*) FILTER (role = 'assistant') OVER w AS iterations, count(*) FILTER (role = 'assistant') OVER w > 6 OR count(*) FILTER (role = 'system') OVER w > 3 AS over_budget FROM turns_v WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def tool_budget(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    calls, full = F.count_if(C("role") == "assistant").over(w), F.count_if(C("role") == "system").over(w)
    return read(spark, sf_dir, "turns").select("conv_id", "turn", calls.alias("iterations"), ((calls > 6) | (full > 3)).alias("over_budget"))


@query(f"{cte('statements')}, c AS (SELECT *, {CLASS_SQL} AS class FROM (SELECT *, {_NORM.format('lower(text)')} AS low FROM statements_v)) SELECT statement_id, class, 'system: Answer from the vault.' || chr(10) || CASE class WHEN 'point' THEN '' ELSE 'system: Plan for a question of class ' || class || chr(10) END || 'user: ' || text AS messages FROM c")
def build_messages(spark, sf_dir):
    kind = T.classify_query(C("text"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    hint = F.when(kind != "point", F.array(message("system", F.concat(F.lit("Plan for a question of class "), kind))))
    messages = F.concat(F.array(message("system", F.lit("Answer from the vault."))), F.coalesce(hint, F.array().cast("array<struct<role:string,content:string>>")), F.array(message("user", C("text"))))
    said = F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return read(spark, sf_dir, "statements").select("statement_id", kind.alias("class"), said.alias("messages"))
