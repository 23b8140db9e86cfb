"""Ingestion, event and end-to-end queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import events as E
from docspark.operators import ingest as I
from docspark.operators import models
from docspark.operators import retrieval as R
from docspark.plans.documents import _VERIFY
from docspark.plans.retrieval import _RRF, _bm25_sql, _dense_sql, _mmr1, index_of
from docspark.plans.scalars import CLASS_SQL, _FINGER, _NORM, _Q
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


def _content(spark, sf_dir):
    text = F.concat(F.lit("**Order Date:** "), C("order_date").cast("string"), F.lit("\n**Customer ID:** "), C("customer_id"), F.lit("\n| TotalPrice | $"), F.format_number("total_price", 2))
    return read(spark, sf_dir, "doc_meta").withColumn("text", F.coalesce(text, F.lit("nothing")))


@query(None)
def chunk_recursive(spark, sf_dir):
    return I.chunk_recursive(read(spark, sf_dir, "documents"))


_WINDOWS = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\s+'), lambda x: x <> '') AS words FROM documents), k AS (SELECT doc_id, words, unnest(range(greatest(ceil((len(words) - 50) / 462), 1)::BIGINT)) AS chunk_index FROM w WHERE len(words) > 0)"""


@query(f"{_WINDOWS} SELECT doc_id, chunk_index, md5(array_to_string(words[chunk_index * 462 + 1 : chunk_index * 462 + 512], ' ')) AS content FROM k")
def chunk_windows(spark, sf_dir):
    return I.chunk_windows(read(spark, sf_dir, "documents")).withColumn("content", F.md5("content"))


@query(f"""{_WINDOWS}, c AS (SELECT doc_id, chunk_index, array_to_string(words[chunk_index * 462 + 1 : chunk_index * 462 + 512], ' ') AS content, len(words[chunk_index * 462 + 1 : chunk_index * 462 + 512]) AS token_count FROM k)
  SELECT doc_id, chunk_index, md5('[Source: ' || source || ' ' || doc_id || ' a]' || chr(10) || content) AS content_with_header, sha256(content) AS content_hash, token_count FROM c JOIN documents USING (doc_id)""")
def chunk_records(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    named = docs.select("doc_id", F.concat("source", F.lit("_"), C("doc_id").cast("string"), F.lit("-a.md")).alias("original_filename"))
    return I.chunk_records(I.chunk_windows(docs), named).select("doc_id", "chunk_index", F.md5("content_with_header").alias("content_with_header"), "content_hash", "token_count")


@query(f"{cte('chunks')} SELECT chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY vault_id, content ORDER BY doc_id, chunk_index) AS n FROM chunks_v) WHERE n = 1")
def dedup_chunks(spark, sf_dir):
    return I.dedup_chunks(read(spark, sf_dir, "chunks")).select("chunk_id")


_NAMED = " ".join(f"WHEN regexp_extract(original_filename, {_Q(p)}, 1) <> '' THEN {{}}" for p, _ in I.NAMES)


@query(f"{cte('doc_meta')} SELECT doc_id, CASE {_NAMED.format(*[_Q(k) for _, k in I.NAMES])} END AS document_type, CASE {_NAMED.format(*[f'regexp_extract(original_filename, {_Q(p)}, 1)' for p, _ in I.NAMES])} END AS entity_id FROM doc_meta_v")
def metadata_from_filename(spark, sf_dir):
    kind, number = I.metadata_from_filename(C("original_filename"))
    return read(spark, sf_dir, "doc_meta").select("doc_id", kind.alias("document_type"), number.alias("entity_id"))


@query(f"{cte('doc_meta')} SELECT doc_id, CASE WHEN order_date IS NOT NULL AND total_price IS NOT NULL THEN order_date END AS order_date FROM doc_meta_v")
def metadata_date(spark, sf_dir):
    return _content(spark, sf_dir).select("doc_id", I.metadata_date(C("text"), C("original_filename")).alias("order_date"))


@query(f"{cte('doc_meta')} SELECT doc_id, CASE WHEN order_date IS NOT NULL AND total_price IS NOT NULL THEN customer_id END AS customer_id, CASE WHEN order_date IS NOT NULL THEN round(total_price, 2) END AS total_price FROM doc_meta_v")
def metadata_amounts(spark, sf_dir):
    return _content(spark, sf_dir).select("doc_id", I.metadata_customer(C("text")).alias("customer_id"), I.metadata_price(C("text")).alias("total_price"))


@query(f"{cte('doc_meta')} SELECT doc_id, coalesce(CASE WHEN doc_id % 3 <> 0 THEN document_type END, 'other') AS document_type, CASE WHEN doc_id % 4 = 0 THEN 'M' || doc_id ELSE entity_id END AS entity_id, coalesce(total_price, 0.5) AS total_price, 'about ' || entity_id AS summary FROM doc_meta_v")
def merge_metadata(spark, sf_dir):
    rule = {"document_type": F.when(C("doc_id") % 3 != 0, C("document_type")), "entity_id": F.when(C("doc_id") % 4 == 0, "").otherwise(C("entity_id")), "total_price": C("total_price")}
    model = {"document_type": F.lit("other"), "entity_id": F.concat(F.lit("M"), C("doc_id").cast("string")), "total_price": F.lit(0.5), "summary": F.concat(F.lit("about "), "entity_id")}
    return read(spark, sf_dir, "doc_meta").select("doc_id", *[c.alias(k) for k, c in I.merge_metadata(rule, model).items()])


@query(f"""{cte('doc_meta')}, c AS (SELECT doc_id, original_filename, concat_ws(chr(10), 'Structured Metadata:' || chr(10) || concat_ws(chr(10), '- Document Type: ' || document_type, '- Entity ID: ' || entity_id, '- Order Date: ' || order_date::VARCHAR, '- Customer ID: ' || customer_id), 'Summary: ' || document_type || ' for ' || customer_id, 'Keywords: ' || document_type || ', ' || status, 'Questions this document answers:' || chr(10) || '- What is ' || entity_id || '?' || chr(10) || '- Who ordered?') AS content FROM doc_meta_v)
  SELECT doc_id, content, '[Source: ' || string_split(original_filename, '.')[1] || ']' || chr(10) || content AS content_with_header, sha256(content) AS content_hash, length(content) // 4 AS token_count FROM c""")
def metadata_chunks(spark, sf_dir):
    m = {c: C(c) for c in ("document_type", "entity_id", "order_date", "customer_id")} | {"total_price": F.lit(None).cast("double"), "summary": F.concat("document_type", F.lit(" for "), "customer_id"), "keywords": F.array("document_type", "status"), "questions": F.array(F.concat(F.lit("What is "), "entity_id", F.lit("?")), F.lit("Who ordered?"))}
    return read(spark, sf_dir, "doc_meta").select("doc_id", *[c.alias(k) for k, c in I.metadata_chunk(m, C("original_filename")).items()])


_NORMS = "SELECT doc_id, 64 AS dim, CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm, NULL AS error FROM documents"


@query(_NORMS)
def embed_chunks(spark, sf_dir):
    return _norms(I.embed(read(spark, sf_dir, "documents").select("doc_id", "text"), "text"))


@query(_NORMS)
def embed_distinct(spark, sf_dir):
    return _norms(I.embed_distinct(read(spark, sf_dir, "documents").select("doc_id", "text"), "text"))


def _norms(rows):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return rows.select("doc_id", F.size("embedding").alias("dim"), F.round(norm, 5).alias("norm"), "error")


def _files(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", (C("doc_id") % 4).alias("vault_id"), F.concat(F.lit("invoice_"), C("doc_id").cast("string"), F.lit(".txt")).alias("original_filename"), "text", F.when(C("doc_id") % 25 == 3, "deleted").otherwise("pending").alias("status"))


@query(None)
def ingest(spark, sf_dir):
    return I.ingest(_files(spark, sf_dir)).chunks.groupBy("doc_id", "vault_id").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("tokens"), F.count_if(C("chunk_type") == "metadata").alias("n_metadata"))


@query(rf"""{_WINDOWS}, c AS (SELECT doc_id, count(*) AS n, sum(len(words[chunk_index * 462 + 1 : chunk_index * 462 + 512])) AS tokens FROM k GROUP BY 1)
  SELECT d.doc_id, CASE WHEN c.n IS NULL THEN 'failed' ELSE 'active' END AS status, CASE WHEN c.n IS NULL THEN 'No text content could be extracted' END AS error_message, coalesce(c.n + 1, 0) AS n_chunks,
    coalesce(c.tokens + length('Structured Metadata:' || chr(10) || '- Document Type: invoice' || chr(10) || '- Entity ID: ' || d.doc_id) // 4, 0)::BIGINT AS tokens
  FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id WHERE d.doc_id % 25 <> 3""")
def ingest_by_windows(spark, sf_dir):
    done = I.ingest(_files(spark, sf_dir), chunker=I.chunk_windows)
    tokens = done.chunks.groupBy("doc_id").agg(F.sum("token_count").alias("tokens"))
    return done.documents.join(tokens, "doc_id", "left").select("doc_id", "status", "error_message", "n_chunks", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE md5(replace(text, chr(13), chr(10))) END AS text, CASE WHEN doc_id % 5 = 4 THEN 'Unsupported file type ''docx''. Supported: md, txt' WHEN text IS NULL THEN 'No text content could be extracted' END AS error FROM documents""")
def parse_files(spark, sf_dir):
    kind = F.when(C("doc_id") % 5 == 4, "docx").when(C("doc_id") % 2 == 0, "TXT").otherwise("md")
    files = read(spark, sf_dir, "documents").select("doc_id", kind.alias("file_type"), F.encode("text", "UTF-8").alias("content"))
    return I.parse_files(files).select("doc_id", F.md5("text").alias("text"), "error")


def _raw(spark, sf_dir):
    docs = read(spark, sf_dir, "doc_meta")
    up = F.to_json(F.struct(F.lit("file.uploaded").alias("event_type"), C("doc_id").cast("string").alias("doc_id"), C("vault_id").cast("string").alias("vault_id"), F.lit("pdf").alias("file_type"), F.lit("p").alias("storage_path"), "original_filename", F.lit("u").alias("uploaded_by"), C("updated_at").alias("timestamp")))
    down = F.to_json(F.struct(F.lit("file.deleted").alias("event_type"), C("doc_id").cast("string").alias("doc_id"), C("vault_id").cast("string").alias("vault_id"), F.lit("u").alias("deleted_by"), C("updated_at").alias("timestamp")))
    value = F.when(C("status") == "deleted", down).otherwise(up)
    value = F.when(C("doc_id") % 97 == 0, F.substring(value, 1, 30)).when(C("doc_id") % 89 == 0, F.regexp_replace(value, "vault_id", "other_id")).otherwise(value)
    return docs.select("doc_id", value.alias("value")).withColumnRenamed("doc_id", "source_id")


@query(f"{cte('doc_meta')} SELECT doc_id AS source_id, doc_id % 97 = 0 OR doc_id % 89 = 0 AS malformed, CASE WHEN doc_id % 97 = 0 THEN NULL ELSE doc_id::VARCHAR END AS doc_id, CASE WHEN doc_id % 97 = 0 THEN NULL WHEN status = 'deleted' THEN 'file.deleted' ELSE 'file.uploaded' END AS event_type, CASE WHEN doc_id % 97 = 0 THEN NULL ELSE updated_at END AS ts FROM doc_meta_v")
def decode_file_events(spark, sf_dir):
    d = E.decode(_raw(spark, sf_dir))
    broken = C("source_id") % 97 == 0  # what a reader recovers of cut JSON isn't part of the contract
    return d.select("source_id", "malformed", *[F.when(~broken, C(c)).alias(n) for c, n in (("doc_id", "doc_id"), ("event_type", "event_type"), ("timestamp", "ts"))])


@query(f"""{cte('doc_meta')} SELECT vault_id::VARCHAR AS "key", '{{"doc_id":' || doc_id || ',"vault_id":' || vault_id || ',"status":"' || status || '"}}' AS value FROM doc_meta_v""")
def encode_events(spark, sf_dir):
    return E.encode(read(spark, sf_dir, "doc_meta"), ["doc_id", "vault_id", "status"])


@query(f"{cte('doc_meta')} SELECT 'file.events' AS topic, 'ValidationError' AS kind, 0 AS retry_count, count(*) AS n FROM doc_meta_v WHERE doc_id % 97 = 0 OR doc_id % 89 = 0 HAVING count(*) > 0")
def dlq_envelope(spark, sf_dir):
    bad = E.decode(_raw(spark, sf_dir)).where("malformed")
    letters = E.dead_letters(bad, "file.events", F.lit("bad event"), F.lit("ValidationError"), F.expr("TIMESTAMP '2024-01-01 00:00:00'"))
    back = letters.select(F.from_json("value", "original_topic string, original_event string, error_message string, error_type string, retry_count int, failed_at timestamp").alias("e"))
    return back.groupBy(C("e.original_topic").alias("topic"), C("e.error_type").alias("kind"), C("e.retry_count").alias("retry_count")).agg(F.count("e.original_event").alias("n"))


@query(f"""{cte('doc_meta')} SELECT doc_id, 'document.' || status AS event_type, CASE WHEN doc_id % 3 <> 0 THEN '{{"name":"' || original_filename || '"}}' END AS payload FROM doc_meta_v""")
def audit_log(spark, sf_dir):
    payload = F.when(C("doc_id") % 3 != 0, F.create_map(F.lit("name"), C("original_filename"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = read(spark, sf_dir, "doc_meta").select(F.concat(F.lit("document."), "status").alias("event_type"), "vault_id", "doc_id", payload.alias("payload"))
    return E.audit_rows(rows).drop("vault_id")


@query(None)
def grade_retrieval(spark, sf_dir):
    q, c = read(spark, sf_dir, "queries"), read(spark, sf_dir, "chunks")
    from docspark.operators.verify import grade

    return grade(R.bm25(q, c, 10, index_of(spark, sf_dir)), q, c)


@query(None)
def corrective_retrieve(spark, sf_dir):
    from docspark.operators.verify import corrective

    index = index_of(spark, sf_dir)
    return corrective(read(spark, sf_dir, "queries"), read(spark, sf_dir, "chunks"), retrieve=lambda q, c, k: R.point_retrieve(q, c, k, index)).drop("context")


_POINT = rf"""pt AS (SELECT statement_id, vault_id, plain, regexp_extract_all(plain, '\b\d{{4,}}\b') AS ids, regexp_extract_all(plain, '\$(\d+(?:\.\d+)?)', 1) AS amounts FROM (SELECT *, {CLASS_SQL} AS class, {_NORM.format('text')} AS plain FROM s) WHERE class = 'point'),
  tries AS (SELECT statement_id, vault_id, 1 AS attempt, ids[1] AS id FROM pt UNION ALL SELECT statement_id, vault_id, 2, regexp_extract_all(replace(plain, coalesce(ids[1], ''), ''), '\b\d{{4,}}\b')[1] FROM pt),
  words AS (SELECT DISTINCT chunk_id, vault_id, chunk_index, unnest(string_split_regex(content_with_header, '[^A-Za-z0-9-]+')) AS id FROM chunks_v WHERE NOT is_deleted AND status = 'active'),
  hits AS (SELECT DISTINCT statement_id, attempt, chunk_id, chunk_index FROM tries JOIN words USING (vault_id, id)), used AS (SELECT statement_id, min(attempt) AS attempt FROM hits GROUP BY 1),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY chunk_index, chunk_id) AS n FROM hits JOIN used USING (statement_id, attempt)) WHERE n <= 15),
  ctx AS (SELECT statement_id, string_agg({_NORM.format('content_with_header')}, ' ' ORDER BY n) AS seen FROM best JOIN chunks_v USING (chunk_id) GROUP BY 1),
  k AS (SELECT *, vault_id || ':' || sha256({_FINGER.format(_NORM.format('text'))}) AS cache_key FROM statements_v), cached AS (SELECT cache_key, min(statement_id) AS id FROM k GROUP BY 1), fresh AS (SELECT cache_key, CASE WHEN id % 2 = 0 THEN 'supported' ELSE 'unverifiable' END AS verdict FROM cached WHERE id % 600 <= 300),
  judged AS (SELECT statement_id, verdict, 'aggregate_fast' AS verification_path, 0 AS attempts FROM v UNION ALL SELECT statement_id, CASE WHEN seen IS NULL OR len(list_filter(ids, lambda x: contains(seen, x))) = 0 THEN 'unverifiable' WHEN len(amounts) = 0 OR len(list_filter(amounts, lambda x: contains(seen, x))) > 0 THEN 'supported' ELSE 'contradicted' END, 'crag', coalesce(attempt, 2) FROM pt LEFT JOIN ctx USING (statement_id) LEFT JOIN used USING (statement_id))
  SELECT k.statement_id, coalesce(fresh.verdict, judged.verdict) AS verdict, CASE WHEN fresh.verdict IS NOT NULL THEN 0.5::DOUBLE WHEN verification_path = 'crag' THEN CASE WHEN judged.verdict = 'unverifiable' THEN 0.0::DOUBLE ELSE 0.7::DOUBLE END WHEN judged.verdict = 'supported' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE WHEN fresh.verdict IS NULL THEN verification_path ELSE 'cache' END AS verification_path, fresh.verdict IS NOT NULL AS cache_hit, CASE WHEN fresh.verdict IS NULL THEN attempts ELSE 0 END AS attempts FROM k JOIN judged USING (statement_id) LEFT JOIN fresh USING (cache_key)"""


@query(_VERIFY.rsplit("SELECT statement_id, vault_id", 1)[0].replace(cte("statements", "doc_meta"), cte("statements", "doc_meta", "chunks")).rstrip() + ", " + _POINT)
def verify_claims(spark, sf_dir):
    """Every distinct statement was judged before, at a time that follows from its id: about half of the cache is too old."""
    from docspark.operators.verify import verify_claims as run

    statements, now = read(spark, sf_dir, "statements"), F.expr("TIMESTAMP '2024-01-01 00:10:00'")
    keys = statements.select(T.verdict_cache_key(C("vault_id"), F.lit(""), C("text")).alias("cache_key"), "statement_id").groupBy("cache_key").agg(F.min("statement_id").alias("id"))
    cache = keys.select("cache_key", F.when(C("id") % 2 == 0, "supported").otherwise("unverifiable").alias("verdict"), F.lit(0.5).alias("confidence"), F.timestamp_seconds(F.unix_timestamp(now) - C("id") % 600).alias("cached_at"))
    return run(statements, read(spark, sf_dir, "doc_meta"), read(spark, sf_dir, "chunks"), cache=cache, as_of=now)


@query(rf"""{cte('queries', 'chunks')}, n AS (SELECT query_id, vault_id, query_vec, {_NORM.format('trim(query_text)')} AS query_text FROM queries_v), {_dense_sql(40, queries='n')}, {_bm25_sql(40, queries='n')}, {_RRF}, {_mmr1(5, queries='n')},
  c AS (SELECT query_id, string_agg('--- Document Chunk ' || rank + 1 || ' (relevance: ' || format('{{:.3f}}', round(score, 3)) || ') ---' || chr(10) || content_with_header || chr(10), chr(10) ORDER BY rank) AS context, count(DISTINCT regexp_extract(content_with_header, '\[Source:\s*(.+?)\]', 1)) AS n FROM picked JOIN chunks_v USING (chunk_id) GROUP BY 1),
  k AS (SELECT query_id, {CLASS_SQL} AS class FROM (SELECT query_id, query_text AS text, {_NORM.format('lower(query_text)')} AS low FROM n))
  SELECT n.query_id, class AS query_class, 'search' AS route, md5(coalesce(context, 'I couldn''t find relevant information in the vault.')) AS answer, coalesce(c.n, 0) AS n_citations, CASE WHEN context IS NULL THEN 0.0::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM n JOIN k ON k.query_id = n.query_id LEFT JOIN c ON c.query_id = n.query_id""")
def answer_queries(spark, sf_dir):
    from docspark.operators.verify import answer

    return answer(read(spark, sf_dir, "queries"), read(spark, sf_dir, "chunks"), index=index_of(spark, sf_dir)).withColumn("answer", F.md5("answer"))


@query(_VERIFY.rsplit("SELECT statement_id, vault_id", 1)[0].rstrip() + " SELECT statement_id AS query_id, class AS query_class, 'metadata' AS route, md5(explanation) AS answer, 0.8::DOUBLE AS confidence FROM v")
def answer_aggregates(spark, sf_dir):
    """Statements of every class but `point` as questions: these go by metadata."""
    from docspark.operators.verify import answer

    q = read(spark, sf_dir, "statements").select(C("statement_id").alias("query_id"), "vault_id", C("text").alias("query_text"), F.lit(None).cast("array<float>").alias("query_vec"))
    aggregate = q.where(T.classify_query(C("query_text")) != "point")
    return answer(aggregate, read(spark, sf_dir, "chunks"), read(spark, sf_dir, "doc_meta"), index=index_of(spark, sf_dir, "statements")).select("query_id", "query_class", "route", F.md5("answer").alias("answer"), "confidence")


@query(None)
def claim_batches(spark, sf_dir):
    from docspark.streaming.sessions import claim_batches as run

    segments = read(spark, sf_dir, "segments").withColumn("end_s", C("start_s") + 2)
    return run(segments.where("is_final"))


@query(f"""{cte('chunks', 'doc_meta')}, c AS (SELECT chunk_id, doc_id, CASE WHEN chunk_id % 23 <> 5 THEN vault_id END AS vault_id, chunk_index, CASE WHEN chunk_id % 29 <> 6 THEN content END AS content FROM chunks_v UNION ALL SELECT chunk_id, doc_id, vault_id, chunk_index, content FROM chunks_v WHERE doc_id % 31 = 7),
  d AS (SELECT doc_id, bool_or(status IN ('pending_delete', 'deleted') OR deleted_at IS NOT NULL) AS gone FROM doc_meta_v GROUP BY 1),
  e AS (SELECT doc_id, chunk_index, count(*) AS n, count_if(vault_id IS NULL OR chunk_index IS NULL OR content IS NULL) AS lacking FROM c GROUP BY ALL),
  f AS (SELECT doc_id, sum(n)::BIGINT AS n_chunks, max(n) AS most, sum(lacking) AS lacking FROM e GROUP BY 1)
  SELECT f.doc_id, n_chunks, CASE WHEN gone IS NULL THEN 'No such document' WHEN gone THEN 'Deleted during ingestion' WHEN lacking > 0 THEN 'A chunk lacks its vault, index or content' WHEN most > 1 THEN 'Two chunks of one index' ELSE 'stored' END AS outcome FROM f LEFT JOIN d USING (doc_id)""")
def chunk_inserts(spark, sf_dir):
    """Chunks against the documents they belong to; some lack a field, some come twice, some have lost their document."""
    c = read(spark, sf_dir, "chunks").select("chunk_id", "doc_id", "vault_id", "chunk_index", "content")
    broken = c.withColumns({"vault_id": F.when(C("chunk_id") % 23 != 5, C("vault_id")), "content": F.when(C("chunk_id") % 29 != 6, C("content"))})
    good, failed = I.storable(broken.unionByName(c.where(C("doc_id") % 31 == 7)), read(spark, sf_dir, "doc_meta"))
    stored = good.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.lit("stored").alias("outcome"))
    return stored.unionByName(failed.withColumnRenamed("error_message", "outcome"))


def _refusing(prompt: str) -> str:
    if "march" in prompt:
        raise ValueError("too busy")
    return f"said: {prompt}"


@query(f"{cte('segments')} SELECT event_id, CASE WHEN contains(text, 'march') THEN NULL ELSE 'said: ' || text END AS answer, CASE WHEN contains(text, 'march') THEN 'too busy' END AS error, CASE WHEN contains(text, 'march') THEN 4 ELSE 1 END AS attempts FROM segments_v")
def ask_with_retries(spark, sf_dir):
    """A model that never answers some prompts; the pauses between tries are none here."""
    return models.ask(read(spark, sf_dir, "segments").select("event_id", C("text").alias("prompt")), _refusing, delay=0.0).drop("prompt")


@query(f"{cte('turns')} SELECT conv_id, turn, unnest(range(len(w))) AS position, unnest(w) AS piece FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM turns_v WHERE text IS NOT NULL)")
def answer_pieces(spark, sf_dir):
    """A generator that says each turn again, word by word."""
    return models.pieces(read(spark, sf_dir, "turns").select("conv_id", "turn", C("text").alias("prompt")), lambda p: iter(p.split(" "))).select("conv_id", "turn", C("position").cast("long").alias("position"), "piece")


@query(None)
def answer_mixed(spark, sf_dir):
    """All statements at once, of every class; the routes are compared with their own queries in the tests."""
    from docspark.operators.verify import answer

    q = read(spark, sf_dir, "statements").select(C("statement_id").alias("query_id"), "vault_id", C("text").alias("query_text"), F.lit(None).cast("array<float>").alias("query_vec"))
    return answer(q, read(spark, sf_dir, "chunks"), read(spark, sf_dir, "doc_meta"), index=index_of(spark, sf_dir, "statements")).select("query_id", "query_class", "route", F.md5("answer").alias("answer"), "confidence")
