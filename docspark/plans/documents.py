"""Queries over documents, vaults and members, and aggregate answers to statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import aggregates as A
from docspark.operators import documents as D
from docspark.plans.scalars import CLASS_SQL, DESCRIPTION_SQL, FILTERED_SQL, INTENT_SQL, LINE_SQL, MONTH_FIRST_SQL, QUOTE_SQL, _NORM, _PARSED, _Q
from docspark.sources.tables import cte, read

C = F.col
QUERIES, ORACLES = {}, {}
LIVE = "deleted_at IS NULL AND status = 'active'"
_AS_OF = "TIMESTAMP '2001-06-01 00:00:00'"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload attempts from lineitem: some repeat a hash, some have a wrong type or size."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS upload_id", "l_orderkey % 8 AS vault_id", "sha2(cast(l_partkey as string), 256) AS sha256",
        "CASE l_linenumber % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('a_', l_partkey, '.PDF') WHEN 2 THEN concat('b', l_partkey, '.exe') WHEN 3 THEN 'noext' ELSE concat('c.', l_partkey, '.md') END AS filename",
        "CASE WHEN l_suppkey % 9 = 0 THEN 0L ELSE cast(l_quantity as bigint) * 2000000 END AS n_bytes",
    )


_UPLOADS = """uploads_v AS (SELECT l_orderkey * 10 + l_linenumber AS upload_id, l_orderkey % 8 AS vault_id, sha256(l_partkey::VARCHAR) AS sha256,
  CASE l_linenumber % 5 WHEN 0 THEN NULL WHEN 1 THEN 'a_' || l_partkey || '.PDF' WHEN 2 THEN 'b' || l_partkey || '.exe' WHEN 3 THEN 'noext' ELSE 'c.' || l_partkey || '.md' END AS filename,
  CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE l_quantity::BIGINT * 2000000 END AS n_bytes FROM lineitem)"""


@query(f"""WITH {_UPLOADS} SELECT upload_id, filename, n_bytes, extension, CASE WHEN filename IS NULL THEN 'Filename is required' WHEN extension NOT IN ('pdf', 'txt', 'md') THEN 'Unsupported file type' WHEN n_bytes = 0 THEN 'File is empty' WHEN n_bytes > 52428800 THEN 'File exceeds 50MB limit' END AS reject_reason,
  concat_ws('/', vault_id::VARCHAR, sha256, filename) AS storage_path FROM (SELECT *, CASE WHEN contains(filename, '.') THEN lower(string_split(filename, '.')[-1]) ELSE '' END AS extension FROM uploads_v)""")
def upload_admission(spark, sf_dir):
    return D.upload_admission(_uploads(spark, sf_dir)).select("upload_id", "filename", "n_bytes", "extension", "reject_reason", "storage_path")


@query(f"""WITH {_UPLOADS}, stored AS (SELECT p_partkey AS doc_id, p_partkey % 8 AS vault_id, sha256(p_partkey::VARCHAR) AS sha256, p_partkey % 3 = 0 AS gone FROM part),
  kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vault_id, sha256 ORDER BY upload_id) AS n FROM uploads_v) u WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.vault_id = u.vault_id AND s.sha256 = u.sha256 AND NOT gone))
  SELECT 'kept' AS what, upload_id AS id FROM kept UNION ALL SELECT 'purged', doc_id FROM stored s WHERE gone AND EXISTS (SELECT 1 FROM kept k WHERE s.vault_id = k.vault_id AND s.sha256 = k.sha256)""")
def upload_dedup(spark, sf_dir):
    stored = read(spark, sf_dir, "part").selectExpr("p_partkey AS doc_id", "p_partkey % 8 AS vault_id", "sha2(cast(p_partkey as string), 256) AS sha256", "CASE WHEN p_partkey % 3 = 0 THEN current_date() END AS deleted_at")
    kept, purged = D.upload_dedup(_uploads(spark, sf_dir), stored)
    return kept.select(F.lit("kept").alias("what"), C("upload_id").alias("id")).unionByName(purged.select(F.lit("purged").alias("what"), C("doc_id").alias("id")))


@query(f"{cte('chunks')} SELECT chunk_id, vault_id FROM chunks_v WHERE NOT is_deleted AND status = 'active' AND embedding IS NOT NULL")
def live_chunks(spark, sf_dir):
    return read(spark, sf_dir, "chunks").where(~C("is_deleted") & (C("status") == "active") & C("embedding").isNotNull()).select("chunk_id", "vault_id")


@query(f"{cte('doc_meta')} SELECT doc_id, original_filename, total_price FROM doc_meta_v WHERE {LIVE} AND document_type = 'invoice' AND order_date BETWEEN DATE '2012-01-01' AND DATE '2013-12-31' AND customer_id ILIKE 'mach%'")
def filter_documents(spark, sf_dir):
    day = lambda x: F.lit(x).cast("date")
    docs = read(spark, sf_dir, "doc_meta").where(D.is_live())
    return docs.where(D.matches(F.lit("invoice"), day("2012-01-01"), day("2013-12-31"), F.lit("MACH%"))).select("doc_id", "original_filename", "total_price")


@query(f"""{cte('statements', 'doc_meta')}, f AS (SELECT DISTINCT vault_id, doc_type, date_from, date_to FROM (SELECT *, {MONTH_FIRST_SQL} FROM {_PARSED}) WHERE doc_type IS NOT NULL OR date_from IS NOT NULL)
  SELECT f.vault_id, f.doc_type, f.date_from, f.date_to, count(*) AS n_docs, min(doc_id) AS first_doc FROM f JOIN doc_meta_v d ON d.vault_id = f.vault_id AND deleted_at IS NULL AND (f.doc_type IS NULL OR d.document_type = f.doc_type) AND (f.date_from IS NULL OR d.order_date BETWEEN f.date_from AND f.date_to) GROUP BY ALL""")
def sql_metadata_filter(spark, sf_dir):
    keys = ["vault_id", "doc_type", "date_from", "date_to"]
    f = A.parse(read(spark, sf_dir, "statements"), month_first=True).where("doc_type is not null or date_from is not null").select(*keys).distinct().alias("f")
    d = read(spark, sf_dir, "doc_meta").where(D.is_live(active=False)).alias("d")
    on = (C("d.vault_id") == C("f.vault_id")) & (C("doc_type").isNull() | (C("document_type") == C("doc_type"))) & (C("date_from").isNull() | C("order_date").between(C("date_from"), C("date_to")))
    return f.join(d, on).groupBy("f.vault_id", *keys[1:]).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query(f"{cte('doc_meta')} SELECT doc_id, original_filename FROM doc_meta_v WHERE deleted_at IS NULL AND original_filename ILIKE '%ORDER_1%' ESCAPE '\\' AND contains(lower(original_filename), 'order_1')")
def search_documents_by_name(spark, sf_dir):
    return read(spark, sf_dir, "doc_meta").where(D.is_live(active=False) & F.lower("original_filename").contains("order_1")).select("doc_id", "original_filename")


@query(f"{cte('vaults', 'sessions')} SELECT session_id, title, v.name AS vault_name FROM sessions_v s JOIN vaults_v v USING (vault_id) WHERE contains(lower(title), 'build') OR contains(lower(v.name), 'build')")
def search_sessions(spark, sf_dir):
    joined = read(spark, sf_dir, "sessions").join(read(spark, sf_dir, "vaults").select("vault_id", C("name").alias("vault_name")), "vault_id")
    return joined.where(F.lower("title").contains("build") | F.lower("vault_name").contains("build")).select("session_id", "title", "vault_name")


@query(f"""{cte('doc_meta', 'vaults')}, e AS (SELECT l_orderkey * 3 AS doc_id, l_orderkey % 31 AS vault_id, l_partkey AS storage_path, l_orderkey * 10 + l_linenumber AS event_id FROM lineitem)
  SELECT event_id, CASE WHEN d.doc_id IS NULL THEN 'orphan' WHEN d.status = 'active' THEN 'already_active' WHEN d.status IN ('pending_delete', 'deleted') OR deleted_at IS NOT NULL THEN 'deleted' WHEN NOT coalesce(v.is_active, false) THEN 'vault_inactive' WHEN p.p_partkey IS NULL THEN 'file_missing' ELSE 'admit' END AS outcome
  FROM e LEFT JOIN doc_meta_v d ON d.doc_id = e.doc_id LEFT JOIN vaults_v v ON v.vault_id = e.vault_id LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) p ON p.p_partkey = e.storage_path""")
def admit_upload_events(spark, sf_dir):
    events = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 3 AS doc_id", "l_orderkey % 31 AS vault_id", "l_partkey AS storage_path", "l_orderkey * 10 + l_linenumber AS event_id")
    files = read(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(C("p_partkey").alias("storage_path"))
    return D.admit_upload_events(events, read(spark, sf_dir, "doc_meta"), read(spark, sf_dir, "vaults"), files).select("event_id", "outcome")


@query(f"{cte('doc_meta')} SELECT doc_id, vault_id, original_filename, status FROM doc_meta_v WHERE status IN ('pending', 'ingesting') AND updated_at < {_AS_OF} - INTERVAL 5 MINUTES AND deleted_at IS NULL")
def recover_stuck(spark, sf_dir):
    return D.recover_stuck(read(spark, sf_dir, "doc_meta"), F.expr(_AS_OF)).select("doc_id", "vault_id", "original_filename", "status")


@query(f"""{cte('vaults', 'vault_members')}, r AS (SELECT o_orderkey, o_orderkey % 30 AS vault_id, o_custkey AS user_id, CASE o_orderkey % 3 WHEN 0 THEN 'viewer' WHEN 1 THEN 'editor' ELSE 'owner' END AS min_role FROM orders)
  SELECT o_orderkey, CASE WHEN v.vault_id IS NULL THEN 'not_found' WHEN m.role IS NULL THEN 'not_member' WHEN (CASE m.role WHEN 'owner' THEN 3 WHEN 'editor' THEN 2 WHEN 'viewer' THEN 1 ELSE 0 END) < (CASE min_role WHEN 'owner' THEN 3 WHEN 'editor' THEN 2 ELSE 1 END) THEN 'insufficient' ELSE 'ok' END AS outcome
  FROM r LEFT JOIN vaults_v v ON v.vault_id = r.vault_id AND v.is_active LEFT JOIN vault_members_v m ON m.vault_id = r.vault_id AND m.user_id = r.user_id""")
def vault_access(spark, sf_dir):
    requests = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 30 AS vault_id", "o_custkey AS user_id", "CASE o_orderkey % 3 WHEN 0 THEN 'viewer' WHEN 1 THEN 'editor' ELSE 'owner' END AS min_role")
    return D.vault_access(requests, read(spark, sf_dir, "vaults"), read(spark, sf_dir, "vault_members")).select("o_orderkey", "outcome")


_HISTORY_SIZE = "count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""{cte('turns')}, h AS (SELECT *, {_HISTORY_SIZE} AS history FROM turns_v), v AS (SELECT conv_id, turn, concat_ws(', ', CASE WHEN coalesce(length(trim(text)), 0) NOT BETWEEN 1 AND 2000 THEN 'query' END, CASE WHEN 1 + turn % 25 > 20 THEN 'top_k' END, CASE WHEN role IS NULL OR role NOT IN ('user', 'assistant') THEN 'role' END, CASE WHEN history > 50 THEN 'history' END) AS violation FROM h)
  SELECT conv_id, turn, violation = '' AS is_valid, violation FROM v""")
def validate_queries(spark, sf_dir):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = read(spark, sf_dir, "turns").withColumn("history", F.count("*").over(before))
    violation = D.violations(D.query_checks(C("text"), 1 + C("turn") % 25, C("role"), C("history")))
    return turns.select("conv_id", "turn", (violation == "").alias("is_valid"), violation.alias("violation"))


@query(f"""{cte('vaults', 'sessions')} SELECT 'vault' AS what, vault_id AS id, length(trim(name)) BETWEEN 1 AND 255 AS is_valid FROM vaults_v UNION ALL SELECT 'session', session_id, length(trim(title)) BETWEEN 1 AND 40 FROM sessions_v""")
def validate_names(spark, sf_dir):
    """Names of vaults, and titles of sessions with a lower limit of 40, which some exceed."""
    one = lambda df, what, key, name, most=255: df.select(F.lit(what).alias("what"), C(key).alias("id"), D.name_check(C(name), most).alias("is_valid"))
    return one(read(spark, sf_dir, "vaults"), "vault", "vault_id", "name").unionByName(one(read(spark, sf_dir, "sessions"), "session", "session_id", "title", 40))


@query(f"{cte('chunks', 'doc_meta')} SELECT chunk_id, original_filename, d.status AS doc_status FROM chunks_v c JOIN doc_meta_v d USING (doc_id)")
def chunks_with_docs(spark, sf_dir):
    docs = read(spark, sf_dir, "doc_meta").select("doc_id", "original_filename", C("status").alias("doc_status"))
    return read(spark, sf_dir, "chunks").join(docs, "doc_id").select("chunk_id", "original_filename", "doc_status")


@query(f"{cte('vaults', 'vault_members')} SELECT user_id, vault_id, name, role FROM vaults_v JOIN vault_members_v USING (vault_id) WHERE is_active")
def vault_list(spark, sf_dir):
    return read(spark, sf_dir, "vaults").where("is_active").join(read(spark, sf_dir, "vault_members"), "vault_id").select("user_id", "vault_id", "name", "role")


@query(f"{cte('chunks', 'doc_meta')} SELECT chunk_id FROM chunks_v WHERE NOT is_deleted AND doc_id IN (SELECT doc_id FROM doc_meta_v WHERE {LIVE} AND document_type = 'invoice')")
def chunks_of_matched_docs(spark, sf_dir):
    found = read(spark, sf_dir, "doc_meta").where(D.is_live() & (C("document_type") == "invoice")).select("doc_id")
    return read(spark, sf_dir, "chunks").where("not is_deleted").join(found, "doc_id", "left_semi").select("chunk_id")


@query(f"""{cte('doc_meta', 'chunks')}, first AS (SELECT doc_id, content_with_header FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, chunk_id) AS n FROM chunks_v WHERE NOT is_deleted) WHERE n = 1)
  SELECT d.doc_id, original_filename AS doc_title, md5(coalesce(f.content_with_header, {QUOTE_SQL})) AS quote FROM doc_meta_v d LEFT JOIN first f ON f.doc_id = d.doc_id WHERE {LIVE}""")
def aggregate_evidence(spark, sf_dir):
    first = read(spark, sf_dir, "chunks").where("not is_deleted").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id"))).where("n = 1").select("doc_id", "content_with_header")
    quote = T.metadata_quote(*[C(c) for c in ("original_filename", "document_type", "entity_id", "order_date", "customer_id", "total_price")])
    return read(spark, sf_dir, "doc_meta").where(D.is_live()).join(first, "doc_id", "left").select("doc_id", C("original_filename").alias("doc_title"), F.md5(F.coalesce("content_with_header", quote)).alias("quote"))


_TOTALS = f"""f AS (SELECT DISTINCT vault_id, doc_type, date_from, date_to, customer FROM {FILTERED_SQL}),
  totals AS (SELECT f.*, count(d.doc_id) FILTER (f.date_from IS NULL OR d.order_date BETWEEN f.date_from AND f.date_to) AS doc_count, sum(d.total_price::DECIMAL(18, 2)) FILTER (f.date_from IS NULL OR d.order_date BETWEEN f.date_from AND f.date_to)::DOUBLE AS sum_total,
    count(d.doc_id) FILTER (d.order_date IS NULL) AS undated, count(d.doc_id) FILTER ((f.date_from IS NULL OR d.order_date BETWEEN f.date_from AND f.date_to) AND d.total_price IS NULL) AS unpriced
  FROM f LEFT JOIN (SELECT * FROM doc_meta_v WHERE {LIVE}) d ON d.vault_id = f.vault_id AND (f.doc_type IS NULL OR d.document_type = f.doc_type) AND (f.customer IS NULL OR lower(d.customer_id) LIKE lower(f.customer)) GROUP BY ALL)"""
_SAME = "s.vault_id = t.vault_id AND s.doc_type IS NOT DISTINCT FROM t.doc_type AND s.date_from IS NOT DISTINCT FROM t.date_from AND s.customer IS NOT DISTINCT FROM t.customer"
_STATED = f"s AS (SELECT *, {_NORM.format('lower(text)')} AS low FROM {FILTERED_SQL})"


def _answered(column: str, sql: str):
    def run(spark, sf_dir):
        t = A.with_totals(A.parse(read(spark, sf_dir, "statements")), read(spark, sf_dir, "doc_meta"))
        return t.select("statement_id", F.round(column, 6).alias(column) if "count" not in column else C(column))

    name = {"doc_count": "agg_count", "sum_total": "agg_sum", "average_total": "agg_average"}[column]
    QUERIES[name] = run
    ORACLES[name] = f"{cte('statements', 'doc_meta')}, {_TOTALS}, {_STATED} SELECT statement_id, {sql} AS {column} FROM s JOIN totals t ON {_SAME}"


_answered("doc_count", "doc_count")
_answered("sum_total", "round(sum_total, 6)")
_answered("average_total", "round(CASE WHEN doc_count > 0 THEN sum_total / doc_count END, 6)")


@query(f"{cte('statements', 'doc_meta')}, {_TOTALS}, {_STATED} SELECT statement_id, {INTENT_SQL} AS intent, undated AS missing_dates, CASE WHEN {INTENT_SQL} IN ('sum', 'average') THEN unpriced ELSE 0 END AS missing_totals FROM s JOIN totals t ON {_SAME} WHERE s.date_from IS NOT NULL")
def metadata_gaps(spark, sf_dir):
    t = A.with_totals(A.parse(read(spark, sf_dir, "statements")), read(spark, sf_dir, "doc_meta")).where("date_from is not null")
    return t.select("statement_id", "intent", C("undated").alias("missing_dates"), F.when(C("intent").isin("sum", "average"), C("unpriced")).otherwise(0).alias("missing_totals"))


@query(f"{cte('statements', 'doc_meta')}, {_TOTALS} SELECT vault_id, doc_type, date_from, date_to, customer, doc_count FROM totals")
def statement_documents(spark, sf_dir):
    return A.filter_totals(A.parse(read(spark, sf_dir, "statements")), read(spark, sf_dir, "doc_meta")).select(*A.FILTERS, "doc_count")


_LISTED = f"""listed AS (SELECT * FROM (SELECT f.*, d.* EXCLUDE (vault_id), row_number() OVER (PARTITION BY f.vault_id, f.doc_type, f.date_from, f.customer ORDER BY d.order_date NULLS LAST, d.entity_id NULLS LAST, d.original_filename NULLS LAST, d.doc_id) AS position
  FROM f JOIN (SELECT * FROM doc_meta_v WHERE {LIVE}) d ON d.vault_id = f.vault_id AND (f.doc_type IS NULL OR d.document_type = f.doc_type) AND (f.date_from IS NULL OR d.order_date BETWEEN f.date_from AND f.date_to) AND (f.customer IS NULL OR lower(d.customer_id) LIKE lower(f.customer))) WHERE position <= 50)"""


@query(f"{cte('statements', 'doc_meta')}, {_TOTALS}, {_LISTED} SELECT vault_id, doc_type, date_from, customer, position, doc_id FROM listed")
def aggregate_listing(spark, sf_dir):
    return A.listings(A.parse(read(spark, sf_dir, "statements")), read(spark, sf_dir, "doc_meta")).select("vault_id", "doc_type", "date_from", "customer", "position", "doc_id")


@query(f"{cte('statements', 'doc_meta')}, {_TOTALS}, {_LISTED} SELECT s.vault_id, s.doc_type, s.date_from, s.customer, doc_count, count(*) AS shown, round(sum(total_price), 2) AS grand_total FROM listed s JOIN totals t ON {_SAME} GROUP BY ALL")
def filter_summary(spark, sf_dir):
    parsed, docs = A.parse(read(spark, sf_dir, "statements")), read(spark, sf_dir, "doc_meta")
    keys = ["vault_id", "doc_type", "date_from", "customer"]
    shown = A.listings(parsed, docs).groupBy(*[C(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("shown"), F.round(F.sum("total_price"), 2).alias("grand_total"))
    t = A.filter_totals(parsed, docs)
    return t.join(shown, [t[k].eqNullSafe(shown[f"_{k}"]) for k in keys]).select(*keys, "doc_count", "shown", "grand_total")


@query(f"{cte('doc_meta')} SELECT vault_id, coalesce(document_type, 'unknown') AS document_type, count(*) AS doc_count FROM doc_meta_v WHERE {LIVE} GROUP BY ALL")
def type_inventory(spark, sf_dir):
    return A.type_inventory(read(spark, sf_dir, "doc_meta"))


_INVENTORY = f"inv AS (SELECT vault_id, 'Available document types in this vault:' || chr(10) || string_agg('- ' || t || ': ' || n, chr(10) ORDER BY t) AS inventory FROM (SELECT vault_id, coalesce(document_type, 'unknown') AS t, count(*) AS n FROM doc_meta_v WHERE {LIVE} GROUP BY ALL) GROUP BY 1)"
_FORMAT = "'$' || format('{:,.2f}', "
_VERIFY = f"""{cte('statements', 'doc_meta')}, {_TOTALS}, {_STATED}, {_LISTED}, {_INVENTORY},
  lines AS (SELECT vault_id, doc_type, date_from, customer, string_agg(position || '. ' || {LINE_SQL}, chr(10) ORDER BY position) AS lines FROM listed GROUP BY ALL),
  a AS (SELECT s.*, {INTENT_SQL} AS intent, {CLASS_SQL} AS class, {DESCRIPTION_SQL.replace('doc_type', 's.doc_type').replace('date_from', 's.date_from').replace('date_to', 's.date_to').replace('customer)', 's.customer)').replace('customer IS NULL', 's.customer IS NULL')} AS described, t.doc_count, t.sum_total, t.undated, t.unpriced, l.lines, inv.inventory
    FROM s JOIN totals t ON {_SAME} LEFT JOIN lines l ON l.vault_id = s.vault_id AND l.doc_type IS NOT DISTINCT FROM s.doc_type AND l.date_from IS NOT DISTINCT FROM s.date_from AND l.customer IS NOT DISTINCT FROM s.customer LEFT JOIN inv ON inv.vault_id = s.vault_id),
  b AS (SELECT *, doc_type IS NULL AND date_from IS NULL AND customer IS NULL AS bare, intent IN ('sum', 'average') AS money, regexp_matches(lower(text), {_Q(T.INVENTORY)}) AS asks,
    concat_ws(chr(10), CASE WHEN date_from IS NOT NULL AND undated > 0 THEN '- ' || undated || ' document(s) missing order date metadata' END, CASE WHEN intent IN ('sum', 'average') AND unpriced > 0 THEN '- ' || unpriced || ' document(s) missing total price metadata' END) AS gaps FROM a WHERE class <> 'point'),
  v AS (SELECT *, CASE WHEN bare AND asks AND inventory IS NOT NULL THEN 'supported' WHEN bare OR gaps <> '' THEN 'unverifiable' WHEN doc_count = 0 THEN 'supported' WHEN money AND sum_total IS NULL THEN 'unverifiable' ELSE 'supported' END AS verdict,
    CASE WHEN bare AND asks THEN coalesce(inventory, 'No documents found in the vault.') WHEN bare THEN 'No structured filters could be parsed from the statement.'
      WHEN gaps <> '' THEN 'Cannot verify an exact result for: ' || described || '.' || chr(10) || 'Missing metadata:' || chr(10) || gaps || chr(10) || 'Re-ingest documents or run metadata backfill to fill the gaps.'
      WHEN doc_count = 0 THEN 'No documents found matching: ' || described || '.' || chr(10) || 'Count: 0' WHEN money AND sum_total IS NULL THEN 'One or more documents are missing total prices for this query.'
      ELSE concat_ws(chr(10), 'Found ' || doc_count || ' documents matching: ' || described, CASE intent WHEN 'average' THEN 'Average Total: ' || {_FORMAT}sum_total / doc_count) WHEN 'sum' THEN 'Total Sum: ' || {_FORMAT}sum_total) END, 'Count: ' || doc_count, chr(10) || 'Documents:', lines, CASE WHEN doc_count > 50 THEN '... (showing first 50 of ' || doc_count || ')' END) END AS explanation FROM b)
  SELECT statement_id, vault_id, intent, verdict, CASE WHEN verdict = 'supported' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence, explanation FROM v"""


@query(_VERIFY)
def verify_aggregate(spark, sf_dir):
    return A.verify(read(spark, sf_dir, "statements"), read(spark, sf_dir, "doc_meta"))


@query(f"""{cte('statements', 'doc_meta')}, {_STATED} SELECT vault_id, route, count(*) AS n, min(statement_id) AS first_statement FROM (SELECT *, CASE WHEN {CLASS_SQL} = 'point' THEN 'retrieve' ELSE 'aggregate_fast' END AS route FROM s) GROUP BY ALL""")
def route_statements(spark, sf_dir):
    route = F.when(T.classify_query(C("text")) == "point", "retrieve").otherwise("aggregate_fast")
    return read(spark, sf_dir, "statements").withColumn("route", route).groupBy("vault_id", "route").agg(F.count("*").alias("n"), F.min("statement_id").alias("first_statement"))


@query(f"""{cte('doc_meta')}, t AS (SELECT vault_id, document_type, count(*) AS n FROM doc_meta_v WHERE {LIVE} AND document_type IS NOT NULL GROUP BY ALL)
  SELECT vault_id, 'No documents found matching: all documents.' || chr(10) || 'Available document types in this vault: ' || string_agg(document_type || ' (' || n || ')', ', ' ORDER BY document_type) AS message FROM t GROUP BY vault_id""")
def no_results_message(spark, sf_dir):
    t = A.type_inventory(read(spark, sf_dir, "doc_meta").where("document_type is not null"))
    each = F.concat("document_type", F.lit(" ("), C("doc_count").cast("string"), F.lit(")"))
    return t.groupBy("vault_id").agg(F.concat(F.lit("No documents found matching: all documents.\nAvailable document types in this vault: "), F.array_join(F.sort_array(F.collect_list(each)), ", ")).alias("message"))


@query(f"""{cte('vaults', 'doc_meta')} SELECT v.vault_id, name, count(d.doc_id) AS document_count, greatest(v.updated_at, coalesce(max(d.updated_at), v.updated_at)) AS updated_at FROM vaults_v v LEFT JOIN (SELECT * FROM doc_meta_v WHERE deleted_at IS NULL) d ON d.vault_id = v.vault_id GROUP BY v.vault_id, name, v.updated_at""")
def vault_stats(spark, sf_dir):
    return D.vault_stats(read(spark, sf_dir, "vaults"), read(spark, sf_dir, "doc_meta")).select("vault_id", "name", "document_count", "updated_at")


@query(f"""{cte('vaults', 'doc_meta')}, s AS (SELECT v.vault_id, name, count(d.doc_id) AS n, greatest(v.updated_at, coalesce(max(d.updated_at), v.updated_at)) AS changed FROM vaults_v v LEFT JOIN (SELECT * FROM doc_meta_v WHERE deleted_at IS NULL) d ON d.vault_id = v.vault_id GROUP BY v.vault_id, name, v.updated_at)
  SELECT count(*) AS vault_count, sum(n)::BIGINT AS total_documents, (SELECT name FROM s ORDER BY n DESC, vault_id LIMIT 1) AS largest_vault, (SELECT name FROM s ORDER BY changed DESC, vault_id LIMIT 1) AS latest_vault FROM s""")
def dashboard(spark, sf_dir):
    return D.dashboard(D.vault_stats(read(spark, sf_dir, "vaults"), read(spark, sf_dir, "doc_meta")))


@query(f"{cte('doc_meta')} SELECT vault_id, bool_or(status IN ('pending', 'ingesting')) AS has_pending FROM doc_meta_v WHERE deleted_at IS NULL GROUP BY 1")
def vault_has_pending(spark, sf_dir):
    return read(spark, sf_dir, "doc_meta").where("deleted_at is null").groupBy("vault_id").agg(F.bool_or(C("status").isin("pending", "ingesting")).alias("has_pending"))


@query(f"""{cte('doc_meta')}, n AS (SELECT *, row_number() OVER (PARTITION BY vault_id ORDER BY original_filename, doc_id) AS position, count(*) OVER (PARTITION BY vault_id) AS total FROM doc_meta_v WHERE deleted_at IS NULL)
  SELECT vault_id, position, doc_id, total FROM n WHERE position > 200 AND position <= 400""")
def page_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "doc_meta").where("deleted_at is null")
    return D.page(docs, [C("original_filename"), C("doc_id")], 500, 200, by="vault_id").select("vault_id", "position", "doc_id", "total")


@query(f"""{cte('doc_meta')}, n AS (SELECT *, row_number() OVER (PARTITION BY vault_id ORDER BY doc_id) AS position, count(*) OVER (PARTITION BY vault_id) AS total FROM doc_meta_v)
  SELECT vault_id, doc_id, greatest(1, ceil(total / 25))::BIGINT AS pages, ceil(position / 25)::BIGINT AS page FROM n WHERE ceil(position / 25) = greatest(1, least(7, ceil(total / 25)))""")
def paginate(spark, sf_dir):
    docs, n = read(spark, sf_dir, "doc_meta"), F.row_number().over(Window.partitionBy("vault_id").orderBy("doc_id"))
    pages = docs.groupBy("vault_id").agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.count("*") / 25)).alias("pages"))
    return docs.withColumn("page", F.ceil(n / 25)).join(pages, "vault_id").where(C("page") == F.greatest(F.lit(1).cast("long"), F.least(F.lit(7).cast("long"), "pages"))).select("vault_id", "doc_id", "pages", "page")


@query(f"""{cte('doc_meta')}, e AS (SELECT o_orderkey AS doc_id, min(l_shipdate) AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1)
  SELECT d.doc_id, CASE WHEN e.at IS NOT NULL AND deleted_at IS NULL THEN 'deleted' ELSE status END AS status, CASE WHEN e.at IS NOT NULL AND deleted_at IS NULL THEN e.at ELSE deleted_at END AS deleted_at FROM doc_meta_v d LEFT JOIN e USING (doc_id)""")
def apply_deletes(spark, sf_dir):
    return D.apply_deletes(read(spark, sf_dir, "doc_meta"), _delete_events(spark, sf_dir)).select("doc_id", "status", "deleted_at")


def _delete_events(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(C("l_orderkey").alias("doc_id"), C("l_shipdate").cast("timestamp").alias("at"))


_HIT = "e AS (SELECT l_orderkey AS doc_id, min(l_shipdate)::TIMESTAMP AS at FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), hit AS (SELECT d.doc_id, d.vault_id, e.at FROM doc_meta_v d JOIN e USING (doc_id) WHERE deleted_at IS NULL)"


@query(f"{cte('doc_meta', 'chunks')}, {_HIT} SELECT chunk_id, is_deleted OR h.doc_id IS NOT NULL AS is_deleted FROM chunks_v c LEFT JOIN hit h ON h.doc_id = c.doc_id")
def delete_chunks(spark, sf_dir):
    hit = D.deletions(read(spark, sf_dir, "doc_meta"), _delete_events(spark, sf_dir))
    return D.delete_chunks(read(spark, sf_dir, "chunks"), hit).select("chunk_id", "is_deleted")


@query(f"{cte('doc_meta', 'vaults')}, {_HIT} SELECT v.vault_id, greatest(v.updated_at, coalesce(max(h.at), v.updated_at)) AS updated_at FROM vaults_v v LEFT JOIN hit h ON h.vault_id = v.vault_id GROUP BY v.vault_id, v.updated_at")
def touch_vaults(spark, sf_dir):
    hit = D.deletions(read(spark, sf_dir, "doc_meta"), _delete_events(spark, sf_dir))
    return D.touch_vaults(read(spark, sf_dir, "vaults"), hit).select("vault_id", "updated_at")


@query(f"""{cte('doc_meta')} SELECT d.doc_id, CASE WHEN status IN ('pending', 'ingesting') AND deleted_at IS NULL AND p.doc_id IS NOT NULL THEN CASE WHEN trim(coalesce(p.text, '')) = '' THEN 'failed' ELSE 'active' END ELSE status END AS status
  FROM doc_meta_v d LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE text END AS text FROM documents) p ON p.doc_id = d.doc_id""")
def ingest_outcomes(spark, sf_dir):
    parsed = read(spark, sf_dir, "documents").select("doc_id", F.when(C("doc_id") % 7 == 0, " ").otherwise(C("text")).alias("text"))
    return D.ingest_outcomes(read(spark, sf_dir, "doc_meta"), parsed).select("doc_id", "status")


@query(f"{cte('chunks')} SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (is_deleted) AS n_deleted FROM chunks_v GROUP BY 1")
def chunk_counts(spark, sf_dir):
    return read(spark, sf_dir, "chunks").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count_if("is_deleted").alias("n_deleted"))


@query("SELECT l_orderkey, sum(l_quantity) AS total, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(abs(min(l_discount) - max(l_tax)), 4) AS gap, list_sort(list(l_quantity::INT)) AS ordered FROM lineitem GROUP BY 1")
def compute_reducers(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(C("l_quantity").cast("int")))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"), F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.round(F.abs(F.min("l_discount") - F.max("l_tax")), 4).alias("gap"), ordered.alias("ordered"))


@query(f"{cte('chunks')} SELECT c.doc_id, CASE WHEN status <> 'active' OR is_deleted THEN 409 ELSE 200 END AS code, CASE WHEN status = 'active' AND NOT is_deleted THEN md5(content) END AS content, CASE WHEN status = 'active' AND NOT is_deleted THEN length(content) END AS n_chars FROM chunks_v c")
def document_content(spark, sf_dir):
    ready = (C("status") == "active") & ~C("is_deleted")
    return read(spark, sf_dir, "chunks").select("doc_id", F.when(ready, 200).otherwise(409).alias("code"), F.when(ready, F.md5("content")).alias("content"), F.when(ready, F.char_length("content")).alias("n_chars"))
