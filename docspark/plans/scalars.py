"""Queries that apply a text function to every row of a table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.sources.tables import cte, read

C = F.col
_MONTHS = T.MONTHS
_AS_OF = "TIMESTAMP '2024-03-01 00:00:00'"


def _sql_first(pairs: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + " END"


_Q = lambda s: "'" + s.replace("'", "''") + "'"
_LOW = "lower(text)"
_NORM = r"regexp_replace({0}, '(\d),(\d)', '\1\2', 'g')"
_FINGER = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"
_TYPE = _sql_first([(" OR ".join(f"contains({_LOW}, {_Q(w)})" for w in words), _Q(kind)) for kind, words in T.TYPE_WORDS])
_YEAR = r"nullif(regexp_extract(lower(text), '\b(20\d{2})\b', 1), '')::INT"
_MONTH = _sql_first([(f"contains({_LOW}, '{m[:3]}')", str(i)) for i, m in enumerate(_MONTHS, 1)])
_QUARTER = r"nullif(regexp_extract(lower(text), '\bq([1-4])\b', 1), '')::INT"
_CUSTOMER = rf"(SELECT CASE WHEN x <> '' AND x NOT IN ({', '.join(map(_Q, T.SKIPPED_IDS))}) THEN x END FROM (SELECT regexp_extract(text, '\b([A-Z]{{3,10}})\b', 1) AS x))"
_PARSED = f"(SELECT *, {_YEAR} AS y, {_MONTH} AS m, {_QUARTER} AS q, {_TYPE} AS doc_type, {_CUSTOMER} AS customer FROM statements_v)"
_RANGE = "CASE WHEN y IS NULL THEN NULL ELSE make_date(y, coalesce({0}, {1}, 1), 1) END AS date_from, CASE WHEN y IS NULL THEN NULL ELSE last_day(make_date(y, CASE WHEN {0} IS NOT NULL THEN {0} + {2} WHEN {1} IS NOT NULL THEN {1} + {3} ELSE 12 END, 1)) END AS date_to"
RANGE_SQL = _RANGE.format("((q - 1) * 3 + 1)", "m", 2, 0)
MONTH_FIRST_SQL = _RANGE.format("m", "((q - 1) * 3 + 1)", 0, 2)
FILTERED_SQL = f"(SELECT *, {RANGE_SQL} FROM {_PARSED})"
DESCRIPTION_SQL = """CASE WHEN doc_type IS NULL AND date_from IS NULL AND customer IS NULL THEN 'all documents' ELSE concat_ws(', ', 'type=' || replace(doc_type, '_', ' '),
  CASE WHEN month(date_from) = month(date_to) AND year(date_from) = year(date_to) THEN 'date=' || strftime(date_from, '%B %Y') WHEN date_from IS NOT NULL THEN 'date=' || date_from::VARCHAR || ' to ' || date_to::VARCHAR END, 'customer=' || customer) END"""
_AGG = " OR ".join(f"regexp_matches(low, {_Q(p)})" for p in T.AGGREGATE_PATTERNS)
CLASS_SQL = f"""CASE WHEN NOT ({_AGG}) OR regexp_matches(low, {_Q(T.STRONG_POINT)}) OR (NOT regexp_matches(low, {_Q(T.MANY_DOCUMENTS)}) AND (regexp_matches(low, {_Q(T.WEAK_POINT)}) OR regexp_matches(text, {_Q(T.PROPER_NAME)}))) THEN 'point'
  WHEN regexp_matches(low, {_Q(T.COMPUTE)}) THEN 'compute' ELSE 'aggregate' END"""
INTENT_SQL = f"CASE WHEN regexp_matches(low, {_Q(T.COUNT)}) THEN 'count' WHEN regexp_matches(low, {_Q(T.AVERAGE)}) THEN 'average' WHEN regexp_matches(low, {_Q(T.COMPUTE)}) THEN 'sum' ELSE 'list' END"
ANCHOR_SQL = f"(regexp_matches(text, {_Q(T.ANCHOR_NUMBER)}) OR regexp_matches(text, {_Q(T.ANCHOR_MONEY)}) OR regexp_matches(lower(text), {_Q(T.ANCHOR_WORDS)}))"
_DISC = "(w IN ({0}) OR regexp_matches(w, '^q[1-4]$') OR regexp_matches(w, '^\\d{{3,}}$') OR (regexp_matches(w, '^\\p{{L}}{{4,}}$') AND w NOT IN ({1})))".format(", ".join(_Q(w) for m in _MONTHS for w in (m, m[:3])), ", ".join(map(_Q, T.COMMON_WORDS)))
_IDS_SQL = f"(regexp_extract_all(text, {_Q(T.NAMED_ID)}, 1) || regexp_extract_all(text, {_Q(T.ANCHOR_NUMBER)}))"
_ONCE = "list_sort(list_distinct({0}))"
_ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
BAG_SQL = f"list_sort(list_distinct(flatten(list_transform(string_split({_FINGER.format('text')}, ' '), lambda w: CASE WHEN {_DISC} THEN [w, w || '__1', w || '__2'] ELSE [w] END))))"
_LINE = "{0} || CASE WHEN order_date IS NULL AND customer_id IS NULL AND total_price IS NULL AND entity_id IS NULL THEN '' ELSE ' — ' || concat_ws(', ', 'Date: ' || order_date::VARCHAR, 'Customer: ' || customer_id, 'Total: $' || format('{{:,.2f}}', total_price), 'ID: ' || entity_id) END"
LINE_SQL = _LINE.format("original_filename")
QUOTE_SQL = "concat_ws(chr(10), 'Document: ' || original_filename, 'Type: ' || document_type, 'ID: ' || entity_id, 'Order Date: ' || order_date::VARCHAR, 'Customer ID: ' || customer_id, 'Total Price: $' || format('{:,.2f}', total_price))"

_RANGE_COLS = lambda first=False: dict(zip(("date_from", "date_to"), T.parse_date_range(C("text"), first)))


def with_filters(statements: DataFrame, month_first: bool = False) -> DataFrame:
    """statements with doc_type, date_from, date_to and customer, as its text names them."""
    start, end = T.parse_date_range(C("text"), month_first)
    return statements.withColumns({"doc_type": T.parse_document_type(C("text")), "date_from": start, "date_to": end, "customer": T.parse_customer_id(C("text"))})


def _label_columns() -> dict[str, Column]:
    return {"label": T.label(C("status"), T.STATUS_LABELS)}


#: name: view, its key, columns over it, SQL columns over the view or the given relation.
SPECS: dict[str, tuple[str, str, Callable[[], dict[str, Column]], str, str]] = {
    "normalize_numbers": ("statements", "statement_id", lambda: {"out": T.normalize_numbers(C("text"))}, f"{_NORM.format('text')} AS out", ""),
    "sanitize_query": ("documents", "doc_id", lambda: {"out": T.sanitize_query(C("text"))}, rf"trim(regexp_replace(regexp_replace({_NORM.format('substr(trim(text), 1, 500)')}, '[^\p{{L}}\p{{N}}_\s\-.$#@/]', ' ', 'g'), '\s+', ' ', 'g')) AS out", ""),
    "fingerprint": ("documents", "doc_id", lambda: {"out": F.md5(T.fingerprint(C("text")))}, f"md5({_FINGER.format('text')}) AS out", ""),
    "cache_normal_form": ("statements", "statement_id", lambda: {"out": T.cache_normal_form(C("text"))}, f"{_FINGER.format(_NORM.format('text'))} AS out", ""),
    "verdict_cache_key": ("statements", "statement_id", lambda: {"out": T.verdict_cache_key(C("vault_id"), F.lit("v1"), C("text"))}, f"'verdict_cache:' || vault_id::VARCHAR || ':v1:' || sha256({_FINGER.format(_NORM.format('text'))}) AS out", ""),
    "content_hash": ("documents", "doc_id", lambda: {"out": F.sha2(C("text"), 256)}, "sha256(text) AS out", ""),
    "source_label": ("doc_meta", "doc_id", lambda: {"out": T.source_label(C("original_filename"))}, r"translate(regexp_replace(original_filename, '\.[^.]*$', ''), '_-', '  ') AS out", ""),
    "file_extension": ("doc_meta", "doc_id", lambda: {"out": T.file_extension(C("original_filename")), "none": T.file_extension(C("document_type"))}, "lower(string_split(original_filename, '.')[-1]) AS out, CASE WHEN contains(document_type, '.') THEN lower(string_split(document_type, '.')[-1]) ELSE '' END AS none", ""),
    "parse_document_type": ("statements", "statement_id", lambda: {"out": T.parse_document_type(C("text"))}, f"{_TYPE} AS out", ""),
    "parse_date_range": ("statements", "statement_id", lambda: _RANGE_COLS(), RANGE_SQL, _PARSED),
    "parse_date_range_month_first": ("statements", "statement_id", lambda: _RANGE_COLS(True), MONTH_FIRST_SQL, _PARSED),
    "parse_customer_id": ("statements", "statement_id", lambda: {"out": T.parse_customer_id(C("text"))}, "customer AS out", _PARSED),
    "filter_description": ("statements", "statement_id", lambda: {"out": T.filter_description(T.parse_document_type(C("text")), *T.parse_date_range(C("text")), T.parse_customer_id(C("text")))}, f"{DESCRIPTION_SQL} AS out", FILTERED_SQL),
    "date_keywords": (
        "statements", "statement_id", lambda: {"out": T.date_keywords(C("text"))},
        f"""list_filter([{_sql_first([(f"contains({_LOW}, '{w}')", _Q(w.capitalize())) for m in _MONTHS for w in (m, m[:3])])}, y::VARCHAR || '-' || lpad(m::VARCHAR, 2, '0'), y::VARCHAR], lambda x: x IS NOT NULL)
        || CASE WHEN q IS NOT NULL AND y IS NOT NULL THEN list_transform(range((q - 1) * 3 + 1, q * 3 + 1), lambda k: y::VARCHAR || '-' || lpad(k::VARCHAR, 2, '0')) ELSE [] END AS out""", _PARSED,
    ),
    "entity_type_keywords": (
        "statements", "statement_id", lambda: {"out": T.entity_type_keywords(C("text"))},
        "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains({_LOW}, {_Q(w)})' for w in words)} THEN {_Q(n)} END" for n, words in T.KEYWORD_GROUPS) + "], lambda x: x IS NOT NULL) AS out", "",
    ),
    "classify_query": ("statements", "statement_id", lambda: {"out": T.classify_query(C("text")), "statement_class": F.when(T.classify_query(C("text")) == "point", "point").otherwise("aggregate")}, f"{CLASS_SQL} AS out, CASE WHEN {CLASS_SQL} = 'point' THEN 'point' ELSE 'aggregate' END AS statement_class", f"(SELECT *, {_NORM.format(_LOW)} AS low FROM statements_v)"),
    "aggregate_intent": ("statements", "statement_id", lambda: {"out": T.aggregate_intent(C("text"))}, f"{INTENT_SQL} AS out", f"(SELECT *, {_NORM.format(_LOW)} AS low FROM statements_v)"),
    "extract_entity_ids": ("segments", "event_id", lambda: {"out": T.extract_entity_ids(C("text"))}, f"list_slice({_ORDERED.format(_IDS_SQL)}, 1, 10) AS out", ""),
    "extract_mentions": ("segments", "event_id", lambda: {"reference_numbers": T.extract_mentions(C("text"))["reference_numbers"], "numeric_ids": T.extract_mentions(C("text"))["numeric_ids"], "amounts": T.extract_mentions(C("text"))["amounts"]}, rf"{_ONCE.format(f'regexp_extract_all(text, {_Q(T.REFERENCE)}, 1)')} AS reference_numbers, {_ONCE.format(chr(114) + 'egexp_extract_all(text, ' + _Q(r'\b(\d{5,})\b') + ', 1)')} AS numeric_ids, {_ONCE.format(f'regexp_extract_all(text, {_Q(T.MONEY)})')} AS amounts", ""),
    "entity_boost": ("statements", "statement_id", lambda: {"out": T.entity_boost(C("text"))}, rf"list_aggregate(list_transform(list_slice(regexp_extract_all({_NORM.format('text')}, '\b(\d{{4,}})\b', 1), 1, 3), lambda x: 'ID ' || x) || [{_NORM.format('text')}], 'string_agg', ' ') AS out", ""),
    "entity_anchor": ("segments", "event_id", lambda: {"out": T.entity_anchor(C("text"))}, f"{ANCHOR_SQL} AS out", ""),
    "discriminator_tokens": ("statements", "statement_id", lambda: {"out": F.filter(T.tokens(C("text")), T.is_discriminator)}, f"list_filter(string_split({_FINGER.format('text')}, ' '), lambda w: {_DISC}) AS out", ""),
    "boosted_bag": ("statements", "statement_id", lambda: {"out": F.array_sort(T.boosted_bag(C("text")))}, f"{BAG_SQL} AS out", ""),
    "remap_speaker": ("segments", "event_id", lambda: {"out": T.remap_speaker(C("event_id") % 2, C("speaker"))}, "CASE WHEN event_id % 2 = 0 THEN 0 ELSE speaker + 1 END AS out", ""),
    "format_transcript": ("segments", "event_id", lambda: {"out": T.transcript_line(C("speaker"), F.floor(C("start_s")), F.floor(C("start_s")) + 2.5, C("text"))}, "'Speaker ' || speaker::VARCHAR || ' [' || format('{:.1f}', floor(start_s)) || 's - ' || format('{:.1f}', floor(start_s) + 2.5) || 's]: ' || text AS out", ""),
    "format_doc_line": ("doc_meta", "doc_id", lambda: {"out": T.document_line(C("original_filename"), C("order_date"), C("customer_id"), C("total_price"), C("entity_id")), "quote": T.metadata_quote(C("original_filename"), C("document_type"), C("entity_id"), C("order_date"), C("customer_id"), C("total_price"))}, f"{LINE_SQL} AS out, {QUOTE_SQL} AS quote", ""),
    "truncate": ("documents", "doc_id", lambda: {"quote": F.md5(T.truncate(C("text"), 300, "")), "full": F.md5(T.truncate(C("text"), 30000, "\n[truncated]")), "short": T.ellipsis(C("text"), 60)}, "md5(substr(text, 1, 300)) AS quote, md5(CASE WHEN length(text) > 30000 THEN substr(text, 1, 30000) || chr(10) || '[truncated]' ELSE text END) AS \"full\", CASE WHEN length(text) > 60 THEN substr(text, 1, 59) || '…' ELSE text END AS short", ""),
    "relative_time": ("events", "event_id", lambda: {"out": T.relative_time(C("ts").cast("timestamp"), F.expr(_AS_OF))}, f"(SELECT CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60)::VARCHAR || 'm ago' WHEN s < 86400 THEN (s // 3600)::VARCHAR || 'h ago' WHEN s < 2592000 THEN (s // 86400)::VARCHAR || 'd ago' WHEN s // 86400 // 30 < 12 THEN (s // 86400 // 30)::VARCHAR || 'mo ago' ELSE (s // 86400 // 30 // 12)::VARCHAR || 'y ago' END FROM (SELECT (epoch({_AS_OF}) - floor(epoch(ts)))::BIGINT AS s)) AS out", ""),
    "file_size": ("documents", "doc_id", lambda: {"out": T.file_size(F.octet_length("text") * F.col("doc_id"))}, "(SELECT CASE WHEN n = 0 THEN '0 B' WHEN n < 1024 THEN n::VARCHAR || ' B' WHEN n < 1048576 THEN format('{:.1f}', round(n / 1024, 1)) || ' KB' WHEN n < 1073741824 THEN format('{:.1f}', round(n / 1048576, 1)) || ' MB' ELSE format('{:.1f}', round(n / 1073741824, 1)) || ' GB' END FROM (SELECT strlen(text) * doc_id AS n)) AS out", ""),
    "format_duration": ("sessions", "session_id", lambda: {"out": T.duration(C("duration_seconds")), "clock": T.clock(C("duration_seconds"))}, "CASE WHEN duration_seconds IS NULL THEN '—' WHEN floor(duration_seconds / 60) = 0 THEN floor(duration_seconds % 60 + 0.5)::INT::VARCHAR || 's' ELSE floor(duration_seconds / 60)::INT::VARCHAR || 'm ' || floor(duration_seconds % 60 + 0.5)::INT::VARCHAR || 's' END AS out, floor(duration_seconds / 60)::INT::VARCHAR || ':' || lpad(floor(duration_seconds % 60)::INT::VARCHAR, 2, '0') AS clock", ""),
    "status_labels": ("doc_meta", "doc_id", _label_columns, _sql_first([(f"status = {_Q(k)}", _Q(v)) for k, v in T.STATUS_LABELS.items()]) + " AS label", ""),
}


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    view, key, columns, _, _ = SPECS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, view).select(key, *[c.alias(n) for n, c in columns().items()])

    return query


def _sql(name: str) -> str:
    from docspark.sources.tables import VIEWS

    view, key, _, columns, relation = SPECS[name]
    head = cte(view) if view in VIEWS else ""
    return f"{head} SELECT {key}, {columns} FROM {relation or (f'{view}_v' if head else view)}"


QUERIES = {name: _run(name) for name in SPECS}
ORACLES = {name: _sql(name) for name in SPECS}
