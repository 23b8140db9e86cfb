"""Structured answers: counts, sums and lists of documents for tables of statements.

Many statements ask for the same filters. Distinct filters meet a cube of documents by vault, day, and type and customer
or all of either, so the join is between the few filters that differ and the cube, not between all statements and all
documents, and it is on equal keys but for the dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators.documents import is_live
from docspark.sources.shared import written

FILTERS = ["vault_id", "doc_type", "date_from", "date_to", "customer"]
LISTED = 50
# What answers say.
INVENTORY_HEAD = "Available document types in this vault:\n"
CANNOT = "Cannot verify an exact result for: "
MISSING = ".\nMissing metadata:\n"
BACKFILL = "\nRe-ingest documents or run metadata backfill to fill the gaps."
NO_DATE = " document(s) missing order date metadata"
NO_TOTAL = " document(s) missing total price metadata"
EMPTY_VAULT = "No documents found in the vault."
NO_FILTER = "No structured filters could be parsed from the statement."
NONE_FOUND = "No documents found matching: "
NO_PRICES = "One or more documents are missing total prices for this query."


def parse(statements: DataFrame, month_first: bool = False) -> DataFrame:
    """statements (vault_id, text, ...) with what their texts ask for."""
    start, end = T.parse_date_range(F.col("text"), month_first)
    return statements.withColumns({"doc_type": T.parse_document_type(F.col("text")), "date_from": start, "date_to": end, "customer": T.parse_customer_id(F.col("text")), "intent": T.aggregate_intent(F.col("text"))})


def cube(documents: DataFrame) -> DataFrame:
    """Documents by vault and day, and by type and customer or all of either (any_type, any_customer)."""
    by = documents.select("vault_id", "order_date", F.col("document_type").alias("type"), F.lower("customer_id").alias("wanted"), "total_price")
    sets = [["vault_id", "order_date", *more] for more in (["type", "wanted"], ["type"], ["wanted"], [])]
    return by.groupingSets(sets, "vault_id", "order_date", "type", "wanted").agg(
        F.grouping("type").cast("boolean").alias("any_type"), F.grouping("wanted").cast("boolean").alias("any_customer"),
        F.count("*").alias("n"), F.count("total_price").alias("n_priced"), F.sum(F.col("total_price").cast("decimal(18,2)")).alias("total"),
    )


def wanted(filters: DataFrame, documents: DataFrame) -> DataFrame:
    """Distinct FILTERS with `wanted`, the customer that is asked for in lower case; a pattern has a row for each of the vault's customers that it matches."""
    f, pattern = filters.select(*FILTERS).distinct(), F.coalesce(F.rlike("customer", F.lit(r"[%_\\]")), F.lit(False))
    known = documents.select(F.col("vault_id").alias("_vault"), F.lower("customer_id").alias("wanted")).distinct()
    like = f.where(pattern).join(known, (F.col("vault_id") == F.col("_vault")) & F.like("wanted", F.lower("customer"))).drop("_vault")
    return f.where(~pattern).withColumn("wanted", F.lower("customer")).unionByName(like)


def _meets(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (vault_id, any_type, any_customer, type, wanted, ...) that wanted() filters ask for, in any time: an equi-join on all that isn't a range."""
    some = rows.where((F.col("any_type") | F.col("type").isNotNull()) & (F.col("any_customer") | F.col("wanted").isNotNull()))
    either = lambda all_, one: F.struct(all_.alias("all"), F.when(all_, "").otherwise(one).alias("one"))
    d = some.withColumn("_of", F.struct("vault_id", either(F.col("any_type"), F.col("type")).alias("t"), either(F.col("any_customer"), F.col("wanted")).alias("c"))).drop("vault_id", "any_type", "any_customer", "type", "wanted")
    f = asked.withColumn("_for", F.struct("vault_id", either(F.col("doc_type").isNull(), F.col("doc_type")).alias("t"), either(F.col("customer").isNull(), F.col("wanted")).alias("c"))).drop("wanted")
    return f.join(d, f["_for"] == d["_of"]).drop("_for", "_of")


def _in_time() -> Column:
    return (F.col("date_from").isNull() | (F.col("order_date") >= F.col("date_from"))) & (F.col("date_to").isNull() | (F.col("order_date") <= F.col("date_to")))


def filter_totals(filters: DataFrame, documents: DataFrame, active: bool = True) -> DataFrame:
    """For each distinct row of FILTERS: doc_count, sum_total, undated (had the dates not been asked for) and unpriced."""
    live, inside = documents.where(is_live(active)), _in_time()
    counted = {"doc_count": F.when(inside, F.col("n")), "undated": F.when(F.col("order_date").isNull(), F.col("n")), "unpriced": F.when(inside, F.col("n") - F.col("n_priced"))}
    found = _meets(wanted(filters, live), cube(live)).groupBy(*FILTERS).agg(*[F.sum(c).alias(k) for k, c in counted.items()], F.sum(F.when(inside, F.col("total"))).cast("double").alias("sum_total"))
    every, met = filters.select(*FILTERS).distinct(), found.select(F.struct(*FILTERS).alias("_same"), *counted, "sum_total")
    joined = every.join(met, F.struct(*[every[c] for c in FILTERS]).eqNullSafe(met["_same"]), "left")
    return joined.select(*[every[c] for c in FILTERS], *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("doc_count", "undated", "unpriced")], "sum_total")


def with_totals(parsed: DataFrame, documents: DataFrame, active: bool = True) -> DataFrame:
    """parsed statements beside their filters' totals; average divides by all documents, priced or not."""
    t = filter_totals(parsed, documents, active)
    on = [parsed[c].eqNullSafe(t[c]) for c in FILTERS]
    return parsed.join(t, on).drop(*[t[c] for c in FILTERS]).withColumn("average_total", F.when(F.col("doc_count") > 0, F.col("sum_total") / F.col("doc_count")))


def listings(filters: DataFrame, documents: DataFrame, most: int = LISTED) -> DataFrame:
    """FILTERS, position and document of the first `most` documents of each filter by date, id and name, nulls last."""
    live = documents.where(is_live())
    kinds = [F.struct(F.lit(t).alias("any_type"), F.lit(c).alias("any_customer")) for t in (False, True) for c in (False, True)]
    rows = live.select("vault_id", "doc_id", "original_filename", "document_type", "order_date", "customer_id", "total_price", "entity_id", F.col("document_type").alias("type"), F.lower("customer_id").alias("wanted"), F.explode(F.array(*kinds)).alias("_kind"))
    rows = rows.select("*", "_kind.*").drop("_kind")
    order = [F.col("order_date").asc_nulls_last(), F.col("entity_id").asc_nulls_last(), F.col("original_filename").asc_nulls_last(), F.col("doc_id")]
    # Written, the few filters are known to be few and are sent to the documents, which then aren't shuffled four times over.
    shown = _meets(written(wanted(filters, live), "filters"), rows).where(_in_time()).withColumn("position", F.row_number().over(Window.partitionBy(*FILTERS).orderBy(*order))).where(F.col("position") <= most)
    return shown.select(*FILTERS, "position", "doc_id", "original_filename", "document_type", "order_date", "customer_id", "total_price", "entity_id")


def type_inventory(documents: DataFrame) -> DataFrame:
    return documents.where(is_live()).groupBy("vault_id", F.coalesce("document_type", F.lit("unknown")).alias("document_type")).agg(F.count("*").alias("doc_count"))


def inventory_text(documents: DataFrame) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("document_type", "doc_count")))
    text = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("- "), x["document_type"], F.lit(": "), x["doc_count"].cast("string"))), "\n")
    return type_inventory(documents).groupBy("vault_id").agg(lines.alias("lines")).select("vault_id", F.concat(F.lit(INVENTORY_HEAD), text).alias("inventory"))


def verify(statements: DataFrame, documents: DataFrame) -> DataFrame:
    """statements that ask for aggregates, with verdict, confidence and explanation.

    A statement is supported as soon as its filters parse and the metadata they need is complete, even for no document;
    the number it asserts isn't compared. Without a filter, only questions for the inventory have an answer. Each text
    of a vault is parsed and answered once.
    """
    documents = written(documents.select("vault_id", "doc_id", "original_filename", "document_type", "entity_id", "order_date", "customer_id", "total_price", "status", "deleted_at").where(is_live()))
    once = written(statements.select("vault_id", "text").distinct())
    parsed = written(parse(once.where(T.classify_query(F.col("text")) != "point")))
    t = with_totals(parsed, documents)
    text = F.concat_ws("", F.col("position").cast("string"), F.lit(". "), T.document_line(*[F.col(c) for c in ("original_filename", "order_date", "customer_id", "total_price", "entity_id")]))
    lists = listings(parsed, documents).withColumn("line", text).groupBy(*FILTERS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    lists = lists.select(F.struct(*FILTERS).alias("_listed"), "lines")
    t = t.join(lists, F.struct(*[t[c] for c in FILTERS]).eqNullSafe(lists["_listed"]), "left").drop("_listed")
    inventory = inventory_text(documents).withColumnRenamed("vault_id", "_vault")
    t = t.join(inventory, t["vault_id"] == inventory["_vault"], "left")
    filtered = F.col("doc_type").isNotNull() | F.col("date_from").isNotNull() | F.col("customer").isNotNull()
    asks_money = F.col("intent").isin("sum", "average")
    no_dates = F.when(F.col("date_from").isNotNull() & (F.col("undated") > 0), F.concat(F.lit("- "), F.col("undated").cast("string"), F.lit(NO_DATE)))
    no_totals = F.when(asks_money & (F.col("unpriced") > 0), F.concat(F.lit("- "), F.col("unpriced").cast("string"), F.lit(NO_TOTAL)))
    gaps = F.concat_ws("\n", no_dates, no_totals)
    described = T.filter_description(*[F.col(c) for c in ("doc_type", "date_from", "date_to", "customer")])
    gap_text = F.concat(F.lit(CANNOT), described, F.lit(MISSING), gaps, F.lit(BACKFILL))
    value = F.when(F.col("intent") == "average", F.concat(F.lit("Average Total: "), T.money(F.col("average_total")))).when(F.col("intent") == "sum", F.concat(F.lit("Total Sum: "), T.money(F.col("sum_total"))))
    count = F.col("doc_count").cast("string")
    more = F.when(F.col("doc_count") > LISTED, F.concat(F.lit(f"... (showing first {LISTED} of "), count, F.lit(")")))
    found = F.concat_ws("\n", F.concat(F.lit("Found "), count, F.lit(" documents matching: "), described), value, F.concat(F.lit("Count: "), count), F.lit("\nDocuments:"), F.col("lines"), more)
    asks_inventory = T.is_inventory_question(F.col("text"))
    ladder = [
        (~filtered & asks_inventory & F.col("inventory").isNotNull(), "supported", F.col("inventory")),
        (~filtered & asks_inventory, "unverifiable", F.lit(EMPTY_VAULT)),
        (~filtered, "unverifiable", F.lit(NO_FILTER)),
        (gaps != "", "unverifiable", gap_text),
        (F.col("doc_count") == 0, "supported", F.concat(F.lit(NONE_FOUND), described, F.lit(".\nCount: 0"))),
        (asks_money & F.col("sum_total").isNull(), "unverifiable", F.lit(NO_PRICES)),
        (F.lit(True), "supported", found),
    ]
    verdict, explanation = _ladder(ladder, 1), _ladder(ladder, 2)
    answers = t.select(F.col("vault_id").alias("_vault_id"), F.col("text").alias("_text"), "intent", verdict.alias("verdict"), explanation.alias("explanation"))
    confidence = F.when(F.col("verdict") == "supported", 1.0).otherwise(0.0).alias("confidence")
    same = F.col("vault_id").eqNullSafe(F.col("_vault_id")) & (F.col("text") == F.col("_text"))
    return statements.select("statement_id", "vault_id", "text").join(answers, same).select("statement_id", "vault_id", "intent", "verdict", confidence, "explanation")


def _ladder(rows: list[tuple], at: int) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = F.when(rows[0][0], as_column(rows[0][at]))
    for row in rows[1:]:
        out = out.when(row[0], as_column(row[at]))
    return out
