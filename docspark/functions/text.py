"""Text functions as Column expressions: everything runs in the JVM and inside streams alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, patterns and labels that results depend on.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SKIPPED_IDS = ("ALL", "AND", "THE", "FOR", "FROM", "WITH", "NOT", "HAS", "ARE", "WAS", "WERE", "THIS", "THAT", "HAVE", "BEEN", "EACH", "EVERY", "LIST", "WHAT", "WHICH", "HOW", "TOTAL", "PRICE", "DATE", "ORDER", "INVOICE", "REPORT", "STOCK")
COMMON_WORDS = (
    "the", "and", "for", "from", "with", "that", "this", "have", "been", "were", "they", "their", "which", "about", "would", "there", "each", "every", "some", "what", "when", "where",
    "more", "most", "also", "just", "only", "than", "then", "into", "over", "such", "after", "before", "between", "total", "price", "count", "number", "order", "invoice", "report", "stock",
    "purchase", "shipping", "delivery", "document", "documents", "customer", "invoices", "orders", "reports", "items", "products", "list", "give", "show", "many", "much", "all", "how", "does", "are", "was", "not",
)
TYPE_WORDS = (
    ("invoice", ("invoice",)),
    ("purchase_order", ("purchase order", "purchase_order")),
    ("shipping_order", ("shipping order", "shipment", "shipping_order")),
    ("stock_report", ("stock report", "inventory report", "stock_report")),
)
KEYWORD_GROUPS = (
    ("invoice", ("invoice",)),
    ("order", ("order",)),
    ("stock report", ("stock report", "inventory report")),
    ("shipping", ("shipping", "shipment")),
    ("purchase", ("purchase",)),
)
TIME_WORDS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|january|february|march|april|may|june|july|august|september|october|november|december|20\\d{2}|q[1-4]"
AGGREGATE_PATTERNS = (
    r"\ball\b.*\b(?:invoice|order|report|document|item|product|shipping|purchase)",
    r"\btotal\b.*\b(?:price|cost|amount|value|number|count|quantity|items)\b.*\b(?:of all|for all|from all|across)\b",
    r"\bhow many\b",
    r"\bcount\b.*\b(?:of|all|the)\b",
    r"\btotal number\b",
    r"\bnumber of\b",
    r"\blist\b.*\b(?:every|all|each)\b",
    r"\bevery\b",
    r"\btypes of documents\b",
    r"\bwhat.*(?:do we have|exist|available)\b",
    r"\b(?:stock|inventory)\b.*\breport",
    r"\b(?:exist|available)\b.*\b(?:in the vault|in the database)\b",
    rf"\b(?:invoices?|orders?|reports?|documents?|items?|products?)\b.*\b(?:from|in|of|during|for)\b.*\b(?:{TIME_WORDS})\b",
    rf"\btotal\b.*\b(?:price|cost|amount|value)\b.*\b(?:from|in|during|for)\b.*\b(?:{TIME_WORDS})\b",
)
COMPUTE = r"\b(?:total|sum|average|avg|calculate|compute|add up|combined)\b"
STRONG_POINT = r"\b(?:this|that)\s+(?:order|invoice|document|report|item|product|shipment)\b"
WEAK_POINT = r"\bthe\s+(?:order|invoice|document|report|item|product|shipment)\b"
PROPER_NAME = r"\b(?:for|about|by)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"
MANY_DOCUMENTS = r"\b(?:all|every|each|how many)\b"
COUNT = r"\b(?:count|how many|number of|total number)\b|\btotal\s+(?:invoices?|orders?|documents?|items?|products?|reports?)\b"
AVERAGE = r"\b(?:average|avg)\b"
INVENTORY = r"\b(?:types of documents|what documents|what do we have|documents available)\b"
ANCHOR_WORDS = r"\b(?:invoice|order|purchase\s*order|po|shipping|delivery|receipt|contract|ticket|case|serial|batch|lot|ref|id|number)\b"
ANCHOR_NUMBER, ANCHOR_MONEY = r"\b\d{4,}\b", r"[$€£¥][\d,.]+"
NAMED_ID = r"(?i)(?:invoice|order|po|purchase\s*order|shipping|delivery|receipt|ticket|case)\s*(?:number|#|id|no\.?)?\s*:?\s*([A-Z]*-?\d{3,})"
REFERENCE = r"(?i)(?:invoice|order|po|purchase\s*order|contract|ticket|case|serial|batch|lot|ref|shipment|delivery|receipt)\s*(?:number|#|id|no\.?)?\s*:?\s*([A-Z]*-?\d{3,})"
MONEY = r"(?i)[$€£¥][\d,]+\.?\d*|\d+[\d,]*\.?\d*\s*(?:dollars|usd|eur|gbp)"
JOINED_NUMBER = r"(\d),(\d)"
QUERY_SYMBOLS = r"[^\p{L}\p{N}_\s\-.$#@/]"
WORD_SYMBOLS = r"[^\p{L}\p{N}_\s]"
SUFFIX = r"\.[^.]*$"
YEAR = r"\b(20\d{2})\b"
QUARTER = r"\bq([1-4])\b"
CUSTOMER = r"\b([A-Z]{3,10})\b"
BARE_ID = r"\b(\d{4,})\b"
NUMERIC_ID = r"\b(\d{5,})\b"
STATUS_LABELS = {"pending": "Queued", "ingesting": "Processing", "active": "Ready", "failed": "Failed", "pending_delete": "Deleting", "deleted": "Deleted"}
SESSION_LABELS = {"recording": "Recording", "completed": "Completed", "failed": "Failed"}
VERDICT_LABELS = {"pending": "Verifying", "supported": "Supported", "contradicted": "Contradicted", "unverifiable": "Unverifiable"}


def normalize_numbers(text: Column) -> Column:
    """10,248 -> 10248; matches don't overlap, so 1,2,3 -> 12,3."""
    return F.regexp_replace(text, JOINED_NUMBER, "$1$2")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sanitize_query(text: Column, most: int = 500) -> Column:
    """A query for keyword search: cut, numbers joined, other than word characters and -.$#@/ blanked."""
    return squeeze(F.regexp_replace(normalize_numbers(F.substring(F.trim(text), 1, most)), QUERY_SYMBOLS, " "))


def fingerprint(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(text), WORD_SYMBOLS, ""))


def cache_normal_form(text: Column) -> Column:
    return fingerprint(normalize_numbers(text))


def verdict_cache_key(vault_id: Column, version: Column, text: Column) -> Column:
    return F.concat_ws(":", F.lit("verdict_cache"), vault_id.cast("string"), version, F.sha2(cache_normal_form(text), 256))


def source_label(filename: Column) -> Column:
    return F.translate(F.regexp_replace(filename, SUFFIX, ""), "_-", "  ")


def file_extension(filename: Column) -> Column:
    return F.when(filename.contains("."), F.lower(F.substring_index(filename, ".", -1))).otherwise("")


def _first(pairs: list[tuple[Column, Column]]) -> Column:
    """The value of the first condition that holds, else null."""
    ladder = F.when(*pairs[0])
    for condition, value in pairs[1:]:
        ladder = ladder.when(condition, value)
    return ladder


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def parse_document_type(text: Column) -> Column:
    low = F.lower(text)
    return _first([(_any([low.contains(w) for w in words]), F.lit(kind)) for kind, words in TYPE_WORDS])


def parse_year(text: Column) -> Column:
    found = F.regexp_extract(F.lower(text), YEAR, 1)
    return F.when(found != "", found.cast("int"))


def parse_month(text: Column) -> Column:
    """The first month, by calendar, whose short name occurs anywhere: "market" has March."""
    return _first([(F.lower(text).contains(m[:3]), F.lit(i)) for i, m in enumerate(MONTHS, 1)])


def parse_quarter(text: Column) -> Column:
    found = F.regexp_extract(F.lower(text), QUARTER, 1)
    return F.when(found != "", found.cast("int"))


def parse_date_range(text: Column, month_first: bool = False) -> tuple[Column, Column]:
    """First and last day; null without a year. A quarter beats a month unless month_first."""
    year, month, quarter = parse_year(text), parse_month(text), parse_quarter(text)
    by_quarter, by_month = (quarter - 1) * 3 + 1, month
    start = F.coalesce(by_month, by_quarter, F.lit(1)) if month_first else F.coalesce(by_quarter, by_month, F.lit(1))
    long = F.when(month.isNotNull(), 0).when(quarter.isNotNull(), 2).otherwise(11) if month_first else F.when(quarter.isNotNull(), 2).when(month.isNotNull(), 0).otherwise(11)
    return F.make_date(year, start, F.lit(1)), F.last_day(F.make_date(year, start + long, F.lit(1)))


def parse_customer_id(text: Column) -> Column:
    """The first word of 3 to 10 capitals; null if that one is a common word."""
    found = F.regexp_extract(text, CUSTOMER, 1)
    return F.when((found != "") & ~found.isin(*SKIPPED_IDS), found)


def filter_description(doc_type: Column, date_from: Column, date_to: Column, customer: Column) -> Column:
    same = (F.month(date_from) == F.month(date_to)) & (F.year(date_from) == F.year(date_to))
    dates = F.when(same, F.concat(F.lit("date="), F.date_format(date_from, "MMMM yyyy"))).when(
        date_from.isNotNull() & date_to.isNotNull(), F.concat(F.lit("date="), date_from.cast("string"), F.lit(" to "), date_to.cast("string"))
    )
    parts = F.concat_ws(", ", F.concat(F.lit("type="), F.translate(doc_type, "_", " ")), dates, F.concat(F.lit("customer="), customer))
    return F.when(parts == "", "all documents").otherwise(parts)


def date_keywords(text: Column) -> Column:
    year, month, quarter = parse_year(text).cast("string"), parse_month(text), parse_quarter(text)
    name = _first([(F.lower(text).contains(w), F.lit(w.capitalize())) for m in MONTHS for w in (m, m[:3])])
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    own = F.array_compact(F.array(name, F.concat(year, F.lit("-"), two(month)), year))
    begin = (quarter - 1) * 3 + 1
    months = F.transform(F.sequence(begin, begin + 2), lambda m: F.concat(year, F.lit("-"), two(m)))
    return F.concat(own, F.when(quarter.isNotNull() & year.isNotNull(), months).otherwise(F.array().cast("array<string>")))


def entity_type_keywords(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(_any([F.lower(text).contains(w) for w in words]), F.lit(name)) for name, words in KEYWORD_GROUPS]))


def classify_query(text: Column) -> Column:
    """point, aggregate or compute."""
    low = normalize_numbers(F.lower(text))
    point = ~low.rlike("|".join(AGGREGATE_PATTERNS)) | low.rlike(STRONG_POINT) | (~low.rlike(MANY_DOCUMENTS) & (low.rlike(WEAK_POINT) | text.rlike(PROPER_NAME)))
    return F.when(point, "point").when(low.rlike(COMPUTE), "compute").otherwise("aggregate")


def aggregate_intent(text: Column) -> Column:
    low = normalize_numbers(F.lower(text))
    return F.when(low.rlike(COUNT), "count").when(low.rlike(AVERAGE), "average").when(low.rlike(COMPUTE), "sum").otherwise("list")


def is_inventory_question(text: Column) -> Column:
    return F.lower(text).rlike(INVENTORY)


def entity_anchor(text: Column) -> Column:
    return text.rlike(ANCHOR_NUMBER) | text.rlike(ANCHOR_MONEY) | F.lower(text).rlike(ANCHOR_WORDS)


def bare_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(BARE_ID), 1)


def extract_entity_ids(text: Column, most: int = 10) -> Column:
    """Named ids first ("invoice 10248"), then numbers of four digits or more; each once."""
    return F.slice(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(NAMED_ID), 1), bare_ids(text))), 1, most)


def extract_mentions(text: Column) -> Column:
    """Distinct reference numbers, ids of five digits or more, and amounts."""
    found = lambda pattern, group: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), group)))
    return F.struct(found(REFERENCE, 1).alias("reference_numbers"), found(NUMERIC_ID, 1).alias("numeric_ids"), found(MONEY, 0).alias("amounts"))


def entity_boost(text: Column) -> Column:
    """The text after "ID x" for each of its first three ids."""
    plain = normalize_numbers(text)
    ids = F.slice(F.regexp_extract_all(plain, F.lit(BARE_ID), 1), 1, 3)
    return F.concat_ws(" ", F.transform(ids, lambda x: F.concat(F.lit("ID "), x)), plain)


def is_discriminator(token: Column) -> Column:
    months = [w for m in MONTHS for w in (m, m[:3])]
    return token.isin(*months) | token.rlike(r"^q[1-4]$") | token.rlike(r"^\d{3,}$") | (token.rlike(r"^\p{L}{4,}$") & ~token.isin(*COMMON_WORDS))


def tokens(text: Column) -> Column:
    return F.filter(F.split(fingerprint(text), " "), lambda t: t != "")


def boosted_bag(text: Column, factor: int = 3) -> Column:
    """Distinct words; those that tell statements apart count `factor` times."""
    copies = lambda t: F.concat(F.array(t), *[F.array(F.concat(t, F.lit(f"__{i}"))) for i in range(1, factor)])
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(tokens(text)), lambda t: F.when(is_discriminator(t), copies(t)).otherwise(F.array(t)))))


def unboosted(word: Column) -> Column:
    """The word of a boosted bag's element."""
    return F.regexp_replace(word, "__[0-9]+$", "")


def remap_speaker(channel: Column, speaker: Column) -> Column:
    return F.when(channel == 0, 0).otherwise(speaker + 1)


def transcript_line(speaker: Column, start: Column, end: Column, text: Column) -> Column:
    one = lambda x: F.format_string("%.1f", F.bround(x.cast("double"), 1))
    return F.concat(F.lit("Speaker "), speaker.cast("string"), F.lit(" ["), one(start), F.lit("s - "), one(end), F.lit("s]: "), text)


def money(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, 2))


def document_line(filename: Column, order_date: Column, customer: Column, total: Column, entity_id: Column) -> Column:
    details = F.concat_ws(", ", F.concat(F.lit("Date: "), order_date.cast("string")), F.concat(F.lit("Customer: "), customer), F.concat(F.lit("Total: "), money(total)), F.concat(F.lit("ID: "), entity_id))
    return F.when(details == "", filename).otherwise(F.concat(filename, F.lit(" — "), details))


def metadata_quote(filename: Column, doc_type: Column, entity_id: Column, order_date: Column, customer: Column, total: Column) -> Column:
    return F.concat_ws(
        "\n", F.concat(F.lit("Document: "), filename), F.concat(F.lit("Type: "), doc_type), F.concat(F.lit("ID: "), entity_id),
        F.concat(F.lit("Order Date: "), order_date.cast("string")), F.concat(F.lit("Customer ID: "), customer), F.concat(F.lit("Total Price: "), money(total)),
    )


def truncate(text: Column, most: int, tail: str) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit(tail))).otherwise(text)


def ellipsis(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def history_line(role: Column, text: Column) -> Column:
    """Null for a blank text."""
    name, said = F.initcap(role), F.trim(text)
    said = F.when(name == "Assistant", truncate(said, 500, "...")).otherwise(said)
    return F.when(said != "", F.concat(name, F.lit(": "), said))


def relative_time(then: Column, as_of: Column) -> Column:
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(then)
    unit = lambda n, tail: F.concat(F.floor(seconds / n).cast("string"), F.lit(tail))
    minute, hour, day = 60, 3600, 86400
    months = F.floor(F.floor(seconds / day) / 30)
    return (
        F.when(seconds < minute, "just now").when(seconds < hour, unit(minute, "m ago")).when(seconds < day, unit(hour, "h ago")).when(seconds < 30 * day, unit(day, "d ago"))
        .when(months < 12, F.concat(months.cast("string"), F.lit("mo ago"))).otherwise(F.concat(F.floor(months / 12).cast("string"), F.lit("y ago")))
    )


def file_size(n: Column) -> Column:
    ladder = [(n < 1024, F.concat(n.cast("string"), F.lit(" B")))]
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        text = F.concat(F.format_string("%.1f", F.round(n / 1024**power, 1)), F.lit(f" {unit}"))
        ladder.append((n < 1024 ** (power + 1) if power < 3 else F.lit(True), text))
    return F.when(n.isNull() | (n == 0), "0 B").otherwise(_first(ladder))


def clock(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad(F.floor(seconds % 60).cast("string"), 2, "0"))


def duration(seconds: Column) -> Column:
    minutes, rest = F.floor(seconds / 60), F.floor(seconds % 60 + 0.5)
    return F.when(seconds.isNull(), "—").when(minutes == 0, F.concat(rest.cast("string"), F.lit("s"))).otherwise(F.concat(minutes.cast("string"), F.lit("m "), rest.cast("string"), F.lit("s")))


def label(code: Column, labels: dict[str, str]) -> Column:
    return _first([(code == k, F.lit(v)) for k, v in labels.items()])
