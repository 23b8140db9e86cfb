"""Threshold-scaled sketches as document fingerprints.

A text's shingles are its runs of five words (all its words, if fewer). Each has a hash below 2**31 - 1; the sketch
keeps every hash below a fixed fraction of that, so the sketch of a union is the union of sketches, and the share of
one sketch in another estimates containment however unequal the texts are. The fingerprint writes the hashes in order,
eight hex digits each. Of a text of fewer than WHOLE shingles, and of one without a hash below the fraction, it writes
`=` and all hashes; a text without a word has the empty one.

Likeness and containment follow from two fingerprints alone: if both are whole, they are those of the sets, exactly; else
a whole one is first cut down to its hashes below the fraction, as the union's sketch would have it, and both are compared
as sketches. What has no hash left is like nothing, and contained in nothing. A print has eight bytes for every
KEEP shingles: about a third of the bytes of a text of six-letter words.

Everything is DataFrame code. To pair each document with the next by id, ids are cut into ranges: quantiles of the ids,
each cut evenly. A window within each range leads to the next text; a range's last document takes the first of the next
range that has any. Rows of one doc_id follow each other in the order of their text's hash; null ids come first, also in
ranges, by their text's hash; a single row is its own successor; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import SPACE, partitions

SHINGLE = 5
PRIME = 2**31 - 1
#: One shingle hash in KEEP is retained.
KEEP = 4
#: Texts of fewer shingles have all hashes in their fingerprint.
WHOLE = 64
#: The multipliers of the five words' hashes.
FACTORS = (1103515245, 1664525019, 1812433253, 1566083941, 1597334677)
#: Quantiles of the ids whose gaps are cut evenly.
KNOTS = 64


def with_shingles(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`: the ascending distinct shingle hashes of the column `text`.

    Word hashes are a column of their own, so that no lambda computes them again.
    """
    words, hashes = f"_{out}_words", f"_{out}_hashes"
    df = df.withColumn(words, F.expr(f"filter(split({text}, r'{SPACE}'), w -> w <> '')"))
    df = df.withColumn(hashes, F.expr(f"transform({words}, w -> cast(conv(substring(md5(w), 1, 7), 16, 10) as bigint))"))
    terms = " + ".join([f"h * {FACTORS[0]}L", *[f"coalesce(get({hashes}, i + {k}), 0L) * {FACTORS[k]}L" for k in range(1, SHINGLE)]])
    shingles = F.expr(f"transform(slice({hashes}, 1, greatest(size({hashes}) - {SHINGLE - 1}, 1)), (h, i) -> ({terms}) % {PRIME}L)")
    return df.withColumn(out, F.sort_array(F.array_distinct(shingles))).drop(words, hashes)


def sketch(shingles: Column) -> Column:
    """The retained ones of ascending shingle hashes."""
    return F.filter(shingles, lambda s: s < PRIME // KEEP)


def _digits(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def whole(shingles: Column) -> Column:
    """Whether the fingerprint of a set has all of it."""
    return (F.size(shingles) < WHOLE) | (F.size(sketch(shingles)) == 0)


def fingerprint(shingles: Column, kept: Column) -> Column:
    """kept: sketch(shingles)."""
    all_of_it = (F.size(shingles) < WHOLE) | (F.size(kept) == 0)
    return F.when(F.size(shingles) == 0, "").when(all_of_it, F.concat(F.lit("="), _digits(shingles))).otherwise(_digits(kept))


def with_likeness(df: DataFrame, a: str, b: str, near: str, inside: str) -> DataFrame:
    """df with estimates, from the fingerprints of shingle columns a and b, of the sets' Jaccard likeness and of the share of a's shingles that b has.

    Both are 1 if a (and for likeness b too) has no shingle.
    """
    x, y, n = (f"_{near}_{k}" for k in ("a", "b", "n"))
    both = whole(F.col(a)) & whole(F.col(b))
    df = df.withColumns({x: F.when(both, F.col(a)).otherwise(sketch(F.col(a))), y: F.when(both, F.col(b)).otherwise(sketch(F.col(b)))})
    df = df.withColumn(n, F.size(F.array_intersect(x, y)))
    union = F.size(x) + F.size(y) - F.col(n)
    share = F.when(F.size(a) == 0, 1.0).when(F.size(x) == 0, 0.0).otherwise(F.col(n) / F.size(x))
    return df.withColumns({near: F.when(union == 0, 1.0).otherwise(F.col(n) / union), inside: share}).drop(x, y, n)


def _range(docs: DataFrame, n: int) -> Column:
    """A number that ascends with doc_id and takes about n values, each for about as many documents; null ids take `each` more, by their text's hash."""
    bounds = docs.select(F.percentile_approx("doc_id", [i / KNOTS for i in range(KNOTS + 1)], 10_000)).first()[0] or [0]
    bounds, each, doc_id = sorted(set(bounds)), max(1, n // KNOTS), F.col("doc_id")
    # Quantiles are estimates: ids beyond them belong to the ranges at the ends.
    cells = list(zip(bounds, [*bounds[1:], bounds[-1] + 1], strict=True))

    def pick(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            begin, end = cells[lo]
            inside = F.floor((doc_id.cast("double") - float(begin)) * each / float(max(end - begin, 1)))
            return F.greatest(F.lit(0), F.least(F.lit(each - 1), inside)) + (lo + 1) * each
        mid = (lo + hi) // 2
        return F.when(doc_id < cells[mid][0], pick(lo, mid)).otherwise(pick(mid, hi))

    by_hash = F.floor((F.xxhash64("text") / float(2**64) + 0.5) * each)
    return F.when(doc_id.isNull(), F.least(F.lit(each - 1), by_hash)).otherwise(pick(0, len(cells))).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with next_text, from the document that follows by doc_id (after the last: the first)."""
    numbered = docs.withColumn("_range", _range(docs, 4 * partitions(docs.sparkSession)))
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", F.xxhash64("text"))
    within = Window.partitionBy("_range").orderBy(order)
    led = numbered.withColumn("_next", F.lead(F.struct("text")).over(within))
    # The first document of each range: found by ids alone, then read. There are as many as ranges, a number that is set above.
    firsts = numbered.select("doc_id", "_range").groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("_first"))
    firsts = F.broadcast(firsts.select(F.col("_range").alias("_at"), F.col("_first.doc_id").alias("_id")))
    by_range = Window.orderBy("_at")  # a number for each range
    follows = firsts.select(F.col("_at").alias("_before"), F.coalesce(F.lead("_at").over(by_range), F.first("_at").over(by_range)).alias("_to"))
    rows = numbered.join(firsts, numbered["doc_id"].eqNullSafe(firsts["_id"]) & (numbered["_range"] == firsts["_at"]))
    rows = rows.groupBy("_at").agg(F.min_by(F.struct("text"), order).alias("_row"))
    begins = rows.join(follows, rows["_at"] == follows["_to"]).select("_before", "_row")
    joined = led.join(begins, led["_range"] == begins["_before"])
    return joined.select(*docs.columns, F.coalesce("_next", "_row")["text"].alias("next_text"))


def op3_document_sketch(spark, sf_dir: str) -> DataFrame:
    from docspark.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", 1, F.col("n_chars").cast("int") - half), F.substring("next_text", 1, half))
    docs = docs.withColumn("edited", edited)
    for text, out in (("text", "a"), ("edited", "b"), ("next_text", "c")):
        docs = with_shingles(docs, text, out)
    docs = with_likeness(with_likeness(docs, "a", "b", "near_edited", "kept_in_edited"), "a", "c", "near_next", "kept_in_next")
    docs = docs.withColumns({"ka": sketch(F.col("a")), "kb": sketch(F.col("b"))})
    return docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("a"), F.col("ka")).alias("fingerprint"), fingerprint(F.col("b"), F.col("kb")).alias("edited_fingerprint"),
        "near_edited", "near_next", "kept_in_edited", "kept_in_next",
    )


def _sql_shingles(text: str) -> str:
    words = rf"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    hashes = f"list_transform({words}, lambda w: ('0x' || substr(md5(w), 1, 7))::BIGINT)"
    terms = " + ".join(f"coalesce(h[i + {k}], 0) * {f}" for k, f in enumerate(FACTORS))
    return f"(SELECT coalesce(list_sort(list(DISTINCT ({terms}) % {PRIME})), []) FROM (SELECT {hashes} AS h), LATERAL (SELECT unnest(range(1, CASE WHEN len(h) = 0 THEN 1 ELSE greatest(len(h) - {SHINGLE - 2}, 2) END)) AS i))"


def _sql_kept(a: str) -> str:
    return f"list_filter({a}, lambda x: x < {PRIME // KEEP})"


_DIGITS = "list_aggregate(list_transform({0}, lambda x: printf('%08x', x)), 'string_agg', '')"
_WHOLE = f"(len({{0}}) < {WHOLE} OR len(k{{0}}) = 0)"
_PRINT = f"CASE WHEN len({{0}}) = 0 THEN '' WHEN {_WHOLE} THEN '=' || {_DIGITS} ELSE {_DIGITS.replace('{0}', 'k{0}')} END"
_JACCARD = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"
_CONTAINED = "CASE WHEN len({2}) = 0 THEN 1.0 WHEN len({0}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / len({0}) END"
#: Two sets as they are compared: by their sketches, unless both fingerprints are whole.
_BOTH = f"{_WHOLE} AND {_WHOLE.replace('{0}', '{1}')}"
_PAIRED = f"CASE WHEN {_BOTH} THEN {{0}} ELSE k{{0}} END AS {{0}}_{{1}}, CASE WHEN {_BOTH} THEN {{1}} ELSE k{{1}} END AS {{1}}_{{0}}"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (ORDER BY doc_id)) AS next_text FROM d),
e AS (SELECT *, length(text) AS n_chars, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM n),
s AS (SELECT *, {_sql_shingles('text')} AS a, {_sql_shingles('edited')} AS b, {_sql_shingles('next_text')} AS c FROM e),
k AS (SELECT *, {_sql_kept('a')} AS ka, {_sql_kept('b')} AS kb, {_sql_kept('c')} AS kc FROM s),
p AS (SELECT *, {_PAIRED.format('a', 'b')}, {_PAIRED.format('a', 'c')} FROM k)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_PRINT.format('a')} AS fingerprint, {_PRINT.format('b')} AS edited_fingerprint,
  {_JACCARD.format('a_b', 'b_a')} AS near_edited, {_JACCARD.format('a_c', 'c_a')} AS near_next, {_CONTAINED.format('a_b', 'b_a', 'a')} AS kept_in_edited, {_CONTAINED.format('a_c', 'c_a', 'a')} AS kept_in_next
FROM p
"""
