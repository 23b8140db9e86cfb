"""Line dedup: which lines of each document occur elsewhere, as keep bitmaps.

Lines become hash rows that are range-partitioned by hash and sorted within each partition by hash, document (largest id
first) and position. Windows over these sorted runs stream through a hash's occurrences: the first is what stays, a row
whose document differs from the one before counts a further document. Nothing is joined back to the occurrences: lines
that go stand in the sorted run and lead straight to their document, as sparse 63-bit words of a bitmap, never as text.

A line in a good part of all documents would fill a partition. Such hashes are found in a sample, which decides only
where rows go; their runs are cut into salts by document, and what a run says of the whole hash (how many documents,
which is the first) comes from an aggregate over these hashes alone, of which there are at most SHARE a partition.

Everything is DataFrame code. Ties, nulls: rows with the same doc_id are documents of their own; those that share the
largest id of a key all keep its lines. A null id is smaller than any other. Null text is one empty line. An empty
table gives an empty table. Columns of documents other than doc_id and text pass through apply_bitmaps untouched,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import SPACE_CHARS, free, materialize, partitions

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lines with such characters may change in lower() beyond A-Z.
_OTHER_UPPER = r"[[^\x00-\x7F]&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"
_BITS = 63
#: A hash with more than one SHARE-th of a partition's rows is cut; SAMPLE rows are looked at to find such.
SHARE, SAMPLE = 4, 1_000_000


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased and no other letter."""
    line = F.btrim(line, F.lit(SPACE_CHARS))
    plain = (F.octet_length(line) == F.char_length(line)) | ~line.rlike(_OTHER_UPPER)
    return F.when(plain, F.lower(line)).otherwise(F.translate(line, _UPPER, _UPPER.lower()))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(df: DataFrame) -> Column:
    """Tells rows of one doc_id apart by their text; equal rows lose equal lines."""
    return F.xxhash64(F.coalesce(df["text"], F.lit("")))


def line_hashes(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(h1, h2, doc_id, row_key, pos) of each line whose key has min_chars code points."""
    lines = docs.select("doc_id", _row_key(docs).alias("row_key"), F.posexplode(_lines(docs["text"])).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"), "doc_id", "row_key", "pos")


def _hot(occurrences: DataFrame, n: int) -> DataFrame:
    """(h1, h2, salts) of the hashes that more than one row in SHARE * n has, as far as a sample shows; at most SHARE * n rows."""
    total = occurrences.count()
    seen = occurrences.sample(min(1.0, SAMPLE / max(total, 1)), seed=1).groupBy("h1", "h2").agg(F.count("*").alias("seen"))
    least = max(8.0, min(total, SAMPLE) / (SHARE * n))
    return seen.where(F.col("seen") > least).select("h1", "h2", F.ceil(F.col("seen") / least).alias("salts"))


def dropped_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, row_key, n_dropped, dropped): rows that lose nothing are absent.

    `dropped` is a compressed bitmap, (word, bits) for each word that isn't 0: bit i % 63 of word i div 63 is set if line i goes.
    """
    n = partitions(docs.sparkSession)
    # The range partitioning samples its input and reads it again: parse the texts once.
    occurrences = materialize(line_hashes(docs, min_chars), "line-hashes")
    hot = materialize(_hot(occurrences, n), "hot-lines")
    cut = occurrences.join(F.broadcast(hot), ["h1", "h2"])  # SHARE * n rows at most, as above
    whole = materialize(
        cut.groupBy("h1", "h2", "doc_id", "row_key").agg(F.first("salts").alias("salts"))
        .groupBy("h1", "h2").agg(F.first("salts").alias("salts"), F.count("*").alias("all_docs"), F.max("doc_id").alias("last_doc")),
        "hot-line-documents",
    )
    salted = occurrences.join(F.broadcast(whole), ["h1", "h2"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "row_key"), F.col("salts")), F.lit(-1)))
    order = [F.col("doc_id").desc_nulls_last(), "row_key", "pos"]
    ranged = salted.repartitionByRange(n, "h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", *order)
    run = Window.partitionBy("h1", "h2", "salt").orderBy(*order)
    everything = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A null id is never the largest unless all are, and then there is no row before that differs.
    same = F.lag("row_key").over(run).eqNullSafe(F.col("row_key")) & F.lag("doc_id").over(run).eqNullSafe(F.col("doc_id"))
    streamed = ranged.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run_docs", F.sum("new").over(everything)).withColumn("run_first", F.first("doc_id").over(run))
    known = F.col("all_docs").isNotNull()
    n_docs, keeper = F.coalesce("all_docs", "run_docs"), F.when(known, F.col("last_doc")).otherwise(F.col("run_first"))
    hits = streamed.where((n_docs >= min_docs) & ~F.col("doc_id").eqNullSafe(keeper)).select("doc_id", "row_key", "pos")
    words = (
        hits.repartition(n, "doc_id", "row_key").groupBy("doc_id", "row_key", (F.col("pos") / _BITS).cast("int").alias("word"))
        .agg(F.expr(f"bit_or(shiftleft(1L, pos % {_BITS}))").alias("bits"))
    )
    return words.groupBy("doc_id", "row_key").agg(F.sum(F.bit_count("bits")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, name: str) -> DataFrame:
    """docs with `name`, a struct of n_lines, n_dropped and kept_text (the lines that stay, joined by a line feed)."""
    row, bits = free("_row", [*docs.columns, name]), free("_bits", [*docs.columns, name])
    keyed = docs.withColumn(row, _row_key(docs))
    # The words up to the last one that has a bit, the others between as 0.
    dense = F.expr("flatten(transform(dropped, (x, i) -> concat(array_repeat(0L, x.word - if(i = 0, -1, dropped[i - 1].word) - 1), array(x.bits))))")
    b = bitmaps.select(F.struct(F.col("doc_id").alias("id"), F.col("row_key").alias("row"), F.col("n_dropped").alias("n"), dense.alias("words")).alias(bits))
    joined = keyed.join(b, (keyed[row] == b[bits]["row"]) & keyed["doc_id"].eqNullSafe(b[bits]["id"]), "left")
    lines, held = _lines(F.col("text")), F.col(bits)
    kept = F.filter(lines, lambda _, i: F.lit(0) == F.coalesce(F.get(held["words"], F.floor(i / _BITS).cast("int")), F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % _BITS)))
    made = F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(held["n"], F.lit(0)).cast("long").alias("n_dropped"),
        F.when(held["words"].isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
    return joined.select(*[F.col(c) for c in docs.columns], made.alias(name))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    from docspark.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, dropped_bitmaps(docs), "lines")
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), dup AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT a.doc_id, count(*) AS n_lines, count(*) FILTER (d.k IS NOT NULL AND a.doc_id <> d.keeper) AS n_dropped,
  sha256(coalesce(string_agg(a.line, chr(10) ORDER BY a.pos) FILTER (d.k IS NULL OR a.doc_id = d.keeper), '')) AS kept_sha256
FROM keyed a LEFT JOIN dup d ON a.k = d.k GROUP BY a.doc_id
"""
