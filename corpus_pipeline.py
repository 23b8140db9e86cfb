"""A corpus from raw documents to packed sequences: quality rules, line dedup, near duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import jaccard_join, line_dedup, mixing, packing, quality
from docspark.llm.common import free, materialize, table, temporary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the plain rules or lie outside their language's perplexity band go.

    Null and empty texts fail the plain rules; a null lang is a language of its own; repeated rows are judged alike; other
    columns, whatever their names, aren't read. An empty table gives an empty one, here and in all stages.
    """
    return quality.filter_documents(docs).select(*COLUMNS)


def line_level_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents share stay in the last one only; every document stays, if only as empty text.

    Null text stays null unless a line goes, which it hasn't got; rows of one doc_id, repeated rows among them, are
    documents of one id; the largest doc_id decides, null ids being smaller than all others. Columns of other names aren't read.
    """
    name = free("_lines", docs.columns)
    with temporary(spark) as keep:  # the lines' hashes are larger than what is left of them
        bitmaps = keep(materialize(line_dedup.dropped_bitmaps(docs), "bitmaps"))
    out = line_dedup.apply_bitmaps(docs, bitmaps, name)
    made = F.col(name)
    changed = made["n_dropped"] > 0
    return out.withColumns({"text": F.when(changed, made["kept_text"]).otherwise(F.col("text")), "n_chars": F.when(changed, F.char_length(made["kept_text"]).cast("long")).otherwise(F.col("n_chars"))}).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are connected by a likeness of 0.8 or more on five words, the one with the smallest id stays.

    Texts without a word, null ones too, all stay; equal rows are one; of equal ids the text decides by its hash, and null
    ids are the last choice. Columns of other names aren't read.
    """
    return jaccard_join.keep_one(docs, size=5, percent=80).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it: not at all, once or twice.

    Null sources are one source; null and empty texts have no words and are never taken; which of the documents of one
    length are taken follows a seeded order of their ids, and equal rows are interchangeable.
    """
    return mixing.mixed(docs).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset.

    Null text is empty and has one piece, the id that closes it; rows of one doc_id and repeated rows are packed each by
    itself, ties in any order; of the documents' columns doc_id alone is read beside the text.
    """
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        source = f.read()
    return packing.packed_digests(docs, source)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_level_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express perplexity, the seeded choice or the packing plan; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
