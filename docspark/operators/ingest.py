"""Ingestion: text sources, chunks, document metadata, embeddings, and the whole of it as one function."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import events as E
from docspark.sources.shared import written

SIZE, OVERLAP = 512, 50
# Separators by rank, and the patterns of file names and contents.
SEPARATORS = ("\n\n## ", "\n\n### ", "\n\n", "\n", ". ", " ", "")
NAMES = ((r"(?i)invoice[_\s-]*(\d+)", "invoice"), (r"(?i)purchase[_\s-]*orders?[_\s-]*(\d+)", "purchase_order"), (r"(?i)order[_\s-]*(\d+)", "shipping_order"), (r"(?i)StockReport[_\s-]*([\d-]+)", "stock_report"))
ORDER_DATE, CUSTOMER_ID = r"(?i)\*{0,2}Order\s+Date:?\*{0,2}\s*(\d{4}-\d{2}-\d{2})", r"(?i)\*{0,2}Customer\s+ID:?\*{0,2}\s*([A-Z]{3,10})"
STOCK_MONTH = r"(?i)StockReport[_\s-]*(\d{4}-\d{2})"
PRICES = (r"(?i)TotalPrice\s*\|?\s*\$?([\d,]+\.?\d*)", r"(?i)\|\s*\|?\s*TotalPrice\s*\|\s*\$?([\d,]+\.?\d*)", r"(?i)Total\s+Price:?\s*\$?([\d,]+\.?\d*)")


def decoded_text(content: Column) -> Column:
    """The text of UTF-8 bytes, null if they aren't. Line ends become line feeds."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8"))
    return F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), r"\r\n?", "\n")


#: Parsers by file type: text of the bytes of a file. Others can be added or given.
PARSERS: dict[str, Callable[[Column], Column]] = {"md": decoded_text, "txt": decoded_text}


def parse_files(files: DataFrame, parsers: dict[str, Callable[[Column], Column]] = PARSERS) -> DataFrame:
    """files (file_type, content) with text and error: each type by its parser, in any case of its name."""
    kind = F.lower("file_type")
    text = F.coalesce(*[F.when(kind == k, parser(F.col("content"))) for k, parser in parsers.items()])
    unknown = F.concat(F.lit("Unsupported file type '"), kind, F.lit(f"'. Supported: {', '.join(sorted(parsers))}"))
    error = F.when(~F.coalesce(kind.isin(*parsers), F.lit(False)), F.coalesce(unknown, F.lit("No file type"))).when(F.col("text").isNull(), "No text content could be extracted")
    return files.withColumn("text", text).withColumn("error", error)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_bytes, sha256, text) of text files; text is null where the bytes aren't UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), decoded_text(F.col("content")).alias("text"))


def count_words(text: str) -> int:
    return len(text.split())


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, length: Callable[[str], int] = count_words, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` by the first separator that occurs, larger ones by those after it; neighbours share up to `overlap`."""
    at = next(i for i, s in enumerate(separators) if s in text)
    separator, rest = separators[at], separators[at + 1 :]
    if separator:
        first, *others = text.split(separator)
        parts = [first, *[separator + p for p in others]]
    else:
        parts = list(text)
    out: list[str] = []
    held: list[tuple[str, int]] = []
    total = 0
    for part in parts:
        n = length(part)
        if n > size and rest:
            out += ["".join(p for p, _ in held)] + split_text(part, size, overlap, length, rest)
            held, total = [], 0
            continue
        if held and total + n > size:
            out.append("".join(p for p, _ in held))
            while held and (total > overlap or total + n > size):
                total -= held.pop(0)[1]
        held.append((part, n))
        total += n
    return [p for p in (x.strip() for x in [*out, "".join(p for p, _ in held)]) if p]


def chunk_recursive(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP, length: Callable[[str], int] = count_words) -> DataFrame:
    """(doc_id, chunk_index, content) of (doc_id, text)."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap, length) if t and t.strip() else [])

    return documents.select("doc_id", F.posexplode(pieces("text")).alias("chunk_index", "content"))


def chunk_windows(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, content): windows of `size` words that share `overlap`, without Python."""
    words = documents.select("doc_id", F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.ceil((F.size("words") - overlap) / (size - overlap)), F.lit(1)) - 1
    starts = words.select("doc_id", "words", F.posexplode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_index", "k"))
    return starts.select("doc_id", "chunk_index", F.array_join(F.slice("words", (F.col("k") * (size - overlap) + 1).cast("int"), size), " ").alias("content"))


def chunk_records(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunks with header, content hash and token count; documents: (doc_id, original_filename)."""
    header = F.concat(F.lit("[Source: "), T.source_label(F.col("original_filename")), F.lit("]\n"), F.col("content"))
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    return chunks.join(documents.select("doc_id", "original_filename"), "doc_id").select("doc_id", "chunk_index", "content", header.alias("content_with_header"), F.sha2("content", 256).alias("content_hash"), words.alias("token_count"))


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """The first chunk of each content within a vault."""
    return chunks.withColumn("_n", F.row_number().over(Window.partitionBy("vault_id", F.sha2("content", 256)).orderBy("doc_id", "chunk_index"))).where("_n = 1").drop("_n")


def _found(text: Column, pattern: str) -> Column:
    hit = F.regexp_extract(text, pattern, 1)
    return F.when(hit != "", hit)


def metadata_from_filename(filename: Column) -> tuple[Column, Column]:
    hits = [(_found(filename, p), kind) for p, kind in NAMES]
    return F.coalesce(*[F.when(h.isNotNull(), kind) for h, kind in hits]), F.coalesce(*[h for h, _ in hits])


def metadata_date(content: Column, filename: Column) -> Column:
    """The order date, or the month of a stock report; dates that don't exist are passed over."""
    kind, _ = metadata_from_filename(filename)
    month = F.when(kind == "stock_report", F.concat(_found(filename, STOCK_MONTH), F.lit("-01")))
    return F.coalesce(F.try_to_date(_found(content, ORDER_DATE), "yyyy-MM-dd"), F.try_to_date(month, "yyyy-MM-dd"))


def metadata_customer(content: Column) -> Column:
    return F.upper(_found(content, CUSTOMER_ID))


def metadata_price(content: Column) -> Column:
    return F.coalesce(*[F.translate(_found(content, p), ",", "").try_cast("double") for p in PRICES])


def merge_metadata(rule: dict[str, Column], model: dict[str, Column]) -> dict[str, Column]:
    """Rules win for identifiers, where they have any; the rest is the model's."""
    some = lambda c: F.when(c.cast("string") != "", c)
    return {k: F.coalesce(rule[k], model[k]) if k == "total_price" else F.coalesce(some(rule[k]), model[k]) if k in rule else model[k] for k in model}


def metadata_chunk(m: dict[str, Column], filename: Column) -> dict[str, Column]:
    """content, content_with_header, content_hash and token_count of a document's metadata as text; null if it has none."""
    line = lambda name, c: F.concat(F.lit(f"- {name}: "), c.cast("string"))
    own = F.concat_ws("\n", line("Document Type", m["document_type"]), line("Entity ID", m["entity_id"]), line("Order Date", m["order_date"]), line("Customer ID", m["customer_id"]), line("Total Price", m["total_price"]))
    some = lambda c: F.when(F.size(c) > 0, c)
    content = F.concat_ws(
        "\n", F.when(own != "", F.concat(F.lit("Structured Metadata:\n"), own)), F.concat(F.lit("Summary: "), m["summary"]), F.concat(F.lit("Keywords: "), F.array_join(some(m["keywords"]), ", ")),
        F.concat(F.lit("Questions this document answers:\n- "), F.array_join(some(m["questions"]), "\n- ")),
    )
    content = F.when(content != "", content)
    name = F.regexp_replace(filename, r"\.[^.]*$", "")
    return {"content": content, "content_with_header": F.concat(F.lit("[Source: "), name, F.lit("]\n"), content), "content_hash": F.sha2(content, 256), "token_count": F.greatest(F.lit(1), F.floor(F.char_length(content) / 4).cast("int"))}


def hashed_vector(text: str, dim: int = 64) -> np.ndarray:
    """A unit vector of hashed words: an embedder that needs no model.

    Words may cancel each other, and a text may have none between odd spaces: then the whole text counts as one word, so
    that only blank texts have no direction.
    """
    v, low = np.zeros(dim), text.lower()

    def add(word: str) -> None:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1 if h >> 63 else -1

    for word in low.split():
        add(word)
    if not v.any() and low.strip(" \t\n\f\r"):
        add(low)
    return v / max(np.linalg.norm(v), 1e-12)


def hashed_embedder(texts: list[str]) -> list[np.ndarray]:
    return [hashed_vector(t) for t in texts]


def retrying(embedder: Callable[[list[str]], list[np.ndarray]], attempts: int = 3, base_delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[np.ndarray]]:
    """The embedder, tried `attempts` times with twice the delay after each; the last error is raised."""

    def run(texts: list[str]) -> list[np.ndarray]:
        for attempt in range(attempts - 1):
            try:
                return embedder(texts)
            except Exception:  # whatever a provider raises may pass
                sleep(base_delay * 2**attempt)
        return embedder(texts)

    return run


def embed(rows: DataFrame, column: str, embedder: Callable[[list[str]], list[np.ndarray]] = hashed_embedder, batch: int = 2048) -> DataFrame:
    """rows with `embedding` and `error`: texts go to the embedder in batches; a batch that fails is tried text by text."""
    schema = rows.withColumns({"embedding": F.lit(None).cast("array<float>"), "error": F.lit(None).cast("string")}).schema

    def tried(texts: list[str]) -> list[tuple]:
        try:
            return [(np.asarray(v, np.float32), None) for v in embedder(texts)]
        except Exception as e:  # a provider's error is the row's, not the job's
            return [(None, str(e)[:500])] if len(texts) == 1 else [r for t in texts for r in tried([t])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[column].fillna("").tolist()
            done = [r for i in range(0, len(texts), batch) for r in tried(texts[i : i + batch])]
            yield frame.assign(embedding=[v for v, _ in done], error=[e for _, e in done])

    return rows.mapInPandas(run, schema)


def embed_distinct(rows: DataFrame, column: str, embedder: Callable[[list[str]], list[np.ndarray]] = hashed_embedder) -> DataFrame:
    """As embed(), each distinct text once; null is as empty."""
    keyed = rows.withColumn("_sha", F.sha2(F.coalesce(column, F.lit("")), 256))
    return keyed.join(embed(keyed.groupBy("_sha").agg(F.first(column).alias("_text")), "_text", embedder).select("_sha", "embedding", "error"), "_sha").drop("_sha")


class Ingested(NamedTuple):
    documents: DataFrame
    chunks: DataFrame
    audit: DataFrame
    dead_letters: DataFrame


#: The values that a model may add to a document's metadata, by default none.
NO_MODEL = {"summary": "string", "keywords": "array<string>", "questions": "array<string>"}


def ingest(
    documents: DataFrame, embedder: Callable[[list[str]], list[np.ndarray]] = hashed_embedder, model: Callable[[Column, Column], dict[str, Column]] | None = None,
    chunker: Callable[[DataFrame], DataFrame] = chunk_recursive, as_of: Column | None = None,
) -> Ingested:
    """The tables that (doc_id, vault_id, original_filename, text, and perhaps status and deleted_at) become.

    Documents deleted meanwhile are passed over. Those without text, or with a chunk that can't be embedded, fail as a
    whole: none of their chunks is kept, and a dead letter says why. The others get metadata by rules and by `model` (of
    file name and text), child chunks, and a last chunk of their metadata.
    """
    gone = F.lit(False)
    if "status" in documents.columns:
        gone |= F.coalesce(F.col("status").isin("pending_delete", "deleted"), F.lit(False))
    if "deleted_at" in documents.columns:
        gone |= F.col("deleted_at").isNotNull()
    name, text = F.col("original_filename"), F.col("text")
    kind, number = metadata_from_filename(name)
    rule = {"document_type": kind, "entity_id": number, "order_date": metadata_date(text, name), "customer_id": metadata_customer(text), "total_price": metadata_price(text)}
    extra = {k: F.lit(None).cast(t) for k, t in NO_MODEL.items()}
    made = {**rule, **extra} if model is None else merge_metadata(rule, {**{k: F.lit(None).cast("string") for k in rule}, **extra, **model(name, text)})
    own = written(documents.where(~gone).select("doc_id", "vault_id", "original_filename", "text", *[c.alias(k) for k, c in made.items()]))
    child = written(chunk_records(chunker(own.where(text.rlike(r"\S")).select("doc_id", "text")), own).withColumn("chunk_type", F.lit("child")))
    counts = child.groupBy("doc_id").agg(F.count("*").alias("n_child"))
    about = metadata_chunk({k: F.col(k) for k in made}, name)
    last = own.join(counts, "doc_id").select("doc_id", F.col("n_child").cast("int").alias("chunk_index"), *[c.alias(k) for k, c in about.items()], F.lit("metadata").alias("chunk_type")).where("content is not null")
    embedded = written(embed(child.unionByName(last), "content_with_header", embedder))
    broken = embedded.groupBy("doc_id").agg(F.max("error").alias("_error"), F.count("*").alias("_n"))
    message = F.when(F.col("_n").isNull(), "No text content could be extracted").when(F.col("_error").isNotNull(), F.substring(F.concat(F.lit("Embedding failed: "), "_error"), 1, 500))
    out = own.join(broken, "doc_id", "left").withColumn("error_message", message).withColumn("status", F.when(F.col("error_message").isNull(), "active").otherwise("failed"))
    out = written(out.withColumn("n_chunks", F.when(F.col("status") == "active", F.col("_n")).otherwise(0)).drop("text", "_error", "_n"))
    chunks = embedded.drop("error").join(out.where("status = 'active'").select("doc_id", "vault_id"), "doc_id")
    audit = E.audit_rows(out.select(F.lit("document.ingested").alias("event_type"), "vault_id", "doc_id", F.create_map(F.lit("status"), "status", F.lit("chunks"), F.col("n_chunks").cast("string")).alias("payload")))
    failed = out.where("status = 'failed'").select(F.to_json(F.struct("doc_id", "vault_id", "original_filename")).alias("value"), "error_message")
    letters = E.dead_letters(failed, "file.events", F.col("error_message"), F.lit("IngestError"), F.current_timestamp() if as_of is None else as_of)
    return Ingested(out, chunks, audit, letters)


def storable(chunks: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks of the documents that can be stored, and (doc_id, n_chunks, error_message) of those that can't.

    A document is stored whole or not at all: not if it went or is going away (no row in documents, status deleted or
    pending_delete, or a deleted_at), and not if a chunk has no vault, index or content, or two have one index.
    """
    gone = F.col("status").isin("pending_delete", "deleted") | F.col("deleted_at").isNotNull()
    state = documents.groupBy(F.col("doc_id").alias("_doc")).agg(F.bool_or(F.coalesce(gone, F.lit(False))).alias("_gone"))
    lacking = F.col("vault_id").isNull() | F.col("chunk_index").isNull() | F.col("content").isNull()
    each = chunks.groupBy("doc_id", "chunk_index").agg(F.count("*").alias("_n"), F.count_if(lacking).alias("_lacking"))
    found = each.groupBy("doc_id").agg(F.sum("_n").alias("n_chunks"), F.max("_n").alias("_most"), F.sum("_lacking").alias("_lacking"))
    found = found.join(state, found["doc_id"] == F.col("_doc"), "left")
    message = F.when(F.col("_gone").isNull(), "No such document").when(F.col("_gone"), "Deleted during ingestion").when(F.col("_lacking") > 0, "A chunk lacks its vault, index or content").when(F.col("_most") > 1, "Two chunks of one index")
    found = written(found.select("doc_id", "n_chunks", message.alias("error_message")), "storable")
    good = chunks.join(found.where("error_message is null").select("doc_id"), "doc_id", "left_semi")
    return good, found.where("error_message is not null")


def write_chunks(chunks: DataFrame, folder: str, documents: DataFrame | None = None) -> DataFrame | None:
    """The chunks of one batch into its folder, by vault; the same batch again replaces itself and no other.

    With documents, only those that can be stored; the others come back as failures, and hold nobody up.
    """
    failed = None
    if documents is not None:
        chunks, failed = storable(chunks, documents)
    chunks.write.mode("overwrite").partitionBy("vault_id").parquet(folder)
    return failed
