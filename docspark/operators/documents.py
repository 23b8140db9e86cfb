"""Operators on document, vault and member tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as T

ALLOWED_TYPES, MAX_BYTES = ("pdf", "txt", "md"), 50 * 1024 * 1024
ROLES = {"owner": 3, "editor": 2, "viewer": 1}


def is_live(active: bool = True) -> Column:
    """Not deleted and, unless active is false, in use."""
    live = F.col("deleted_at").isNull()
    return live & (F.col("status") == "active") if active else live


def matches(doc_type: Column, date_from: Column, date_to: Column, customer: Column) -> Column:
    """A document's agreement with parsed filters, each of which may be null. % and _ in a customer match any text or letter."""
    like = F.like(F.lower("customer_id"), F.lower(customer))
    return (
        (doc_type.isNull() | (F.col("document_type") == doc_type)) & (customer.isNull() | like)
        & (date_from.isNull() | (F.col("order_date") >= date_from)) & (date_to.isNull() | (F.col("order_date") <= date_to))
    )


def upload_admission(uploads: DataFrame) -> DataFrame:
    """uploads (filename, n_bytes) with extension, reject_reason (null if admitted) and storage_path (vault_id, sha256)."""
    extension = T.file_extension(F.col("filename"))
    reason = (
        F.when(F.col("filename").isNull() | (F.col("filename") == ""), "Filename is required").when(~extension.isin(*ALLOWED_TYPES), "Unsupported file type")
        .when(F.col("n_bytes") == 0, "File is empty").when(F.col("n_bytes") > MAX_BYTES, "File exceeds 50MB limit")
    )
    return uploads.withColumns({"extension": extension, "reject_reason": reason, "storage_path": F.concat_ws("/", F.col("vault_id").cast("string"), "sha256", "filename")})


def upload_dedup(uploads: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first upload of each (vault_id, sha256) that no live document has; and the deleted twins (doc_id) that are purged."""
    first = uploads.withColumn("_n", F.row_number().over(Window.partitionBy("vault_id", "sha256").orderBy("upload_id"))).where("_n = 1").drop("_n")
    kept = first.join(stored.where("deleted_at is null"), ["vault_id", "sha256"], "left_anti")
    return kept, stored.where("deleted_at is not null").join(kept.select("vault_id", "sha256"), ["vault_id", "sha256"], "left_semi").select("doc_id")


def admit_upload_events(events: DataFrame, documents: DataFrame, vaults: DataFrame, files: DataFrame) -> DataFrame:
    """events (doc_id, vault_id, storage_path) with outcome; each repeated event has the same one."""
    d = documents.select("doc_id", F.lit(1).alias("_known"), "status", "deleted_at")
    v = vaults.select("vault_id", F.col("is_active").alias("_vault"))
    f = files.select("storage_path", F.lit(1).alias("_file"))
    deleted = F.col("status").isin("pending_delete", "deleted") | F.col("deleted_at").isNotNull()
    outcome = (
        F.when(F.col("_known").isNull(), "orphan").when(F.col("status") == "active", "already_active").when(deleted, "deleted")
        .when(~F.coalesce("_vault", F.lit(False)), "vault_inactive").when(F.col("_file").isNull(), "file_missing").otherwise("admit")
    )
    joined = events.join(d, "doc_id", "left").join(v, "vault_id", "left").join(f, "storage_path", "left")
    return joined.select(*events.columns, outcome.alias("outcome"))


def recover_stuck(documents: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    late = F.col("updated_at") < as_of - F.expr(f"INTERVAL {minutes} MINUTES")
    return documents.where(F.col("status").isin("pending", "ingesting") & late & F.col("deleted_at").isNull())


def vault_access(requests: DataFrame, vaults: DataFrame, members: DataFrame) -> DataFrame:
    """requests (vault_id, user_id, min_role) with outcome."""
    rank = lambda c: F.coalesce(T.label(c, ROLES), F.lit(0))
    v = vaults.where("is_active").select("vault_id", F.lit(1).alias("_vault"))
    m = members.select("vault_id", "user_id", F.col("role").alias("_role"))
    outcome = F.when(F.col("_vault").isNull(), "not_found").when(F.col("_role").isNull(), "not_member").when(rank(F.col("_role")) < rank(F.col("min_role")), "insufficient").otherwise("ok")
    return requests.join(v, "vault_id", "left").join(m, ["vault_id", "user_id"], "left").select(*requests.columns, outcome.alias("outcome"))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 200, by: str | None = None) -> DataFrame:
    """One page of each `by` group, with the group's total beside it."""
    ordered = Window.partitionBy(by).orderBy(*order)
    n, cut = F.row_number().over(ordered), min(limit, most)
    totals = df.groupBy(by).agg(F.count("*").alias("total"))
    return df.withColumn("position", n).where((F.col("position") > offset) & (F.col("position") <= offset + cut)).join(totals, by)


def vault_stats(vaults: DataFrame, documents: DataFrame) -> DataFrame:
    """vaults with document_count, of those that aren't deleted, and the later of its own and its documents' change."""
    s = documents.where("deleted_at is null").groupBy("vault_id").agg(F.count("*").alias("document_count"), F.max("updated_at").alias("_latest"))
    return vaults.join(s, "vault_id", "left").withColumns({"document_count": F.coalesce("document_count", F.lit(0)), "updated_at": F.greatest("updated_at", F.coalesce("_latest", "updated_at"))}).drop("_latest")


def dashboard(stats: DataFrame) -> DataFrame:
    """One row: vault_count, total_documents, largest and latest vault (the first on ties)."""
    return stats.agg(
        F.count("*").alias("vault_count"), F.sum("document_count").alias("total_documents"),
        F.max_by("name", F.struct("document_count", -F.col("vault_id"))).alias("largest_vault"), F.max_by("name", F.struct("updated_at", -F.col("vault_id"))).alias("latest_vault"),
    )


def deletions(documents: DataFrame, events: DataFrame) -> DataFrame:
    """(doc_id, vault_id, at) of the documents that delete events (doc_id, at) hit: the first event counts; unknown ids and documents already deleted are let be."""
    first = events.groupBy("doc_id").agg(F.min("at").alias("at"))
    return documents.where("deleted_at is null").select("doc_id", "vault_id").join(first, "doc_id")


def apply_deletes(documents: DataFrame, events: DataFrame) -> DataFrame:
    """documents after delete events (doc_id, at)."""
    hit = deletions(documents, events).select("doc_id", F.col("at").alias("_at"))
    after = {"status": F.when(F.col("_at").isNotNull(), "deleted").otherwise(F.col("status")), "deleted_at": F.coalesce("_at", "deleted_at"), "updated_at": F.coalesce("_at", "updated_at")}
    return documents.join(hit, "doc_id", "left").withColumns(after).drop("_at")


def delete_chunks(chunks: DataFrame, hit: DataFrame) -> DataFrame:
    """chunks with those of deletions() marked as deleted; nothing is taken away."""
    gone = hit.select("doc_id", F.lit(True).alias("_gone"))
    return chunks.join(gone, "doc_id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_gone", F.lit(False))).select(*chunks.columns)


def touch_vaults(vaults: DataFrame, changes: DataFrame) -> DataFrame:
    """vaults whose updated_at is that of their last change (vault_id, at), if that is later."""
    last = changes.groupBy("vault_id").agg(F.max("at").alias("_at"))
    return vaults.join(last, "vault_id", "left").withColumn("updated_at", F.greatest("updated_at", F.coalesce("_at", "updated_at"))).select(*vaults.columns)


def violations(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail, by commas; empty if none does. A check that is null fails."""
    return F.concat_ws(", ", *[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()])


def query_checks(text: Column, top_k: Column, role: Column, n_history: Column) -> dict[str, Column]:
    return {"query": F.char_length(F.trim(text)).between(1, 2000), "top_k": top_k.between(1, 20), "role": role.isin("user", "assistant"), "history": n_history <= 50}


def name_check(name: Column, most: int = 255) -> Column:
    """A vault's name or a session's title: not blank and not too long."""
    return F.char_length(F.trim(name)).between(1, most)


def ingest_outcomes(documents: DataFrame, parsed: DataFrame) -> DataFrame:
    """documents after an ingest of parsed (doc_id, text): active, failed on blank text, let be if deleted meanwhile or not queued."""
    queued = F.col("status").isin("pending", "ingesting") & F.col("deleted_at").isNull() & F.col("_seen").isNotNull()
    blank = F.trim(F.coalesce("_text", F.lit(""))) == ""
    p = parsed.select("doc_id", F.col("text").alias("_text"), F.lit(1).alias("_seen"))
    return documents.join(p, "doc_id", "left").withColumn("status", F.when(queued, F.when(blank, "failed").otherwise("active")).otherwise(F.col("status"))).drop("_text", "_seen")
