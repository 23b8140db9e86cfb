"""The given tables as the engine's inputs: document metadata, statements, chunks, queries, segments.

Each is one SELECT that Spark and DuckDB both run; `{us}` is the dialect's microseconds since the epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MONTHS = "(VALUES (0,'January'),(1,'February'),(2,'March'),(3,'April'),(4,'May'),(5,'June'),(6,'July'),(7,'August'),(8,'September'),(9,'October'),(10,'November'),(11,'December'))"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "doc_meta": (
        ("orders", "customer"),
        """
        SELECT o.o_orderkey AS doc_id, o.o_custkey % 8 AS vault_id,
          CONCAT(CASE o.o_orderstatus WHEN 'F' THEN 'invoice' WHEN 'O' THEN 'purchase_orders' ELSE CASE WHEN o.o_orderkey % 10 = 0 THEN 'StockReport' ELSE 'order' END END, '_', CAST(10000 + o.o_orderkey AS STRING), '.pdf') AS original_filename,
          CASE o.o_orderstatus WHEN 'F' THEN 'invoice' WHEN 'O' THEN 'purchase_order' ELSE CASE WHEN o.o_orderkey % 10 = 0 THEN 'stock_report' ELSE 'shipping_order' END END AS document_type,
          CAST(10000 + o.o_orderkey AS STRING) AS entity_id,
          CASE WHEN o.o_custkey % 8 = 6 AND o.o_orderkey % 5 = 0 THEN NULL ELSE CAST(o.o_orderdate + INTERVAL '15' YEAR AS DATE) END AS order_date,
          c.c_mktsegment AS customer_id,
          CASE WHEN o.o_custkey % 8 = 7 AND o.o_orderkey % 5 = 0 THEN NULL ELSE o.o_totalprice END AS total_price,
          CASE o.o_orderkey % 40 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'ingesting' WHEN 3 THEN 'pending_delete' WHEN 4 THEN 'deleted' ELSE 'active' END AS status,
          CASE WHEN o.o_orderkey % 40 = 4 THEN CAST(o.o_orderdate + INTERVAL '16' YEAR AS TIMESTAMP) END AS deleted_at,
          CAST(o.o_orderdate AS TIMESTAMP) AS updated_at
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
        """,
    ),
    "statements": (
        ("orders",),
        f"""
        SELECT o_orderkey AS statement_id, o_orderkey % 8 AS vault_id,
          CASE o_orderkey % 6
           WHEN 0 THEN CONCAT('How many invoices from ', m.name, ' ', CAST(2010 + o_orderkey % 7 AS STRING))
           WHEN 1 THEN CONCAT('The total price of all purchase orders from Q', CAST(1 + o_orderkey % 4 AS STRING), ' ', CAST(2010 + o_orderkey % 7 AS STRING))
           WHEN 2 THEN CONCAT('List every shipping order for customer BUILDING from ', CAST(2010 + o_orderkey % 7 AS STRING))
           WHEN 3 THEN CONCAT('The average total of all invoices for customer MACHINERY in ', m.name, ' ', CAST(2010 + o_orderkey % 7 AS STRING))
           WHEN 4 THEN 'What documents do we have in the vault?'
           ELSE CONCAT('The total of invoice ', CAST(10000 + o_orderkey AS STRING), ' is $1,', CAST(100 + o_orderkey % 900 AS STRING)) END AS text
        FROM {{orders}} JOIN {MONTHS} AS m(i, name) ON o_orderkey % 12 = m.i
        """,
    ),
    "chunks": (
        ("documents", "embeddings"),
        """
        SELECT d.doc_id AS chunk_id, d.doc_id, d.doc_id % 4 AS vault_id, 0 AS chunk_index, d.text AS content,
          CONCAT('[Source: ', d.source, ' ', CAST(10000 + d.doc_id AS STRING), ']', CHR(10), d.text) AS content_with_header,
          d.doc_id % 25 = 3 AS is_deleted, CASE WHEN d.doc_id % 30 = 7 THEN 'failed' ELSE 'active' END AS status, e.embedding
        FROM {documents} d LEFT JOIN {embeddings} e ON d.doc_id = e.vec_id
        """,
    ),
    "queries": (
        ("benchmark", "embeddings"),
        "SELECT b.item_id AS query_id, b.item_id % 4 AS vault_id, b.text AS query_text, e.embedding AS query_vec FROM {benchmark} b JOIN {embeddings} e ON b.item_id = e.vec_id",
    ),
    "segments": (
        ("events",),
        """
        SELECT user_id AS session_id, event_id,
          CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS segment_index,
          CAST(event_id % 3 AS INT) AS speaker,
          ROUND(CAST({us} - MIN({us}) OVER (PARTITION BY user_id) AS DOUBLE) / 1e10, 3) AS start_s,
          event_id % 11 <> 0 AS is_final, ROUND(0.3e0 + (event_id % 70) / 1e2, 2) AS confidence,
          CASE event_id % 4
           WHEN 0 THEN CONCAT('invoice ', CAST(10000 + event_id AS STRING), ' total is $', CAST(value AS STRING))
           WHEN 1 THEN 'yes right'
           WHEN 2 THEN CONCAT('we shipped order ', CAST(10000 + event_id % 200 AS STRING), ' in march')
           ELSE CONCAT('so the ', event_type, ' went fine i think') END AS text
        FROM {events}
        """,
    ),
    "vaults": (
        ("nation",),
        "SELECT CAST(n_nationkey AS BIGINT) AS vault_id, n_regionkey AS owner_id, n_name AS name, n_nationkey % 9 <> 8 AS is_active, MAKE_TIMESTAMP(2010 + n_nationkey % 8, 1 + n_nationkey % 12, 3, 4, 5, 6) AS updated_at FROM {nation}",
    ),
    "vault_members": (
        ("customer",),
        "SELECT c_custkey % 30 AS vault_id, c_custkey AS user_id, CASE c_custkey % 5 WHEN 0 THEN 'owner' WHEN 1 THEN 'editor' WHEN 2 THEN 'viewer' WHEN 3 THEN 'viewer' ELSE 'guest' END AS role FROM {customer}",
    ),
    "sessions": (
        ("customer",),
        """
        SELECT c_custkey AS session_id, c_custkey % 8 AS vault_id, c_custkey % 97 AS user_id, CONCAT('Call with ', c_name, ' about ', c_mktsegment) AS title,
          CASE c_custkey % 4 WHEN 0 THEN 'recording' WHEN 1 THEN 'failed' ELSE 'completed' END AS status,
          CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE ROUND(ABS(c_acctbal), 1) END AS duration_seconds,
          MAKE_TIMESTAMP(2024, CAST(1 + c_custkey % 12 AS INT), CAST(1 + c_custkey % 28 AS INT), CAST(c_custkey % 24 AS INT), CAST(c_custkey % 60 AS INT), 0) AS started_at
        FROM {customer}
        """,
    ),
    "turns": (("conversations",), "SELECT conv_id, turn, role, text FROM {conversations}"),
}
_SPARK_US, _DUCK_US = "unix_micros(CAST(ts AS TIMESTAMP))", "epoch_us(ts)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or one of VIEWS over given tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, sql = VIEWS[name]
    return spark.sql(sql.replace("{us}", _SPARK_US), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in needs})


def cte(*names: str) -> str:
    """WITH clauses of views, in DuckDB's dialect."""
    parts = []
    for name in names:
        needs, sql = VIEWS[name]
        sql = sql.replace("{us}", _DUCK_US).replace("MAKE_TIMESTAMP", "make_timestamp")
        for t in needs:
            sql = sql.replace(f"{{{t}}}", t)
        parts.append(f"{name}_v AS ({sql})")
    return "WITH " + ",\n".join(parts)
