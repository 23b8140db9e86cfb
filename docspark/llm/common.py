"""Helpers that several operators of this folder use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.sources import shared
from docspark.sources.shared import temporary as temporary

#: ASCII white space, as a character class and as the pattern of a separator.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no rerun."""
    return shared.written(df, name)


def release(df: DataFrame) -> None:
    """Delete what materialize() wrote, once no later plan reads it."""
    shared.delete(df.sparkSession, df._docspark_path)


def free(name: str, columns: list[str]) -> str:
    """`name`, or the first longer one that none of the columns has in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def look_up(rows: DataFrame, found: DataFrame, key: str, total: int, share: int = 256) -> DataFrame:
    """rows joined with found (key, n_rows, ...), a row for each key: n_rows is how many rows have it, total the number of rows.

    Keys that one row in `share` has, so at most `share` keys, are sent to all tasks: their rows aren't shuffled.
    """
    hot = F.col("n_rows") * share >= total
    many, few = found.where(hot).drop("n_rows"), found.where(~hot).drop("n_rows")
    out = rows.join(F.broadcast(many), key)
    return out.unionByName(rows.join(F.broadcast(many.select(key)), key, "left_anti").join(few, key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: list[str], order: list[Column], spread: Column, most: int, each: int = 100_000) -> DataFrame:
    """Add `rank`, from 0 and gapless within keys, without sorting any key's rows in one task.

    most: rows of the largest key. Rows of a key are dealt to buckets by `spread` (a long), so many that even the largest
    key's have about `each` rows; the bucket counts give where each bucket's ranks begin, and rows are ordered within
    their bucket only. df is read twice: pass a written table.
    """
    buckets = max(256, -(-most // each))
    dealt = df.withColumn("_bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    begins = (
        dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_begin", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), F.coalesce("_begin", F.lit(0)).alias("_begin"))
    )
    within = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    on = [within[k].eqNullSafe(begins[f"_k_{k}"]) for k in keys]
    return (
        within.join(begins, [*on, within["_bucket"] == begins["_b"]])
        .withColumn("rank", F.col("_begin") + F.col("_row") - 1)
        .drop("_bucket", "_row", "_begin", "_b", *[f"_k_{k}" for k in keys])
    )
