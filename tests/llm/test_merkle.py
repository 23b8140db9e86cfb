"""The Merkle manifest against a plain tree and SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.llm.odd import documents, empty

from docspark.llm import merkle as M

D = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """(root, siblings of each leaf by level as (left, right))."""
    now, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(now) > 1:
        for i, p in enumerate(at):
            run = now[p // 8 * 8 : p // 8 * 8 + 8]
            paths[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        now, at = [H(*now[i : i + 8]) for i in range(0, len(now), 8)], [p // 8 for p in at]
    return now[0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, H(*map(enc, r)), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, above = tree([trees[g][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for (has, number, h, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            path, f = path + above[k], h
            if has and zlib.crc32(str(number).encode()) % 3 == 0:
                f = H(*map(enc, (*r[:4], r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))))
            for left, right in path:
                f = H(left, f, right)
            out.append((r[0], h, trees[g][0], root, H("".join(a + b for a, b in path)), f, f == root))
    return sorted(out, key=str)


def rows_of(df):
    return [tuple(r) for r in df.select(*M.FIELDS).collect()]


def run(df, spark, tmp_path):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in M.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def test_equals_sql_and_the_plain_tree(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    got = M.op13_merkle_manifest(spark, D)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({M.ORACLE})").fetchall())
    assert rows == sorted(brute(rows_of(spark.read.parquet(f"{D}/documents.parquet"))))


def test_odd_and_empty(spark, tmp_path):
    docs = documents(spark).withColumns({"group": F.lit("g"), "h": F.lit(1), "path": F.lit(2), "digit": F.lit(3), "tree": F.lit(4)})
    got = run(docs, spark, tmp_path)
    assert got == brute(rows_of(docs)) and len(got) == docs.count()
    assert run(empty(spark), spark, tmp_path) == []


@pytest.mark.parametrize("digits", [1, 3])
def test_sizes_at_the_edges(spark, tmp_path, monkeypatch, digits):
    """Groups of 1, 7, 8, 9, 64, 65, 512 and 513 rows and more groups than one node holds, with small and with full blocks."""
    monkeypatch.setattr(M, "DIGITS", digits)
    monkeypatch.setattr(M, "BLOCK", M.FANOUT**digits)
    rows = [(1000 * k + i, "s", None if k == 3 else f"é{k}", i, f"Text {i}") for k, n in enumerate([1, 7, 8, 9, 64, 65, 512, 513, 1, 2, 3]) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert run(docs, spark, tmp_path) == brute(rows)


def test_equal_rows_of_one_key(spark, tmp_path):
    """A third of all rows alike, without an id."""
    rows = [(None, None, "en", None, None)] * 700 + [(i, "s", "en", 1, "A") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert run(docs, spark, tmp_path) == brute(rows)


def test_only_what_is_tampered_with_fails(spark):
    rows = M.op13_merkle_manifest(spark, D).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    for r in rows:
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in texts[r.doc_id] or "")
        assert r.verified != changed


def test_digits_are_grouped_away_without_another_exchange(spark):
    nodes = spark.range(5000).select(F.concat(F.lit("g"), F.col("id") % 3).alias("group"), F.col("id").alias("rank"), F.lit(5000).cast("long").alias("count"), F.sha2(F.col("id").cast("string"), 256).alias("h"), F.col("id").alias("item"))
    plan = M.rolled(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Python" not in plan
