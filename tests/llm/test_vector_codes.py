"""Vector codes against plain Python and SQL."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import vector_codes as V

D = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """Contract rows by trying every entry: {(vec_id, ints): (code, error)}, sums by label and the digest."""
    kept = [(i, tuple(math.floor(1024 * float(x)) for x in v), label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], ""
    d = len(kept[0][1]) // parts
    cut = [[r[1][p * d : (p + 1) * d] for r in kept] for p in range(parts)]
    books = [own[:entries] for own in map(list, cut)]
    choose = lambda p, x: min(((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])))
    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for x in cut[p]:
                of[choose(p, x)[1]].append(x)
            books[p] = [tuple(sum(c) // len(of[k]) for c in zip(*of[k])) if k in of else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], defaultdict(int)
    for j, (i, _, label) in enumerate(kept):
        found = [choose(p, cut[p][j]) for p in range(parts)]
        out.append([i, "".join(f"{k:02x}" for _, k in found), sum(x for x, _ in found), label])
        sums[label] += out[-1][2]
    return sorted(((i, c, e, sums[label], digest) for i, c, e, label in out), key=str), digest


def run(spark, rows, tmp_path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return sorted((tuple(r) for r in V.op12_vector_codes(spark, str(tmp_path)).collect()), key=str)


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{D}/embeddings.parquet'")
    got = V.op12_vector_codes(spark, D)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({V.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_odd_rows(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, [r.choice([0.0, 0.5, -0.25, 0.001, -0.0005]) for _ in range(8)], r.choice([1, 2, None])) for i in range(300)]
    rows += [(1000, None, 1), (1001, [0.1] * 7 + [None], 1), (1002, [float("nan")] * 8, 2), (1003, [float("-inf")] + [0.0] * 7, 2)]
    rows += [rows[0], rows[0], (None, [0.25] * 8, None), (7, [9.0] * 8, 3), (7, [-9.0] * 8, 3)]
    got = run(spark, rows, tmp_path)
    assert got == brute(rows)[0]
    # Rows and extra columns in any order change nothing.
    r.shuffle(rows)
    more = [(*x, "c", 1, [2]) for x in rows]
    assert run(spark, more, tmp_path, SCHEMA + ", code string, error long, ints array<int>") == got


def test_few_empty_and_unequal(spark, tmp_path):
    assert run(spark, [], tmp_path) == []
    assert run(spark, [(1, None, 1)], tmp_path) == []
    few = [(1, [0.1, 0.2, 0.3, 0.4], 1), (2, [0.5, 0.1, 0.0, -0.4], 1)]
    assert run(spark, few, tmp_path) == brute(few)[0]
    assert run(spark, [(1, [], 1)], tmp_path)[0][:4] == (1, "00000000", 0, 0)
    odd = run(spark, [*few, (3, [0.1] * 8, 2), (0, [1e9, 0.0, 0.0, 0.0], 2)], tmp_path)
    assert [x[:4] for x in odd if x[0] in (0, 3)] == [(0, None, None, None), (3, None, None, None)]
    assert [x for x in odd if x[0] in (1, 2)] == brute(few)[0]
    with pytest.raises(ValueError, match="equal parts"):
        run(spark, [(1, [0.1] * 6, 1)], tmp_path)


def test_search_equals_all_entries_and_looks_at_few():
    rng = np.random.default_rng(3)
    entries = np.sort(rng.integers(-2000, 2000, (256, 1)), 0) + rng.integers(-30, 30, (256, 16))
    book, looked = V.SortedBook(entries), 0
    parts = np.r_[entries[rng.integers(0, 256, 500)] + rng.integers(-9, 9, (500, 16)), rng.integers(-3000, 3000, (50, 16)), entries[:40], np.repeat(entries[:1], 9, 0)]
    chosen, best = book.nearest(parts)
    every = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (chosen == every.argmin(1)).all() and (best == every.min(1)).all()
    # Ties, and gaps that equal the bound: constant vectors have |sum gap|^2 / d equal to their distance.
    flat = np.repeat(np.array([[4], [0], [2], [2], [-2]]), 4, 1)
    chosen, best = V.SortedBook(flat).nearest(np.repeat(np.array([[1], [3], [2], [-1]]), 4, 1))
    assert chosen.tolist() == [1, 0, 2, 1] and best.tolist() == [4, 4, 0, 4]


def test_hot_labels_meet_no_join(spark, tmp_path):
    rows = [(i, f"{i % 7:02x}", i % 7, 1 if i % 3 else None if i % 2 else i) for i in range(2000)]
    spark.createDataFrame(rows, "vec_id long, code string, error long, label int").write.parquet(str(tmp_path / "c"))
    got = {(r.vec_id, r.label_error) for r in V.with_label_error(spark.read.parquet(str(tmp_path / "c"))).collect()}
    sums = defaultdict(int)
    for _, _, e, label in rows:
        sums[label] += e
    assert got == {(i, sums[label]) for i, _, _, label in rows}


def test_query_names_its_columns(spark):
    assert V.op12_vector_codes(spark, D).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert V.op12_vector_codes(spark, D).where(F.col("code").isNull()).count() == 0
