from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.odd import LINE, documents, empty, rows

from docspark.llm import chat_format, line_dedup


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(docs):
    holders = defaultdict(list)
    for r in docs:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            holders[k].append(r[0])
    low = lambda x: -1 if x is None else x
    drop = {k: max(map(low, v)) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for r in docs:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if drop.get(key(x), low(r[0])) == low(r[0])]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs):
    out = line_dedup.apply_bitmaps(docs, line_dedup.dropped_bitmaps(docs), "out")
    return sorted(map(tuple, out.select("doc_id", "out.n_lines", "out.n_dropped", F.sha2("out.kept_text", 256)).collect()), key=str)


def test_odd_documents(spark):
    assert run(documents(spark)) == brute(rows())
    assert run(empty(spark)) == []


def test_clashing_names(spark):
    docs = documents(spark)
    names = ["_row", "_bits", "_ROW_", "h1", "salt", "pos", "line", "lines", "n_lines", "n_dropped", "kept_text", "dropped", "row_key"]
    for c in names:
        docs = docs.withColumn(c, F.lit("mine"))
    out = line_dedup.apply_bitmaps(docs, line_dedup.dropped_bitmaps(docs), "out")
    assert out.columns == [*docs.columns, "out"] and {tuple(r) for r in out.select(*names).collect()} == {("mine",) * len(names)}
    assert sorted(map(tuple, out.select("doc_id", "out.n_lines", "out.n_dropped", F.sha2("out.kept_text", 256)).collect()), key=str) == brute(rows())


def test_hot_lines_are_cut_and_runs_are_streamed(spark):
    docs = [(i if i % 7 else None, f"a line that every document has\nline {i % 50:05d} that some have\n{'x' * 30} {i}\na line that every document has") for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    hot = line_dedup._hot(line_dedup.line_hashes(df), 4).collect()
    assert len(hot) == 1 and hot[0].salts > 4
    assert run(df) == brute(docs)
    plan = line_dedup.dropped_bitmaps(df)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Window") :]
    assert "SortMergeJoin" not in plan and below.index("Sort [h1") < below.index("rangepartitioning") and "ArrowEval" not in plan


def test_many_lines_in_one_document(spark):
    docs = [(0, "\n".join(f"shared line number {i % 300:05d} of many" for i in range(2000))), (1, "\n".join(f"shared line number {i:05d} of many" for i in range(150))), (2, "\n".join(f"  SHARED line number {i:05d} of many " for i in range(0, 300, 2))), (3, LINE)]
    assert run(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


@given(st.lists(st.tuples(st.text(alphabet="a<\\\n/turn>lné"), st.text(alphabet="a<\\\n/turn>lnéŉ😀")), min_size=1, max_size=6))
def test_format_round_trip(turns):
    import numpy as np
    import pyarrow as pa

    roles, texts = zip(*turns)
    formatted, _ = chat_format.assemble(pa.array(roles), pa.array(texts), np.array([0]))
    assert chat_format.parse(formatted[0].as_py()) == list(turns)


@pytest.mark.parametrize("batch", [2, 10000])
def test_conversations(spark, batch, monkeypatch):
    monkeypatch.setattr(chat_format, "TOGETHER", 8)
    turns = [(1, 1, "assistant", None), (1, 0, "user", "<hi> \\l"), (2, 0, None, ""), (None, 5, "assistant", "x\ny"), (None, None, "a\nssistant", "é\\n"), (1, 1, "assistant", "again </turn>"), (1, 1, "assistant", "again </turn>"), (3, 0, "assistant", "日本<"), (4, 0, "assistant", "b" * 5000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
        got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
        none = chat_format.read_back(chat_format.format_conversations(df.limit(0))).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    low = lambda x: (x is not None, x)
    assert none == 0 and len(got) == 5
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: tuple(map(low, t)))
        said = "".join(t[3] or "" for t in own if t[2] == "assistant")
        want = hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), want, len(said), hashlib.sha256(said.encode()).hexdigest())
