"""Operators that SQL doesn't check: golden values and plain versions."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import aggregates, claims, transcripts, events, ingest, retrieval
from docspark.streaming.sessions import CHARS, IDLE, INTERVAL, Buffer


@pytest.mark.parametrize("text,want", [("10,248", "10248"), ("1,2,3", "12,3"), ("a,b 1,000,000", "a,b 1000000")])
def test_normalize_numbers(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.normalize_numbers(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    "text,kind",
    [
        ("the total price of the order for Yang Wang", "point"), ("How many invoices from July 2016", "aggregate"), ("The average total of all invoices in May 2016", "compute"),
        ("this order lists all items", "point"), ("What documents do we have in the vault?", "aggregate"), ("invoice 10248 was late", "point"),
    ],
)
def test_classes(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(T.classify_query(F.col("t"))).first()[0] == kind


@pytest.mark.parametrize("text,want", [("invoices from July 2016", ("2016-07-01", "2016-07-31")), ("2017", ("2017-01-01", "2017-12-31")), ("Q3 2016", ("2016-07-01", "2016-09-30")), ("July", (None, None)), ("q1 march 2020", ("2020-01-01", "2020-03-31"))])
def test_date_ranges(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(*[d.cast("string") for d in T.parse_date_range(F.col("t"))]).first()
    assert tuple(row) == want


def test_months_keep_statements_apart(spark):
    rows = [(1, 0, "all invoices from july 2016"), (1, 1, "all invoices from august 2016"), (1, 2, "All invoices from July 2016!"), (2, 0, "all invoices from july 2016")]
    df = spark.createDataFrame(rows, "session_id long, segment_index int, text string")
    assert sorted((r.session_id, r.segment_index) for r in claims.dedup_claims(df).collect()) == [(1, 0), (1, 1), (2, 0)]


def plain_mmr(query, vectors, k, weight):
    unit = lambda x: x / np.linalg.norm(x)
    query, vectors, out = unit(query), [unit(v) for v in vectors], []
    while len(out) < min(k, len(vectors)):
        best, score = None, -math.inf
        for i, v in enumerate(vectors):
            if i in out:
                continue
            s = v @ query if not out else weight * (v @ query) - (1 - weight) * max(v @ vectors[j] for j in out)
            if s > score:
                best, score = i, s
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_mmr(seed):
    rng = np.random.default_rng(seed)
    vectors, query = rng.normal(size=(20, 8)), rng.normal(size=8)
    vectors[7] = vectors[3]
    assert retrieval.mmr_order(query, vectors, 6, 0.7) == plain_mmr(query, vectors, 6, 0.7)


def test_split_text():
    text = "\n\n".join(f"Paragraph {i} has " + " ".join(f"w{j}" for j in range(i % 40)) for i in range(60)) + "\n\n" + " ".join(f"x{j}" for j in range(300))
    pieces = ingest.split_text(text, 50, 10)
    assert all(0 < ingest.count_words(p) <= 50 for p in pieces)
    words = {w for p in pieces for w in p.split()}
    assert words == set(text.split())
    assert ingest.split_text("  \n\n ") == [] and ingest.split_text("one two", 5, 1) == ["one two"]
    assert all(len(p) <= 10 for p in ingest.split_text("abcdefghij" * 5, 10, 3, len))


def test_embedder_errors_stay_with_their_rows(spark):
    def picky(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return ingest.hashed_embedder(texts)

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None), (4, "good")], "id long, text string").coalesce(1)
    got = {r.id: r for r in ingest.embed(df, "text", picky).collect()}
    assert [got[i].error for i in (1, 2, 3, 4)] == [None, "no", None, None] and got[2].embedding is None and got[1].embedding == got[4].embedding


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿one\r\ntwo\rthree".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe broken")
    got = {r.path[-5:]: r.text for r in ingest.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "one\ntwo\nthree", "b.txt": None}


def test_malformed_events(spark):
    good = '{"event_type":"file.deleted","doc_id":"1","vault_id":"2","deleted_by":"u","timestamp":"2024-01-01T00:00:00Z"}'
    rows = [good, good[:-5], "[]", "", None, good.replace("deleted_by", "x"), good.replace("file.deleted", "file.moved")]
    got = events.decode(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [r.malformed for r in got] == [False] + [True] * 6


def plain_batches(rows):
    """The live rule, second by second."""
    out, unchecked, checked = [], [], 0.0
    rows, t = list(rows), 0
    end = rows[-1][1] + 20
    while t <= end:
        while rows and rows[0][1] <= t:
            unchecked.append(rows.pop(0))
        if unchecked and t > checked and (t - unchecked[-1][1] >= IDLE or (t - checked >= INTERVAL and sum(r[2] for r in unchecked) >= CHARS)):
            out.append((t, unchecked[0][0], unchecked[-1][0]))
            unchecked, checked = [], float(t)
        t += 1
    return out


@pytest.mark.parametrize("seed", range(20))
def test_claim_batches_equal_the_clock(seed):
    rng = random.Random(seed)
    t, rows = 0.5, []
    for i in range(60):
        t = round(t + rng.choice([0.2, 0.7, 1.3, 2.0, 2.4, 5, 9]), 3)
        rows.append((i, t, rng.choice([3, 10, 40])))
    buffer, got = Buffer(), []
    for r in rows:
        got += buffer.add(*r)
        buffer = Buffer(buffer.save())
    got += buffer.tick_to(math.inf)
    assert [(r[1], r[2], r[3]) for r in got] == plain_batches(rows)


def test_customer_filters_match_names_and_patterns(spark):
    """Plain names match in any case, % and _ as patterns, and a null filter everything."""
    docs = spark.createDataFrame([(i, 1, c) for i, c in enumerate(["ACME", "acme", "Acmes", "A_ME", None])], "doc_id long, vault_id long, customer_id string")
    for wanted, expected in [("ACME", {0, 1}), ("acme%", {0, 1, 2}), ("a_me", {0, 1, 3}), ("none", set())]:
        asked = spark.createDataFrame([(1, None, None, None, wanted)], "vault_id long, doc_type string, date_from date, date_to date, customer string")
        found = docs.join(aggregates.wanted(asked, docs).select("wanted"), F.lower("customer_id") == F.col("wanted"))
        assert {r["doc_id"] for r in found.collect()} == expected, wanted


def test_near_duplicate_pairs_equal_all_pairs(spark):
    """Pruning by prefix, size and position loses no pair, also at exactly the threshold."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.sample(words, rng.randint(1, 12))) for _ in range(60)]
    for text in list(texts):  # one word less, one word more, one replaced
        parts = text.split()
        texts += [" ".join(parts[1:]), text + " x1", " ".join(["y1", *parts[1:]])]
    bags = {i: frozenset(t.split()) for i, t in enumerate(texts) if t.split()}
    once = {b: min(i for i, x in bags.items() if x == b) for b in set(bags.values())}
    expected = {(i, j) for x, i in once.items() for y, j in once.items() if i < j and 5 * len(x & y) >= 4 * len(x | y)}
    rows = spark.createDataFrame(list(enumerate(texts)), "statement_id long, text string")
    found = claims.near_duplicate_pairs(rows).collect()
    assert {(r["a"], r["b"]) for r in found} == expected and len(found) == len(expected) and expected


def test_near_duplicate_members_hold_every_copy(spark):
    """Copies without another near text have their class, and so has each copy of a linked text."""
    texts = ["a b c d e", "only copies here", "a b c d e", "only copies here", "e d c b a f", "", None, "alone", "only copies here", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "statement_id long, text string")
    found = {r["statement_id"]: (r["class_id"], r["n_links"]) for r in claims.near_duplicate_members(rows).collect()}
    assert found == {0: (0, 1), 1: (1, 0), 2: (0, 1), 3: (1, 0), 4: (4, 1), 5: (5, 0), 6: (6, 0), 7: (7, 0), 8: (1, 0), 9: (9, 0)}


def test_hot_session_is_not_one_group(spark):
    """dedup_claims and align_statements equal their plain rules, and neither plan joins or groups by session alone with texts as they are."""
    from docspark.operators import transcripts

    rng = random.Random(8)
    words = [f"w{i}" for i in range(25)]
    texts = [" ".join(rng.sample(words, rng.randint(4, 12))) for _ in range(25)] + ["", "zz"]
    rows = []
    for i in range(160):
        parts = rng.choice(texts).split()
        if parts and rng.random() < 0.5:
            parts[rng.randrange(len(parts))] = rng.choice(words)
        rows.append((i % 2, i, rng.choice([0, 1, 2, None]), " ".join(parts), float(i), i + 0.5))
    df = spark.createDataFrame(rows, "session_id long, segment_index int, speaker int, text string, start_s double, end_s double")
    kept = {0: [], 1: []}
    for session, i, _, text, *_ in rows:
        bag = set(text.split())
        if not any(bag & x and 5 * len(bag & x) >= 4 * len(bag | x) for _, x in kept[session]):
            kept[session].append((i, bag))
    found = claims.dedup_claims(df)
    assert sorted(r["segment_index"] for r in found.collect()) == sorted(i for x in kept.values() for i, _ in x)
    assert found.columns == df.columns and "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()

    asked = [(i, i % 2, rng.choice([0, 5, None]), rng.choice([rng.choice(rows)[3], "nothing known", ""])) for i in range(60)]
    expected = {}
    for i, session, speaker, text in asked:
        own = [r for r in rows if r[0] == session]
        score, _, r = max((len(set(text.split()) & set(r[3].split())) + 2 * (speaker is not None and r[2] == speaker), -r[1], r) for r in own)
        expected[i] = (r[4], r[5]) if score else (own[0][4], own[-1][5])
    aligned = transcripts.align_statements(spark.createDataFrame(asked, "statement_id int, session_id long, speaker int, text string"), df)
    assert {r["statement_id"]: (r["start_s"], r["end_s"]) for r in aligned.collect()} == expected
    assert "array_intersect" not in aligned._jdf.queryExecution().toString()


def test_ingest_fails_whole_documents(spark):
    """A chunk that can't be embedded takes its document's other chunks along; deleted documents are passed over."""
    from docspark.operators import ingest as I

    def embedder(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no vector")
        return I.hashed_embedder(texts)

    long = "\n\n".join(f"part {i} " + "word " * 400 for i in range(4))
    docs = [(1, 1, "invoice_7.txt", long, "pending"), (2, 1, "b.txt", long + "\n\nbad", "pending"), (3, 2, "c.txt", " \n\t", "pending"), (4, 2, "d.txt", "text", "deleted"), (5, 2, "e.txt", None, "pending")]
    done = I.ingest(spark.createDataFrame(docs, "doc_id long, vault_id long, original_filename string, text string, status string"), embedder, model=lambda name, text: {"summary": F.lit("short")})
    got = {r.doc_id: (r.status, r.error_message, r.n_chunks) for r in done.documents.collect()}
    parts = I.split_text(long)
    assert got == {1: ("active", None, len(parts) + 1), 2: ("failed", "Embedding failed: no vector", 0), 3: ("failed", "No text content could be extracted", 0), 5: ("failed", "No text content could be extracted", 0)}
    chunks = done.chunks.orderBy("chunk_index").collect()
    assert [r.content for r in chunks[:-1]] == parts and [r.chunk_type for r in chunks] == ["child"] * len(parts) + ["metadata"]
    assert chunks[-1].content == "Structured Metadata:\n- Document Type: invoice\n- Entity ID: 7\nSummary: short" and all(len(r.embedding) == 64 for r in chunks)
    assert done.audit.count() == 4 and done.dead_letters.count() == 3


def test_retries_wait_longer_each_time():
    from docspark.operators import ingest as I

    waits, tries = [], []

    def flaky(texts):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return [np.zeros(2)]

    assert len(I.retrying(flaky, 4, 0.5, waits.append)(["x"])) == 1 and waits == [0.5, 1.0]
    with pytest.raises(OSError):
        tries.clear()
        I.retrying(flaky, 2, 0.5, waits.append)(["x"])


def test_corrective_searches_again_for_what_found_nothing(spark):
    from docspark.operators import verify as V

    chunks = spark.createDataFrame([(1, 1, 1, 0, "invoice 12345 total $900", False, "active"), (2, 2, 1, 0, "order 67890 was shipped", False, "active")], "chunk_id long, doc_id long, vault_id long, chunk_index int, content_with_header string, is_deleted boolean, status string")
    queries = spark.createDataFrame([(1, 1, "invoice 12345 is $900"), (2, 1, "44444 or order 67890"), (3, 1, "nothing 99999 and 88888")], "query_id long, vault_id long, query_text string")
    got = {r.query_id: (r.attempts, r.relevant, r.context and r.context.split("\n")[1]) for r in V.corrective(queries, chunks, 2, 5, V.next_id, V.by_first_id).collect()}
    assert got == {1: (1, True, "invoice 12345 total $900"), 2: (2, True, "order 67890 was shipped"), 3: (2, False, None)}


def test_near_duplicate_pairs_of_literal_boost_marks(spark):
    """Words that look like boosted copies neither lose nor add a pair."""
    texts = ["alpha alpha__1 alpha__2 beta", "alpha beta", "alpha__1 alpha__2 ab", "alpha__1 alpha__2", "ab alpha__1 alpha__2 alpha"]
    df = spark.createDataFrame(list(enumerate(texts)), "statement_id long, text string")
    bags = {r.statement_id: set(r.b) for r in df.select("statement_id", T.boosted_bag(F.col("text")).alias("b")).collect()}
    want = {(a, b) for a in bags for b in bags if a < b and bags[a] != bags[b] and len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b])}
    got = {(r.a, r.b) for r in claims.near_duplicate_pairs(df).collect()}
    first = {b: min(i for i in bags if bags[i] == bags[b]) for b in bags}
    assert got == {(first[a], first[b]) for a, b in want if first[a] != first[b]}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from docspark.sources import shared

    session = lambda master, conf: SimpleNamespace(conf=SimpleNamespace(get=conf.get), sparkContext=SimpleNamespace(master=master, applicationId="app-1"))
    assert shared.folder(session("spark://host:7077", {"spark.checkpoint.dir": "hdfs:///shared/"})) == "hdfs:///shared/docspark-app-1"
    with pytest.raises(ValueError):
        shared.folder(session("spark://host:7077", {"spark.checkpoint.dir": None}))


def test_near_duplicate_pairs_of_a_hot_word(spark, monkeypatch):
    """A word in every prefix, and bags of all sizes, with few bags to a task: the pairs are those of all bags."""
    monkeypatch.setattr(claims, "TOGETHER", 7)
    rng = random.Random(4)
    texts = [" ".join(["rarestword", *rng.sample([f"w{chr(97 + j)}{chr(97 + j)}{chr(97 + j)}" for j in range(9)], rng.randint(1, 9)), *[str(100 + rng.randrange(6)) for _ in range(rng.randrange(3))]]) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "statement_id long, text string")
    bags = {}
    for r in sorted(rows.select("statement_id", T.boosted_bag(F.col("text")).alias("bag")).collect()):
        bags.setdefault(frozenset(r.bag), r.statement_id)
    items = sorted((i, b) for b, i in bags.items())
    want = {(i, j) for i, x in items for j, y in items if i < j and len(x & y) / len(x | y) >= 0.8}
    assert {(r.a, r.b) for r in claims.near_duplicate_pairs(rows).collect()} == want and len(want) > 20


def test_needles_are_looked_up_by_their_rarest_run(spark):
    """Names that all begin alike, short needles, none at all; each needle's key is in few names."""
    from docspark.operators.retrieval import containing

    names = spark.createDataFrame([(i, f"purchase_orders_{10000 + i}.pdf") for i in range(400)] + [(900, "É straße.txt"), (901, None)], "doc_id long, name string")
    wanted = spark.createDataFrame([(f"Purchase_Orders_{10000 + i}",) for i in range(0, 400, 7)] + [("",), (None,), ("é",), ("STRASSE",), ("0.pdf",), ("orders_99",)], "title string")
    got = sorted((r.doc_id, r._needle) for r in containing(names, "name", wanted, "title", []).collect())
    want = sorted((n.doc_id, w.title) for n in names.collect() for w in wanted.collect() if n.name and w.title and w.title.lower() in n.name.lower())
    assert got == want and len(want) > 90


def test_alignment_skips_what_everyone_says(spark):
    """A session where each segment says "the": rows as by all pairs, met by few of them."""
    rng = random.Random(8)
    words = [f"word{i}" for i in range(60)]
    segs = [(1, i, float(i), i + 0.5, rng.choice([0, 1, None]), "the " + " ".join(rng.sample(words, 5))) for i in range(120)]
    asks = [(i, 1, rng.choice([0, 1, 2, None]), rng.choice(["the", "The the", "", "nothing said", "the " + " ".join(rng.sample(words, 4)), segs[rng.randrange(120)][5]])) for i in range(80)]
    segments = spark.createDataFrame(segs, "session_id long, segment_index int, start_s double, end_s double, speaker int, text string")
    statements = spark.createDataFrame(asks, "statement_id long, session_id long, speaker int, text string")
    want = set()
    for i, _, speaker, text in asks:
        scores = [(len(set(text.lower().split()) & set(s[5].split())) + (2 if speaker is not None and s[4] == speaker else 0), -s[1]) for s in segs]
        score, at = max(scores)
        want.add((i, segs[-at][2], segs[-at][3]) if score > 0 else (i, segs[0][2], segs[-1][3]))
    assert {tuple(r) for r in transcripts.align_statements(statements, segments).collect()} == want
    split = lambda c: F.array_sort(F.array_distinct(F.split(c, " ")))
    asked = statements.join(segments.select("text").distinct(), "text", "left_semi").select(F.col("statement_id").alias("_a"), "session_id", F.col("speaker").alias("_speaker"), split("text").alias("_words"))
    heard = segments.select(F.col("segment_index").alias("_h"), "session_id", "speaker", split("text").alias("words"), "segment_index", F.struct("start_s", "end_s").alias("times"))
    assert transcripts.alignment_candidates(asked, heard).count() < asked.count() * heard.count() / 3


def test_dense_blocks_equal_the_scan(spark, monkeypatch):
    """Many small blocks, ties, copies, zero vectors, a vault with nearly all chunks; far clusters are skipped."""
    from docspark.operators import dense_index

    monkeypatch.setattr(dense_index, "BLOCK", 40)
    monkeypatch.setattr(dense_index, "TOGETHER", 16)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 8)) * 4
    vectors = [(centers[i % 12] + rng.normal(size=8) * 0.1).astype(np.float32) for i in range(900)]
    rows = [(i, 1 if i % 10 else i % 3, [float(x) for x in vectors[i if i % 50 else 0]] if i % 97 else [0.0] * 8, i % 41 == 0, "active") for i in range(900)] + [(2000, 1, None, False, "active")]
    chunks = spark.createDataFrame(rows, "chunk_id long, vault_id long, embedding array<float>, is_deleted boolean, status string")
    asks = [(i, v, [float(x) for x in vectors[i]]) for i in range(0, 900, 23) for v in (0, 1)]
    asks = [(2 * k, v, q) for k, (_, v, q) in enumerate(asks)] + [(1001, 1, [0.0] * 8), (1003, 1, None), (1005, 77, [1.0] * 8)]
    queries = spark.createDataFrame(asks, "query_id long, vault_id long, query_vec array<float>")
    plain = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 7)) for r in df.collect())
    want = plain(retrieval.dense(queries, chunks, 15))
    assert plain(retrieval.dense(queries, chunks, 15, dense_index.build(chunks))) == want
    monkeypatch.setattr(retrieval, "SENT", 0)
    assert plain(retrieval.dense(queries, chunks, 15)) == want
    read = {r.query_id: (r.chunks, r.compared) for r in dense_index.reads(queries, dense_index.build(chunks), 15).collect()}
    assert sum(c for _, c in read.values()) < 0.5 * sum(n for n, _ in read.values())
    assert plain(retrieval.dense(queries, chunks.limit(0), 15, dense_index.build(chunks.limit(0)))) == []


def test_keyword_index_equals_the_formula(spark, monkeypatch):
    """Scores by the formula over all chunks, in small segments; after updates too; few postings are read."""
    from collections import Counter

    from docspark.operators import keyword_index

    monkeypatch.setattr(keyword_index, "SEGMENT", 20)
    rng = random.Random(6)
    common, rare = [f"c{i}" for i in range(8)], [f"r{i}" for i in range(60)]
    text = lambda: " ".join(rng.choices(common, k=rng.randint(1, 30)) + rng.sample(rare, rng.randint(0, 4)))
    rows = [(i, i % 2, i % 13 == 0, "failed" if i % 17 == 0 else "active", text() if i % 19 else None) for i in range(400)]
    later = [(i, v, d, s, text() if i % 5 == 0 else t) for i, v, d, s, t in rows if i % 7] + [(500 + i, 1, False, "active", text()) for i in range(9)]
    schema = "chunk_id long, vault_id long, is_deleted boolean, status string, content_with_header string"
    asks = [(q, q % 2, " ".join(rng.sample(rare, 3) + rng.sample(common, 4))) for q in range(30)] + [(90, 0, ""), (91, 1, "nowhere"), (92, 7, "c1")]
    queries = spark.createDataFrame(asks, "query_id long, vault_id long, query_text string")

    def formula(rows):
        words = {r[0]: re.split(r"[^\w]+", r[4]) if r[4] is not None else None for r in rows}
        words = {i: None if w is None else [x for x in w if x] for i, w in words.items()}
        mean, df = sum(len(w) for w in words.values() if w is not None) / sum(w is not None for w in words.values()), Counter(x for w in words.values() for x in set(w or ()))
        out = []
        for q, v, said in asks:
            found = []
            for i, vault, deleted, status, _ in rows:
                tf = Counter(words[i] or ())
                s = sum(math.log1p((len(rows) - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * sum(tf.values()) / mean)) for x in set(said.split()) if tf[x])
                if s and vault == v and not deleted and status == "active":
                    found.append((-round(s, 9), i))
            out += [(q, k, i, round(-s, 6)) for k, (s, i) in enumerate(sorted(found)[:7])]
        return sorted(out)

    def same(df, want):
        got = sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
        return [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-5 for g, w in zip(got, want))

    index = keyword_index.build(spark.createDataFrame(rows, schema))
    assert same(keyword_index.search(queries, index, 7), formula(rows))
    read = keyword_index.reads(queries, index, 3).agg(F.sum("postings"), F.sum("postings_read")).first()
    assert read[1] < 0.8 * read[0]
    gone = [(r[0],) for r in rows if r[0] % 7 == 0] + [(r[0],) for r in later if r[0] % 5 == 0 or r[0] >= 500]
    after = keyword_index.update(index, spark.createDataFrame(gone, "chunk_id long"), spark.createDataFrame(later, schema))
    assert same(keyword_index.search(queries, after, 7), formula(later))
    assert keyword_index.build(spark.createDataFrame([], schema)).n == 0


def test_tries_pause_longer_up_to_a_limit():
    from docspark.operators.models import tries

    slept, calls = [], []

    def call(prompt):
        calls.append(prompt)
        if len(calls) < 6:
            raise OSError("down")
        return "up"

    assert tries(call, attempts=7, sleep=slept.append)("p") == ("up", None, 6) and slept == [1.0, 2.0, 4.0, 8.0, 8.0]
    slept.clear(), calls.clear()
    assert tries(call, sleep=slept.append)("p") == (None, "down", 4) and slept == [1.0, 2.0, 4.0]


def test_pieces_of_a_generator_that_breaks_off(spark):
    from docspark.operators.models import ask, pieces

    def generate(prompt):
        for i in range(int(prompt)):
            if i == 2500:
                raise ValueError("cut")
            yield f"t{i}"

    rows = spark.createDataFrame([(1, "3"), (2, "0"), (3, None), (4, "9999")], "id long, prompt string")
    got = sorted(tuple(r) for r in pieces(rows, generate).where("id < 4 or position > 2498").collect())
    assert got == [(1, 0, "t0", None), (1, 1, "t1", None), (1, 2, "t2", None), (4, 2499, "t2499", None), (4, 2500, None, "cut")]
    asked = {r.id: (r.answer, r.error, r.attempts) for r in ask(rows, lambda p: p * 2, delay=0.0).collect()}
    assert asked == {1: ("33", None, 1), 2: ("00", None, 1), 3: (None, None, 0), 4: ("99999999", None, 1)}


def test_documents_are_stored_whole_or_not_at_all(spark, tmp_path):
    docs = spark.createDataFrame([(1, "active", None), (2, "pending_delete", None), (3, "ingesting", None), (4, "active", None), (6, "active", "2024-01-01")], "doc_id long, status string, deleted_at string")
    chunks = spark.createDataFrame([(1, 7, 0, "a"), (1, 7, 1, "b"), (2, 7, 0, "c"), (3, 8, 0, "d"), (3, 8, 0, "e"), (4, 8, 0, "f"), (4, None, 1, "g"), (5, 8, 0, "h"), (6, 8, 0, "i")], "doc_id long, vault_id long, chunk_index int, content string")
    failed = ingest.write_chunks(chunks, str(tmp_path / "batch"), docs)
    assert sorted(r.content for r in spark.read.parquet(str(tmp_path / "batch")).collect()) == ["a", "b"]
    assert {r.doc_id: r.error_message.split()[0] for r in failed.collect()} == {2: "Deleted", 3: "Two", 4: "A", 5: "No", 6: "Deleted"}
    # The same batch again replaces itself.
    ingest.write_chunks(chunks.where("doc_id = 1 and chunk_index = 0"), str(tmp_path / "batch"), docs)
    assert [r.content for r in spark.read.parquet(str(tmp_path / "batch")).collect()] == ["a"]


def test_grades_by_words_and_ids(spark):
    """Half of a query's words or one of its ids in what was found; nothing found is nothing relevant."""
    from docspark.operators import verify

    queries = spark.createDataFrame([(1, "red green blue white"), (2, "red green blue black"), (3, "see invoice 12345"), (4, "red"), (5, "")], "query_id long, query_text string")
    chunks = spark.createDataFrame([(10, "red and green"), (11, "only red"), (12, "number 12345")], "chunk_id long, content_with_header string")
    results = spark.createDataFrame([(1, 10, 1.0, 0), (2, 11, 1.0, 0), (3, 12, 1.0, 0), (5, 11, 1.0, 0)], "query_id long, chunk_id long, score double, rank int")
    assert {r.query_id: r.relevant for r in verify.grade(results, queries, chunks).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_embedded_chunks_have_their_texts_vectors(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for embed in (ingest.embed, ingest.embed_distinct):
        got = {r.doc_id: r.embedding for r in embed(docs, "text").collect()}
        assert got.keys() == texts.keys()
        assert all(np.allclose(got[i], ingest.hashed_vector(t), atol=1e-6) for i, t in texts.items())


def test_a_mixed_table_is_answered_as_each_route_answers(spark):
    """Statements of every class at once: aggregates by metadata as alone, the others by search, and a line for each."""
    from docspark.plans.ingest import answer_aggregates, answer_mixed

    d = "/root/testdata/sf0.001"
    mixed = {r.query_id: (r.query_class, r.route, r.answer, r.confidence) for r in answer_mixed(spark, d).collect()}
    alone = {r.query_id: (r.query_class, r.route, r.answer, r.confidence) for r in answer_aggregates(spark, d).collect()}
    assert len(mixed) == spark.read.parquet(f"{d}/orders.parquet").count() and alone.items() <= mixed.items()
    rest = [v for i, v in mixed.items() if i not in alone]
    assert rest and {v[1] for v in rest} == {"search"} and {v[0] for v in rest} == {"point"}
