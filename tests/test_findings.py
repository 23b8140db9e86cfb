"""What reviews found, each as a small case."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import ingest, retrieval


def _cancelling() -> str:
    """Two words whose hashes name one place with opposite signs."""
    seen = {}
    for i in range(10_000):
        h = int.from_bytes(hashlib.blake2b(f"w{i}".encode(), digest_size=8).digest(), "little")
        if (h % 64, 1 - (h >> 63)) in seen:
            return f"{seen[h % 64, 1 - (h >> 63)]} w{i}"
        seen[h % 64, h >> 63] = f"w{i}"
    raise AssertionError


def test_only_blank_texts_have_no_direction(spark):
    texts = [_cancelling(), "\x0b", "\u00a0", " \t\n\f\r", "", None, "one two"]
    want = [1, 1, 1, 0, 0, 0, 1]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for found in (ingest.embed(rows, "text"), ingest.embed_distinct(rows, "text")):
        got = {r["doc_id"]: np.linalg.norm(r["embedding"]) for r in found.collect()}
        assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-6)


def test_quotes_keep_their_ones(spark):
    """A quote on the first line after its source's ends with 1; spaces of any kind around it go."""
    text = "--- Document Chunk 1 (relevance: 1.000) ---\n[Source: a 10001]\n address 19.37.233.111 \n" + "--- Document Chunk 2 (relevance: 1.000) ---\n[Source: b]\n\u00a0\n\u00a0 22 of 2\u3000\n"
    rows = spark.createDataFrame([(1, "search_documents", text)], "output_id long, tool string, text string")
    got = {r["title"]: r["quote"] for r in retrieval.citations(rows).collect()}
    assert got == {"a 10001": "address 19.37.233.111", "b": "22 of 2"}


def test_answers_stay_one_of_each_question_until_the_end(spark, monkeypatch):
    """Questions that say the same are searched, told and quoted once; each still has its row."""
    from docspark.operators import verify

    chunks = spark.createDataFrame([(i, i, 0, 0, f"[Source: s {i}]\nthe total of invoice {i}", False, "active", None) for i in range(12)], "chunk_id long, doc_id long, vault_id long, chunk_index int, content_with_header string, is_deleted boolean, status string, embedding array<float>")
    docs = spark.createDataFrame([(1, 0, "invoice_1.pdf", "invoice", "1", None, "ACME", 5.0, "active", None)], "doc_id long, vault_id long, original_filename string, document_type string, entity_id string, order_date date, customer_id string, total_price double, status string, deleted_at timestamp")
    texts = ["How many invoices do we have", "The total of invoice 3 is $77", "The total of invoice 3 is $88", "The total of invoice 4 is $99"]
    rows = [(i, i // 4 % 2 or None if i == 39 else 0, texts[i % 4], None) for i in range(40)]
    seen = {}
    hybrid, told = retrieval.hybrid, verify.A.verify
    monkeypatch.setattr(retrieval, "hybrid", lambda q, *a: seen.update(searched=q.count()) or hybrid(q, *a))
    monkeypatch.setattr(verify.A, "verify", lambda s, d: seen.update(asked=s.count()) or told(s, d))
    got = verify.answer(spark.createDataFrame(rows, "query_id long, vault_id long, query_text string, query_vec array<float>"), chunks, docs).collect()
    assert sorted(r["query_id"] for r in got) == list(range(40)) and seen == {"searched": 3, "asked": 1}
    by = {r["query_id"]: r for r in got}
    assert by[1]["answer"] == by[2]["answer"] != by[3]["answer"] and by[1]["n_citations"] == 5
    assert by[0]["route"] == "metadata" and by[0]["answer"] == by[4]["answer"] and by[0]["n_citations"] == 1
    assert by[39]["answer"] == "I couldn't find relevant information in the vault." and by[39]["confidence"] == 0


def test_an_id_that_all_hold_moves_no_texts(spark):
    """The first chunks of an id that every number holds, without the texts in an exchange; a query has no more rows than k."""
    text = "x" * 50
    chunks = spark.createDataFrame([(i, 0, i % 3, f"{text} {100 + i} {i}1", False, "active") for i in range(60)], "chunk_id long, vault_id long, chunk_index int, content_with_header string, is_deleted boolean, status string")
    asked = spark.createDataFrame([(q, 0, ids) for q, ids in enumerate([["1"], ["1", "59"], ["159"], ["7", "nothing"][:1], []])], "query_id long, vault_id long, entity_ids array<string>")
    for mode in ("contains", "token"):
        want = {}
        for q, ids in enumerate([["1"], ["1", "59"], ["159"], ["7"], []]):
            holds = lambda i: any(x in f"{100 + i} {i}1" if mode == "contains" else x in (str(100 + i), f"{i}1") for x in ids)  # noqa: B023, E731
            want[q] = [(i, n) for n, (_, i) in enumerate(sorted((i % 3, i) for i in range(60) if holds(i))[:5])]
        found = retrieval.entity_search(asked, chunks, 5, mode=mode)
        got = {q: [] for q in want}
        for r in found.collect():
            got[r["query_id"]].append((r["chunk_id"], r["rank"]))
        assert {q: sorted(x, key=lambda y: y[1]) for q, x in got.items()} == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "content_with_header" not in plan.split("Join")[1] or mode == "token"


def test_index_blocks_come_of_arrays(spark):
    """Odd chunks: null texts, vaults and ids, equal rows, chunks out of use; the blocks' counts are plain ones, and no aggregate collects postings."""
    from collections import Counter, defaultdict

    from docspark.operators import keyword_index

    words = ["ape", "Bee", "cat", "dög", "1"]
    rows = [(i, i % 3, i % 7 == 0, "active" if i % 5 else "failed", " ".join(words[(i * j) % 5] for j in range(i % 6)) if i % 11 else None) for i in range(300)]
    rows += [(5, None, False, "active", "ape ape"), (7, 1, None, "active", "bee"), rows[31], rows[32]]
    chunks = spark.createDataFrame(rows, "chunk_id long, vault_id long, is_deleted boolean, status string, content_with_header string")
    made = keyword_index._blocks(chunks, 7, 3)
    assert "ObjectHashAggregate" not in made._jdf.queryExecution().toString()
    want = defaultdict(list)
    merged = Counter()
    for c, v, deleted, status, text in rows:
        own = None if text is None else text.lower().split()
        for w in [*(own or []), ""]:
            merged[c, v, deleted is False and status == "active", None if own is None else len(own), w] += 1
    for (c, v, used, length, w), tf in merged.items():
        want[w, v].append((c, used, length, tf))
    got = defaultdict(lambda: [0, 0, []])
    for r in made.collect():
        assert r["folder"] == r["segment"] % 3 and [p["chunk_id"] for p in r["postings"]] == sorted(p["chunk_id"] for p in r["postings"])
        x = got[r["term"], r["vault_id"]]
        x[0] += r["df"]
        x[1] += r["total"]
        x[2] += [(p["chunk_id"], p["length"], p["tf"]) for p in r["postings"]]
        assert r["max_tf"] == max((p["tf"] for p in r["postings"]), default=None) and r["min_length"] == min((p["length"] for p in r["postings"] if p["length"] is not None), default=None)
    assert {k: (n, t, sorted(p, key=str)) for k, (n, t, p) in got.items()} == {k: (len(x), sum(y[3] for y in x), sorted(((c, n, tf) for c, used, n, tf in x if used), key=str)) for k, x in want.items()}


def test_keyword_index_for_queries_has_their_terms_alone(spark):
    """F12 to F26: such an index finds what the full one does, holds no other terms, and refuses queries that say others."""
    from docspark.operators import keyword_index

    schema = "chunk_id long, vault_id long, is_deleted boolean, status string, content_with_header string"
    rows = [(i, i % 2, i % 7 == 0, "active", f"w{i % 5} w{i % 3} rare{i} {'w1 ' * (i % 4)}") for i in range(300)]
    chunks = spark.createDataFrame([*rows, rows[3], (900, 0, False, "active", None)], schema)
    queries = spark.createDataFrame([(1, 0, "w1 w4 rare8"), (2, 1, "W2, w0 nowhere"), (3, None, "w1")], "query_id long, vault_id long, query_text string")
    every, own = keyword_index.build(chunks), keyword_index.build(chunks, queries=queries)
    assert (own.n, own.mean_length) == (every.n, every.mean_length)
    assert {r.term for r in own.blocks.select("term").distinct().collect()} == {"w0", "w1", "w2", "w4", "rare8"}
    found = lambda index: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in keyword_index.search(queries, index, 5).collect())
    assert found(own) == found(every) and len(found(own)) == 10
    with pytest.raises(ValueError, match="other queries"):
        keyword_index.search(queries.withColumn("query_text", F.lit("rare9")), own)


def test_claim_pieces_have_no_frame_each(spark, monkeypatch):
    """pieces follow each other within a task; the batches are those of the live rule, session by session, a null session too."""
    import random

    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    from docspark.streaming.sessions import Buffer, claim_batches

    monkeypatch.delattr(PandasGroupedOpsMixin, "applyInPandas")
    rng, rows, want = random.Random(4), [], []
    for session in [*range(6), None]:
        at, buffer = 0.0, Buffer()
        for i in range(80):
            at += rng.choice([0.5, 1.0, 3.0, 30.0])
            text = "x" * rng.randint(0, 30)
            rows.append((session, i, at, text))
            want += [(session, *r) for r in buffer.add(i, at, len(text))]
        want += [(session, *r) for r in buffer.tick_to(math.inf)]
    found = claim_batches(spark.createDataFrame(rows, "session_id long, segment_index int, end_s double, text string")).collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str) and len(want) > 200


def test_near_duplicates_rank_words_once_and_move_strings(spark):
    """what is left of the plan ranks no words again, and bags go to their pairs as strings."""
    from docspark.operators import claims

    rows = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f g"), (4, "12345 x__1 y"), (5, "12345 x__1 y z"), (6, ""), (7, None)], "statement_id long, text string")
    pairs = claims.near_duplicate_pairs(rows)
    plan = pairs._jdf.queryExecution().analyzed().toString()
    assert "Window" not in plan and "sum(weight" not in plan
    assert {(r.a, r.b, round(r.similarity, 6)) for r in pairs.collect()} == {(1, 3, round(6 / 7, 6)), (4, 5, round(5 / 6, 6))}
    assert sorted(map(tuple, claims.near_duplicate_members(rows).collect())) == [(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 4, 1), (5, 5, 1), (6, 6, 0), (7, 7, 0)]


def test_spelled_out_classes_cut_as_the_patterns_do():
    """op6: texts of sure characters are cut by the standard library, and the pieces are those of the pattern."""
    import random
    import re

    import regex

    from docspark.llm import tokens

    sure = re.findall(f"[{tokens.SURE}]", "".join(map(chr, range(0x3000))))
    for pattern in (tokens.BYTE_PATTERN, tokens.WORD_PATTERN):
        old, new, rng = regex.compile(pattern), re.compile(tokens.sure_pattern(pattern)), random.Random(5)
        assert "\\p" not in new.pattern
        for k in range(20_000):
            text = "".join(rng.choices(sure if k % 2 else " \n\t'st1a.\xc9\xb2", k=rng.randint(0, 30)))
            assert old.findall(text) == new.findall(text)
        assert old.findall("".join(sure)) == new.findall("".join(sure))


def test_needles_of_one_run_are_dealt(spark, monkeypatch):
    """full_document: 60 titles whose only run all of 300 names hold meet over many tasks, with the rows of one."""
    names = spark.createDataFrame([(i, f"abcde{i:03d}.pdf") for i in range(300)], "doc_id long, name string")
    wanted = spark.createDataFrame([(f"BCDE{i}",) for i in range(10)] + [("abcde",), ("9.pdf",), ("nowhere",), ("",), (None,)], "title string").repartition(1)
    rows = lambda: retrieval.containing(names, "name", wanted, "title", [])
    want = sorted((f"abcde{i:03d}.pdf", t) for i in range(300) for t in [*(f"BCDE{k}" for k in range(10)), "abcde", "9.pdf"] if t.lower() in f"abcde{i:03d}.pdf")
    assert sorted((r["name"], r["_needle"]) for r in rows().collect()) == want
    monkeypatch.setattr(retrieval, "PAIRS", 50)
    got = rows()
    assert got.columns == ["doc_id", "name", "_needle"] and sorted((r["name"], r["_needle"]) for r in got.collect()) == want
    one = spark.createDataFrame([(f"bcde{a}{b}",) for a in "012" for b in "0123456789"] + [("abcde",)], "title string")
    abcde = retrieval.containing(names, "name", one.where("title = 'abcde'").union(spark.createDataFrame([("ABCDE",), ("aBcDe",), ("AbCdE",), ("abCDE",)], "title string")), "title", [])
    tasks = [r["count"] for r in abcde.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 5 * 300 and len(tasks) > 1


def test_vectors_travel_by_shelf(spark, monkeypatch):
    """dense_by_blocks: a query's vector meets shelves of clusters, once each, and has its k best of a shelf sent on; the rows are those of all pairs."""
    from docspark.operators import dense_index

    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(500, 8)), 2)
    x[:60], x[60] = x[0], 0
    chunks = spark.createDataFrame([(i, i % 2, x[i].tolist(), False, "active") for i in range(500)], "chunk_id long, vault_id long, embedding array<double>, is_deleted boolean, status string")
    queries = chunks.select(F.col("chunk_id").alias("query_id"), "vault_id", F.col("embedding").alias("query_vec"))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    near = np.round(unit @ unit.T, 9)
    want = {(q, int(c), r) for q in range(500) for r, c in enumerate(sorted(range(q % 2, 500, 2), key=lambda c: (-near[q, c], c))[:7])}
    for shelf, most in ((8192, 1), (100, 4)):
        monkeypatch.setattr(dense_index, "SHELF", shelf)
        monkeypatch.setattr(dense_index, "TOGETHER", shelf)
        index = dense_index.build(chunks)
        assert {(r.query_id, r.chunk_id, r.rank) for r in dense_index.search(queries, index, 7).collect()} == want
        shelves = max(r["count"] for r in index.shelves.groupBy("vault_id").count().collect())
        assert 1 <= shelves <= most
        blocks, pairs, _ = dense_index._plan(queries, index, 7)
        every = dense_index._scores(blocks, pairs.withColumn("least", F.lit(float("-inf"))), index, 7)
        assert max(r["count"] for r in every.groupBy("query_id").count().collect()) <= 7 * shelves


def test_whole_numbers_are_found_without_cutting_texts(spark):
    """verify_claims: the numbers that stand alone are those among the words, texts aren't cut into words, and keys are computed once."""
    import random
    import re

    from docspark.operators import verify

    rng = random.Random(3)
    texts = ["".join(rng.choices(["12", "345", "6", "a", "Z", "-", " ", ".", "_", "\n", "é", "٣"], k=rng.randint(0, 12))) for _ in range(3000)] + ["12", "-12", "12-", "", None, "12 12 345"]
    chunks = spark.createDataFrame([(i, i, 0, 0, t, False, "active") for i, t in enumerate(texts)], "chunk_id long, doc_id long, vault_id long, chunk_index int, content_with_header string, is_deleted boolean, status string")
    asked = spark.createDataFrame([(1, 0, ["12"]), (2, 0, ["345", "6"]), (3, 0, ["126", "00"])], "query_id long, vault_id long, entity_ids array<string>")
    found = retrieval.entity_search(asked, chunks, k=5000, mode="token")
    have = lambda t: {w for w in re.split(r"[^A-Za-z0-9-]+", t or "") if re.fullmatch("[0-9]+", w)}
    want = {(q, i) for q, ids in ((1, {"12"}), (2, {"345", "6"}), (3, {"126", "00"})) for i, t in enumerate(texts) if have(t) & ids}
    assert {(r.query_id, r.chunk_id) for r in found.collect()} == want
    assert "split(" not in found._jdf.queryExecution().analyzed().toString()

    documents = spark.createDataFrame([(0, 0, "a.pdf", "invoice", "1", None, "x", 1.0, "active", None)], "doc_id long, vault_id long, original_filename string, document_type string, entity_id string, order_date date, customer_id string, total_price double, status string, deleted_at timestamp")
    told = verify.verify_claims(spark.createDataFrame([(1, 0, "The total of invoice 10001 is $1,100"), (2, 0, "How many invoices")], "statement_id long, vault_id long, text string"), documents, chunks)
    assert "sha2(" not in told._jdf.queryExecution().analyzed().toString() and {r.statement_id for r in told.collect()} == {1, 2}


def test_near_duplicates_move_numbers_and_packed_bags(spark):
    """words aren't shuffled as strings, bags go once to a group of pairs; copies and words that look like copies of others are counted as the boosted bags have them."""
    import random
    import re

    from docspark.operators import claims

    rng = random.Random(9)
    words = ["abcd", "abcd__1", "abcd__2", "efgh__1", "efgh", "march", "x", "x__1", "y__2", "ab", "123", "123__1", "q1", "the", "é", "ööòó", "z_z", "q1__3"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 14))) for _ in range(250)] + ["", None, "abcd", "abcd abcd__2", "abcd__1 abcd__2"]
    rows = spark.createDataFrame(list(enumerate(texts)), "statement_id long, text string").repartition(5)
    bags = {r.statement_id: frozenset(r.bag or []) for r in rows.select("statement_id", T.boosted_bag(F.col("text")).alias("bag")).collect()}
    once = {b: min(i for i, x in bags.items() if x == b) for b in set(bags.values()) if b}
    want = {(i, j): round(len(x & y) / len(x | y), 9) for x, i in once.items() for y, j in once.items() if i < j and 5 * len(x & y) >= 4 * len(x | y)}
    pairs = claims.near_duplicate_pairs(rows)
    assert {(r.a, r.b): round(r.similarity, 9) for r in pairs.collect()} == want and len(want) > 20
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect" not in plan and not re.search(r"hashpartitioning\((word|bag)#", plan) and "FlatMapCoGroupsInArrow" in plan
    links = {i: sum(i in p for p in want) for i in once.values()}
    members = {r.statement_id: (r.class_id, r.n_links) for r in claims.near_duplicate_members(rows).collect()}
    assert members == {i: (once.get(b, i), links.get(once.get(b), 0)) for i, b in bags.items()}


def test_common_words_are_searched_for_once(spark, monkeypatch):
    """queries that share a vault's common words read their postings once for all, and the rows are those of a scan, ties included."""
    import random

    from docspark.operators import keyword_index as I

    rng = random.Random(7)
    texts = {i: " ".join([*rng.choices(["the", "of", "total", "is", "of of"], k=rng.randint(0, 6)), *rng.choices([f"n{j}" for j in range(80)], k=rng.randint(0, 3))]) for i in range(300)}
    chunks = spark.createDataFrame([(i, i % 2, i % 17 == 3, "active" if i % 13 else "failed", t) for i, t in texts.items()], "chunk_id long, vault_id long, is_deleted boolean, status string, content_with_header string")
    asked = {q: (q % 3, f"the total of n{q % 90} is" + (" n5 n6" if q % 4 == 0 else "")) for q in range(200)} | {900: (0, "n7"), 901: (1, "the"), 902: (0, "unknown"), 903: (1, "")}
    queries = spark.createDataFrame([(q, *x) for q, x in asked.items()], "query_id long, vault_id long, query_text string")
    words = {i: t.split() for i, t in texts.items()}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = {w: sum(w in x for x in words.values()) for w in {w for x in words.values() for w in x}}
    want = set()
    for q, (vault, text) in asked.items():
        score = {}
        for i, own in words.items():
            if i % 2 == vault and i % 17 != 3 and i % 13:
                for w in set(text.split()) & set(own):
                    tf = own.count(w)
                    score[i] = score.get(i, 0) + math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean))
        want |= {(q, i, r) for r, i in enumerate(sorted(score, key=lambda i: (-round(score[i], 9), i))[:7])}
    seen, candidates = [], I._candidates
    monkeypatch.setattr(I, "_candidates", lambda asked, *a: seen.append(asked.select("query_id").distinct().count()) or candidates(asked, *a))
    index = I.build(chunks, queries=queries)
    rows = lambda: {(r.query_id, r.chunk_id, r["rank"]) for r in I.search(queries, index, 7).collect()}
    assert rows() == want and seen[-1] > 100
    monkeypatch.setattr(I, "SHORT", 20)
    assert rows() == want and seen[-1] < 10


def test_answers_meet_their_queries_last(spark):
    """no join stands above the one that brings the texts of answers."""
    import re

    from docspark.plans.ingest import answer_mixed

    lines = answer_mixed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    union = next(i for i, x in enumerate(lines) if "Union" in x)
    branches = [i for i in range(union + 1, len(lines)) if depth[i] == depth[union] + 3]
    assert len(branches) == 2
    for begin, end in zip(branches, [*branches[1:], len(lines)], strict=True):
        join = next(i for i in range(begin, end) if " Join " in f" {lines[i].lstrip(' :+-')} ")
        left, right = (i for i in range(join + 1, end) if depth[i] == depth[join] + 3)
        brings = [any(re.search(r"\b(context|_text)#", x) for x in lines[i:j]) for i, j in ((left, right), (right, end))]
        assert brings == [False, True]


def test_needles_of_one_place_meet_texts_on_equal_keys(spark, monkeypatch):
    """a text gives one row for all needles that have one run at one place, whichever run that is, and no text is compared with needles one by one."""
    import random

    rng = random.Random(11)
    word = lambda n: "".join(rng.choices("aB1", k=rng.randint(0, n)))
    names = [(i, i % 2, word(16)) for i in range(150)] + [(200, 0, None), (201, 0, ""), (202, 1, "aB1aB1aB1aB1"), (202, 1, "aB1aB1aB1aB1"), (203, 0, "İstanbul 11aa")]
    digits = [(i, i % 2, "".join(rng.choices(["1", "2", "12", "x", " "], k=rng.randint(0, 9)))) for i in range(150)]
    asked = [(i % 2, word(9)) for i in range(120)] + [(0, "aB1aB1"), (1, "AB1ab1"), (1, "aB1aB1aB1aB1"), (0, None), (1, "nowhere")]
    numbers = [(i % 2, "".join(rng.choices("12", k=rng.randint(1, 8)))) for i in range(60)]
    for texts, needles in ((names, asked), (digits, numbers)):
        df = spark.createDataFrame(texts, "id long, v long, name string").repartition(3)
        wanted = spark.createDataFrame(needles, "v long, title string")
        lower = {r.title: r.low for r in wanted.unionByName(df.select("v", F.col("name").alias("title"))).select("title", F.lower("title").alias("low")).collect()}
        want = sorted((i, n, t) for i, v, n in texts for w, t in {x for x in needles if x[1]} if v == w and n and lower[t] in lower[n])
        for shared, most in ((0, 500_000), (2, 500_000), (10**9, 500_000), (1, 20)):
            monkeypatch.setattr(retrieval, "SHARED", shared, raising=False)
            monkeypatch.setattr(retrieval, "PAIRS", most)
            found = retrieval.containing(df, "name", wanted, "title", ["v"])
            assert found.columns == ["id", "v", "name", "_needle"] and "contains(" not in found._jdf.queryExecution().analyzed().toString().lower()
            assert sorted((r.id, r.name, r["_needle"]) for r in found.collect()) == want and len(want) > 100
