from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from tests.llm.odd import documents, empty, rows

from docspark.llm import suffix_dedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(df, length=200):
    return sorted(map(tuple, suffix_dedup.removal_digests(df, length).collect()), key=str)


def test_odd_documents(spark):
    want = sorted(((r[0], *b) for r, b in zip(rows(), brute([r[1] for r in rows()], 200))), key=str)
    assert run(documents(spark)) == want
    assert run(empty(spark)) == []


def cases(rng):
    word = lambda: "".join(rng.choice("abcdeé\0\n") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.choice([35, 38, 40, 42, 60, 120])) for _ in range(6)]
    out = []
    for _ in range(70):
        parts = [text(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(shared)
            if rng.random() < 0.5:
                a = rng.randrange(len(s))
                s = s[a : a + rng.randint(150, 420)]
            parts += [s, text(rng.choice([0, 0, 1, 30]))]
        out.append("".join(parts))
    out += [rng.choice(out) for _ in range(5)] + ["ab" * 150, "ab" * 101, "a" * 199, "a" * 200, "a" * 1000, "x" + "\0" * 260, "\0" * 230, text(4000) + shared[0]]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(spark, seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", [40_000, 1, 50, 7][seed])
    texts = cases(random.Random(seed))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert run(df) == sorted(((i, *b) for i, b in enumerate(brute(texts, 200))), key=str)


def test_whole_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = df.collect()
    assert run(df) == sorted(((r.doc_id, *b) for r, b in zip(docs, brute([r.text for r in docs], 200))), key=str)


@pytest.mark.parametrize("large", [0, 3, 20])
def test_large_entries_have_no_group(spark, large, monkeypatch):
    """Footers after texts that all differ: no entry brings more rows than LARGE to one task, with the same removals."""
    monkeypatch.setattr(suffix_dedup, "LARGE", large, raising=False)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    footer = " ".join(word() for _ in range(90))
    texts = cases(rng) + [" ".join(word() for _ in range(60)) + footer for _ in range(40)] + [footer[:-1] + word() + footer for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = suffix_dedup.text_key(df).select("key", "text")
    held = keyed.dropDuplicates(["key"]).join(suffix_dedup.repeated_places(keyed), "key")
    sizes = suffix_dedup.contexts(held).where("begin IS NULL").groupBy("entry").count().agg({"count": "max"}).first()[0]
    assert (sizes or 0) <= large
    assert run(df) == sorted(((i, *b) for i, b in enumerate(brute(texts, 200))), key=str)
