from __future__ import annotations

import random
import re

import numpy as np
import pytest
from tests.llm.odd import documents, empty, rows

from docspark.llm import jaccard_join
from docspark.llm.components import components


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(docs, size, percent):
    sets = [shingles(t, size) for _, t in docs]
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def run(spark, docs, size, percent):
    df = spark.createDataFrame(docs, "doc_id long, text string") if isinstance(docs, list) else docs
    return sorted(map(tuple, jaccard_join.near_duplicates(df, size, percent).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def corpus(rng, n=120):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35 or not out:
            w = [word() for _ in range(rng.choice([1, 3, 4, 5, 20, 60, 150]))]
        elif kind < 0.85:
            w = rng.choice(out).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 2)] = [word()][: rng.randint(0, 1)]
            w = w or ["x"]
        else:
            w = passage[: rng.randint(30, 40)] + [word() for _ in range(rng.choice([0, 1, 3]))]
        out.append(" ".join(x.upper() if rng.random() < 0.02 else x for x in w))
    return list(enumerate(out))


@pytest.mark.parametrize("seed", range(3))
def test_random_corpus(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", [1_000_000, 200, 1000][seed])
    docs = corpus(random.Random(seed))
    size, percent = [(4, 85), (5, 80), (4, 85)][seed]
    assert run(spark, docs, size, percent) == brute(docs, size, percent)


def test_odd_documents(spark):
    docs = [(r[0], r[1]) for r in rows()]
    assert run(spark, documents(spark), 4, 85) == brute(docs, 4, 85)
    assert run(spark, empty(spark), 4, 85) == []


def test_equal_sets_in_another_order(spark):
    """Partitions that hold the same sets in another order don't mix up their documents."""
    rng = random.Random(9)
    text = lambda: [f"w{rng.randrange(10_000)}" for _ in range(120)]
    for _ in range(3):
        a, b = text(), text()
        parts = [[a, b], [b, a], [["x", *a[1:]], ["y", *b[1:]]]]
        docs = [(10 * i + j, " ".join(t)) for i, part in enumerate(parts) for j, t in enumerate(part)]
        df = spark.createDataFrame(spark.sparkContext.parallelize(docs, 3), "doc_id long, text string")
        assert run(spark, df, 4, 85) == brute(docs, 4, 85)


def test_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert run(spark, df, 4, 85) == brute([tuple(r) for r in df.collect()], 4, 85)


def test_keep_one(spark):
    docs = documents(spark)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    sets = [frozenset(shingles(r["text"], 5)) for r in kept.collect()]
    filled = [s for s in sets if s]
    assert len(filled) == len(set(filled)) and len(sets) - len(filled) == sum(not shingles(r[1], 5) for r in rows())
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(filled) for b in filled[:i])
    assert jaccard_join.keep_one(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_linked_equals_pairs(seed):
    rng = random.Random(seed)
    base = [rng.sample(range(400), rng.randint(1, 60)) for _ in range(4)]
    sets = []
    for _ in range(rng.randint(1, 60)):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            s ^= {rng.randrange(400)}
        sets.append(np.array(sorted(s) or [1], np.uint64))
    sizes = np.array([len(s) + rng.choice([0, 0, 1]) for s in sets])
    percent = rng.choice([80, 85, 50])
    label = jaccard_join.linked(sets, sizes, percent)
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both) and up[i] != up[j]:
                a, b = up[i], up[j]
                up = [b if x == a else x for x in up]
    same = lambda x: [[a == b for b in x] for a in x]
    assert same(list(label)) == same(up)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(30)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    alone = {x for x in up if all(x not in e or e[0] == e[1] for e in edges)}
    assert got == {k: v for k, v in up.items() if k not in alone}


def test_texts_repeated_in_shuffled_order(spark):
    """200 texts and near copies, again and again in another order over eight partitions, against all pairs."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(60)) for _ in range(rng.choice([3, 30, 60]))) for _ in range(100)]
    texts += [t + " tail" for t in texts]
    docs = []
    for part in range(8):
        docs += [(len(docs) + k, t) for k, t in enumerate(rng.sample(texts, 60))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(8, "doc_id")
    want = brute(docs, 5, 80)
    assert run(spark, df, 5, 80) == want
    kept = sorted(r.doc_id for r in jaccard_join.keep_one(df, 5, 80).collect())
    assert kept == sorted({c for _, n, c in want if n})


def test_ranges_grow_with_the_data(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "RANGE", 20)
    docs = corpus(random.Random(8))
    assert run(spark, docs, 4, 85) == brute(docs, 4, 85)


def test_planted_near_copies_are_found_and_others_left_alone(spark):
    """Copies with words changed, dropped and added in place, as far as the likeness of 0.8 allows: nine of ten are found; clean texts stay."""
    import random

    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(3000)]
    base = [rng.choices(vocabulary, k=rng.randint(60, 400)) for _ in range(120)]
    rows, planted = [(i, " ".join(t)) for i, t in enumerate(base)], {}
    for i, words in enumerate(base[:60]):
        for c in range(rng.randint(1, 4)):
            copy = list(words)
            for _ in range(max(1, len(words) // 70)):  # each edit changes five shingles at most
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([["changed"], [], [copy[at], "added"]])
            planted[1000 * (i + 1) + c] = i
            rows.append((1000 * (i + 1) + c, " ".join(copy)))
    kept = {r.doc_id for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(120)) <= kept
    assert sum(i not in kept for i in planted) >= 0.9 * len(planted)
