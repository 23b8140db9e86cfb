from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tests.llm.odd import documents, empty

from docspark.llm import mixing
from docspark.llm.common import materialize


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 200.0, "b": 250 / 3, "c": 500 / 3}
    got = mixing.targets({"b": 10, None: 0, "a": 1000})
    assert list(got) == ["a", "b", None] and got[None] == 0 and got["b"] == 20 and abs(sum(got.values()) - 1515) < 1e-9


def test_fit_is_as_near_as_any_choice():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 30), 5))
        counts = [rng.randint(1, 3) for _ in lengths]
        words = sum(a * b for a, b in zip(lengths, counts))
        budget = rng.randint(0, words)
        took = mixing.fit(np.array(lengths), np.array(counts), budget)
        assert all(0 <= t <= c for t, c in zip(took, counts))
        best = max(s for pick in itertools.product(*[range(c + 1) for c in counts]) if (s := sum(a * b for a, b in zip(lengths, pick))) <= budget)
        assert int((took * lengths).sum()) == best


def reachable(lengths, counts, budget):
    """The largest sum of at most `budget` words, with a bit for each sum that can be had."""
    bits, all_below = 1, (1 << budget + 1) - 1
    for n, c in zip(lengths, counts):
        k = 1
        while c:
            k = min(k, c)
            bits |= bits << n * k & all_below
            c, k = c - k, 2 * k
    return bits.bit_length() - 1


def test_fit_beyond_the_reserve(monkeypatch):
    """The shares come first, then the program; both together are as near as any choice."""
    rng = random.Random(4)
    for reserve in (0, 50, 300):
        monkeypatch.setattr(mixing, "RESERVE", reserve)
        for _ in range(60):
            lengths = sorted(rng.sample(range(1, 60), 12))
            counts = [rng.randint(1, 200) for _ in lengths]
            budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)))
            took = mixing.fit(np.array(lengths), np.array(counts), budget)
            assert all(0 <= t <= c for t, c in zip(took, counts))
            got, best = int((took * lengths).sum()), reachable(lengths, counts, budget)
            assert got <= best and (got == best if reserve == 300 else best - got < max(lengths))
    monkeypatch.undo()
    lengths, counts = np.array([7, 14, 700, 70_000, 7_000_000]), np.array([10**9, 10, 10**8, 10**4, 3])
    took = mixing.fit(lengths, counts, 60_000_000_003)
    assert int((took * lengths).sum()) == 60_000_000_003 // 7 * 7 and 0.5 < took[0] / counts[0] * (counts * lengths).sum() / 6e10 < 2


def sized_of(docs):
    return materialize(docs.select("doc_id", "source", mixing.words_in(F.col("text")).alias("size")), "t")


def test_mix_odd_documents(spark):
    sized = sized_of(documents(spark))
    one, two = (sorted(map(tuple, mixing.mix(sized).select("doc_id", "source", "size", "target", "copies").collect()), key=str) for _ in range(2))
    assert one == two and len(one) == sized.count()
    assert all(0 <= r[4] <= 2 for r in one) and all(r[4] == 0 for r in one if r[2] == 0)
    assert mixing.mix(sized_of(empty(spark))).count() == 0


def test_columns_of_any_name_pass_through(spark):
    docs = documents(spark)
    for c in ("row", "copies", "again", "target", "extra", "n", "_bucket", "_row", "SOURCE_SIZE"):
        docs = docs.withColumn(c, F.lit("mine"))
    docs = materialize(docs, "t")
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and {r["copies"] for r in got.collect()} == {"mine"}
    times = Counter(got.select("doc_id", "source", "text").collect())
    want = Counter()
    for r in mixing.mix(sized_of(docs)).collect():
        want[r.doc_id, r.source] += r.copies
    assert +Counter({k: v for k, v in want.items()}) == Counter(k[:2] for k in times.elements()) and max(times.values()) <= 2 * max(Counter(docs.select("doc_id", "source", "text").collect()).values())
    assert mixing.mixed(empty(spark)).count() == 0


def test_hits_targets(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "w " * rng.randint(1, 60), f"s{min(i % 9, 4)}") for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix(sized_of(docs)).collect()
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 1
