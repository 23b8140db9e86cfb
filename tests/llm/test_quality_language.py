from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.odd import documents, empty, rows

from docspark.llm import language_id, quality
from docspark.llm.common import table
from docspark.llm.textbytes import buffers


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té|#", max_size=60), max_size=5))
def test_statistics(texts):
    got = quality.statistics(*buffers(pa.array(texts, pa.string())))
    assert [tuple(int(got[s][i]) for s in quality.STATS) for i in range(len(texts))] == [brute(t) for t in texts]


def is_reference(text):
    n, _, symbols, _, repeated = brute(text)
    return n >= 20 and 100 * repeated <= 30 * n and 100 * symbols <= n and 100 * repeated <= 5 * n


def kneser_ney(texts):
    """log p of a code point after a context, by the published recursion, from count dictionaries."""
    levels = {5: Counter(p[i : i + 5] for t in texts for p in ["    " + t] for i in range(len(p) - 4))}
    for n in (4, 3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    d, whole, taken = {}, Counter(), Counter()
    for n, level in levels.items():
        n1, n2, n3, n4 = (sum(v == k for v in level.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        d[n] = [min(max(a, 0.05 * k), k) for k, a in zip((1, 2, 3), (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))] if n1 and n2 and n3 else [0.5, 1.0, 1.5]
        for g, v in level.items():
            whole[g[:-1]] += v
            taken[g[:-1]] += min(d[n][min(v, 3) - 1], v)

    @functools.cache
    def p(g):
        if not g:
            return 1 / (len(levels[1]) + 1)
        if g[:-1] not in whole:
            return p(g[1:])
        v = levels[len(g)][g]
        return ((v - min(d[len(g)][min(v, 3) - 1], v) if v else 0) + taken[g[:-1]] * p(g[1:])) / whole[g[:-1]]

    return p


def log_perplexity(p, text):
    padded = "    " + text
    return -sum(math.log(p(padded[i : i + 5])) for i in range(len(text))) / len(text)


def brute_kept(docs):
    """(doc_id, kept, log perplexity) of (doc_id, text, lang)."""
    out, by_lang = [], defaultdict(list)
    for _, t, lang in docs:
        if is_reference(t or ""):
            by_lang[lang].append(t)
    for lang in {d[2] for d in docs}:
        p = kneser_ney(by_lang[lang]) if by_lang[lang] else None
        mine = [(i, t or "", log_perplexity(p, t) if p and t else None) for i, t, own in docs if own == lang]
        seen = sorted(z for _, t, z in mine if is_reference(t))
        q = [seen[max(0, math.ceil(len(seen) * k) - 1)] for k in (0.25, 0.75)] if seen else None
        for i, t, z in mine:
            n, _, _, _, repeated = brute(t)
            wide = max(q[1] - q[0], quality.LEAST_SPREAD) if q else 0
            inside = z is None or not q or q[0] - quality.BELOW * wide <= z <= q[1] + quality.ABOVE * wide
            out.append((i, n >= 20 and 100 * repeated <= 30 * n and inside, z))
    return out


def test_equals_the_recursion(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.lang) for r in table(spark, d, "documents").collect()]
    want = {i: (k, z) for i, k, z in brute_kept(docs)}
    got = quality.op1_quality_rules(spark, d).collect()
    assert {r.doc_id: r.kept for r in got} == {i: k for i, (k, _) in want.items()}
    assert 0 < sum(k for k, _ in want.values()) < sum(not r.base_failed for r in got)
    for r in got:
        z = want[r.doc_id][1]
        assert (r.perplexity is None) == (z is None) and (z is None or abs(math.log(r.perplexity) - z) < 1e-4)


def model_of(spark, texts):
    filler = " one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    texts = [t + filler for t in texts]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    return texts, {(k, n): quality.HashArray(a, b) for k, n, a, b in quality._sent(quality.fit(docs), 0, quality.PARTS)["en"]}


def test_probabilities_add_up(spark):
    texts, model = model_of(spark, ["the cat sat on the mat. THE DOG, 12 été", "日本語 and Ωμέγα, \U0001f600!"])
    letters = sorted({c for t in texts for c in t})
    p = kneser_ney(texts)
    for context in ("    ", "the ", "zzzz", "日本語 ", "été ", "xthe"):
        grams = np.array([[ord(c) for c in context + x] for x in [*letters, "\u4e00"]], np.uint32)
        got = np.exp(quality.log_probability(model, grams))
        assert abs(got.sum() - 1) < 1e-4 and (got > 0).all()
        assert np.allclose(got, [p(context + x) for x in [*letters, "\u4e00"]], rtol=1e-4)


def test_odd_documents(spark):
    docs = documents(spark)
    for name in ("_measured", "_kept", "_band", "_limits", "n_words", "kept", "perplexity", "lower", "k1", "l", "m", "_K1"):
        docs = docs.withColumn(name, F.lit("mine"))
    scored = quality.score(docs, quality.fit(docs), "_measured_")
    got = Counter((r.doc_id, r.text, *(r["_measured_"][s] for s in quality.STATS)) for r in scored.collect())
    assert got == Counter((r[0], r[1], *brute(r[1] or "")) for r in rows())
    out, _, kept = quality.judged(docs)
    assert out.count() == len(rows())
    want = Counter((i, k) for i, k, _ in brute_kept([(r[0], r[1], r[2]) for r in rows()]))
    assert Counter((r.doc_id, r[kept]) for r in out.collect()) == want
    left = quality.filter_documents(docs)
    assert left.columns == docs.columns and {r.n_words for r in left.collect()} == {"mine"}
    assert quality.filter_documents(empty(spark)).count() == 0


def test_passes_give_the_same(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents").withColumn("_k1", F.lit(1))
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("lang", F.lit("new")))
    model = quality.fit(table(spark, "/root/testdata/sf0.001", "documents"))
    one = quality.score(docs, model, "m").collect()
    monkeypatch.setattr(quality, "BROADCAST_BYTES", 100_000)
    assert len(quality._passes(model)) > 2
    two = quality.score(docs, model, "m").collect()
    near = lambda rows: sorted((r.doc_id, r.lang, *r.m[:-1], r.m.log_perplexity and round(r.m.log_perplexity, 6)) for r in rows)
    assert near(one) == near(two)


def test_clean_stay_and_junk_goes(spark):
    d = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, d, "labels").collect()}
    got = [r for r in quality.op1_quality_rules(spark, d).where("not base_failed").collect() if r.doc_id in labels]
    good, bad = ([r.kept for r in got if labels[r.doc_id] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_gram_vectors_by_hand():
    pack = lambda s: ord(s[0]) << 42 | ord(s[1]) << 21 | ord(s[2])
    vectors = dict(zip("aé日", language_id.letter_vectors(np.array([ord(c) for c in "aé日"])), strict=True))
    assert {*vectors["a"].tolist()} == {1, -1} and abs(int(vectors["é"].astype(int) @ vectors["日"].astype(int))) < 200
    want = np.roll(vectors["a"], 2) * np.roll(vectors["é"], 1) * vectors["日"]
    assert (language_id.gram_vectors(np.array([pack("aé日")]))[0] == want).all()
    codes, owner, letter = language_id.grams(*buffers(pa.array(["Ab", "", "É!", None, "12"])))
    assert codes.tolist() == [pack(" ab"), pack("ab "), pack(" é "), pack("é  ")]
    assert owner.tolist() == [0, 0, 2, 2] and letter.tolist() == [True, False, True, False, False]


def brute_languages(learn, ask):
    """Predictions by summing a vector for each n-gram of each text in turn."""
    def profile(text):
        letters = [c.lower()[0] if unicodedata.category(c)[0] in "LM" else " " for c in text or ""]
        s, out = "".join([" ", *letters, " "]), np.zeros(language_id.DIM)
        for i in range(len(s) - 2):
            if s[i : i + 3] != "   ":
                a, b, c = (language_id.letter_vectors(np.array([ord(x)]))[0].astype(int) for x in s[i : i + 3])
                out += np.roll(a, 2) * np.roll(b, 1) * c
        return out

    proto = defaultdict(lambda: np.zeros(language_id.DIM))
    for text, lang in learn:
        proto[lang] += profile(text)
    for text in ask:
        v = profile(text)
        cosine = {k: float(v @ p / max(np.linalg.norm(v) * np.linalg.norm(p), 1e-9)) for k, p in proto.items()}
        best = min(cosine, key=lambda k: (-cosine[k], k)) if any(map(str.isalpha, text or "")) else "und"
        yield best, max(0.0, cosine[best]) if best != "und" else 0.0


def test_predictions_equal_a_plain_version(spark):
    few = [r for r in table(spark, "/root/testdata/sf0.001", "documents").collect() if r.text][:60]
    learn = [(r.text[:300], r.lang) for r in few] + [("что это за язык такой", "ru"), ("これは日本語の文章です", "ja"), ("यह हिन्दी है", "hi"), (None, "en")]
    ask = [r.text[:200] for r in few[:20]] + ["какой язык", "日本語の本", "हिन्दी में", None, "12 34", "", "ÉTÉ ô"]
    model = language_id.prototypes(spark.createDataFrame(learn, "text string, lang string").repartition(3))
    got = language_id.predict(spark.createDataFrame(list(enumerate(ask)), "i int, text string"), model, ["i"]).orderBy("i").collect()
    want = list(brute_languages([x for x in learn if x[0]], ask))
    assert [r.lang_pred for r in got] == [w[0] for w in want] and [r.lang_pred for r in got[20:23]] == ["ru", "ja", "hi"]
    assert np.allclose([r.score for r in got], [w[1] for w in want])


def test_languages(spark):
    out = language_id.op5_language_id(spark, "/root/testdata/sf0.01")
    lang = {r["doc_id"]: r["lang"] for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = out.collect()
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert len(got) == 1000 and len(held) > 150 and sum(held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_documents(spark):
    docs = documents(spark)
    out = language_id.predict(docs, language_id.prototypes(docs), ["doc_id", "text"]).collect()
    assert len(out) == len(rows())
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) for r in out)
    none = language_id.predict(docs, language_id.prototypes(empty(spark)), ["doc_id"]).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert language_id.predict(empty(spark), language_id.prototypes(docs), ["doc_id"]).count() == 0
