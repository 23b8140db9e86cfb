from __future__ import annotations

import hashlib
import re

from tests.llm.odd import documents, empty, rows

from docspark.llm import sketch
from pyspark.sql import functions as F


def brute(text):
    words = [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return sorted({sum(f * h for f, h in zip(sketch.FACTORS, words[i : i + 5])) % sketch.PRIME for i in range(max(1, len(words) - 4))}) if words else []


def printed(text):
    hashes = brute(text)
    kept = [s for s in hashes if s < sketch.PRIME // sketch.KEEP]
    digits = lambda x: "".join(f"{s:08x}" for s in x)
    return "" if not hashes else "=" + digits(hashes) if len(hashes) < sketch.WHOLE or not kept else digits(kept)


def from_prints(x, y):
    """Likeness and containment from two fingerprints and nothing else."""
    hashes = [{int(p.lstrip("=")[i : i + 8], 16) for i in range(0, len(p.lstrip("=")), 8)} for p in (x, y)]
    a, b = hashes
    if not all(p == "" or p[0] == "=" for p in (x, y)):
        a, b = ({s for s in h if s < sketch.PRIME // sketch.KEEP} for h in hashes)
    return (len(a & b) / len(a | b) if a | b else 1.0, 1.0 if not hashes[0] else len(a & b) / len(a) if a else 0.0)


def compared(a, b):
    return from_prints(printed(a), printed(b))


def test_measures_follow_from_the_fingerprints(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    rows = {r.doc_id: r for r in sketch.op3_document_sketch(spark, "/root/testdata/sf0.01").collect()}
    for d, after in zip(docs, docs[1:] + docs[:1]):
        r, following = rows[d.doc_id], rows[after.doc_id]
        assert r.fingerprint == printed(d.text or "")
        assert (r.near_edited, r.kept_in_edited) == from_prints(r.fingerprint, r.edited_fingerprint)
        assert (r.near_next, r.kept_in_next) == from_prints(r.fingerprint, following.fingerprint)
    # Estimates are near the truth: half of each text is kept.
    true = lambda a, b: len(set(brute(a)) & set(brute(b))) / len(set(brute(a)) | set(brute(b)) or {0})
    off = [abs(rows[d.doc_id].near_next - true(d.text or "", n.text or "")) for d, n in zip(docs, docs[1:]) if (d.text or n.text)]
    assert sum(off) / len(off) < 0.02


def test_odd_documents(spark):
    docs = documents(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = sketch.with_shingles(sketch.with_shingles(sketch.with_next(docs), "text", "a"), "next_text", "b")
    got = sketch.with_likeness(got, "a", "b", "near", "inside").collect()
    assert len(got) == len(rows())
    assert all(r.a == brute(r.text) and r.b == brute(r.next_text) and (r.near, r.inside) == compared(r.text, r.next_text) for r in got)
    low = lambda x: (x is not None, x)
    order = sorted({r.doc_id for r in got}, key=low)
    # Every row leads to a row of its own or the following id, and as many of each text as there are.
    assert sorted(r.text for r in got) == sorted(r.next_text for r in got)
    after = dict(zip(order, order[1:] + order[:1]))
    texts = {i: {r[1] or "" for r in rows() if r[0] == i} for i in order}
    assert all(r.next_text in texts[r.doc_id] | texts[after[r.doc_id]] for r in got)
    assert sketch.with_next(empty(spark).select("doc_id", "text")).count() == 0


def test_one_row_follows_itself(spark):
    docs = spark.createDataFrame([(7, "x y")], "doc_id long, text string")
    assert sketch.with_next(docs).first().next_text == "x y"


def test_uneven_ids(spark):
    ids = [*range(50), 10**15, 10**15 + 1, *range(-(10**12), -(10**12) + 300), 2**62]
    docs = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    order = sorted(ids)
    after = dict(zip(order, order[1:] + order[:1]))
    assert all(int(r.next_text) == after[r.doc_id] for r in sketch.with_next(docs).collect())


def test_many_null_ids_are_ranged(spark):
    docs = spark.createDataFrame([(None, str(i)) for i in range(300)] + [(5, "x")], "doc_id long, text string")
    got = {r.text: r.next_text for r in sketch.with_next(docs).collect()}
    ring, at = [], "x"
    for _ in got:
        ring.append(at)
        at = got[at]
    assert at == "x" and len(set(ring)) == 301
    assert sketch.with_next(docs).select(sketch._range(docs, 256)).distinct().count() > 4


def test_short_texts_are_compared_whole(spark):
    """Two texts of few shingles are compared by all of them; with a longer one, by those below the fraction."""
    long = [" ".join(f"w{i * k}" for i in range(200)) for k in range(1, 40)]
    short = [" ".join(t.split()[7:30]) for t in long]
    df = spark.createDataFrame([(" ".join(s.split()[3:]), s, t) for s, t in zip(short, long)], "r string, s string, t string")
    for c in "rst":
        df = sketch.with_shingles(df, c, f"h{c}")
    df = sketch.with_likeness(sketch.with_likeness(df, "hr", "hs", "near", "within"), "hr", "ht", "far", "share")
    got = df.select("*", sketch.fingerprint(F.col("hr"), sketch.sketch(F.col("hr"))).alias("f")).collect()
    assert {r.within for r in got} == {1.0} and {round(r.near, 6) for r in got} == {round(16 / 19, 6)}
    assert all(r.share == 1.0 for r in got if r.share) and sum(r.share > 0 for r in got) > 30 and all(r.f[0] == "=" and len(r.f) == 1 + 8 * 16 for r in got)


def test_unions_merge(spark):
    a, b = "one two three four five six seven eight " * 3, "red green blue black white pink grey " * 4
    df = spark.createDataFrame([(a, b, a + "\n" + b)], "a string, b string, c string")
    for c in "abc":
        df = sketch.with_shingles(df, c, f"s{c}").withColumn(f"k{c}", sketch.sketch(F.col(f"s{c}")))
    r = df.first()
    assert set(r.kc) >= set(r.ka) | set(r.kb) and set(r.kc) - set(r.ka) - set(r.kb) <= set(r.sc) - set(r.sa) - set(r.sb)
