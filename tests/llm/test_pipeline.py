"""The pipeline against plain versions of its stages, each on what the stage before it kept."""

from __future__ import annotations

import importlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tests.llm import test_jaccard_join, test_line_dedup_chat, test_quality_language
from tests.llm.odd import TAKEN, clashing, documents

from docspark.llm.common import materialize, table

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_stages(spark, pipeline):
    docs = table(spark, D, "documents")
    steps = [docs.collect()]
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, D), "t")
        steps.append(docs.collect())
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == pipeline.COLUMNS
    raw, good, lines, single, mixed, packed = steps
    ids = {r.doc_id for r in good}
    for r in raw:
        n_words, _, _, _, repeated = test_quality_language.brute(r.text or "")
        assert r.doc_id not in ids or not (n_words < 20 or 100 * repeated > 30 * n_words)
    passing = [r for r in raw if (b := test_quality_language.brute(r.text or ""))[0] >= 20 and 100 * b[4] <= 30 * b[0]]
    assert len(good) > 0.9 * len(passing)
    want = test_line_dedup_chat.brute([(r.doc_id, r.text) for r in good])
    import hashlib

    assert sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in lines) == sorted((w[0], w[3]) for w in want)
    assert all(r.n_chars == len(r.text) for r in lines if r.text != next(g.text for g in good if g.doc_id == r.doc_id))
    groups = test_jaccard_join.brute([(r.doc_id, r.text) for r in lines], 5, 80)
    assert sorted(r.doc_id for r in single) == sorted({c for _, n, c in groups if n} | {d for d, n, _ in groups if not n})
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in single}
    times = Counter(r.doc_id for r in mixed)
    assert set(times) <= set(size) and max(times.values()) <= 2
    total, by_source = sum(size.values()), defaultdict(int)
    for r in single:
        by_source[r.source] += size[r.doc_id] * times[r.doc_id]
    # A source has about ten documents here, and sums stay below their targets.
    assert 0.99 * 1.5 * total <= sum(by_source.values()) <= 1.5 * total
    assert Counter(r.doc_id for r in packed if r.piece == 0) == times
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 2048 and sorted(p)[0][0] == 0 for p in places.values())


def test_odd_documents(spark, pipeline):
    docs = documents(spark)
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, D), "t")
        docs.count()


def test_each_stage_on_odd_and_empty(spark, pipeline):
    for name, stage in pipeline.STAGES:
        assert stage(spark, documents(spark), D).count() >= 0
        assert stage(spark, documents(spark).where(F.lit(False)), D).count() == 0


def test_stages_with_clashing_columns(spark, pipeline, tmp_path):
    """Columns of any name change no stage's rows."""
    for name, df in (("plain", documents(spark)), ("clashing", clashing(spark))):
        df.write.parquet(f"{tmp_path}/{name}")
    plain, more = spark.read.parquet(f"{tmp_path}/plain"), spark.read.parquet(f"{tmp_path}/clashing")
    for name, stage in pipeline.STAGES[:-1]:
        want, got = (sorted(map(str, stage(spark, d, D).collect())) for d in (plain, more))
        assert got == want, name
    assert pipeline.STAGES[-1][1](spark, more, D).count() == pipeline.STAGES[-1][1](spark, plain, D).count()


def test_operators_pass_clashing_columns(spark, tmp_path):
    import public_tokenizers

    from docspark.llm import jaccard_join, language_id, packing, tokens

    docs = clashing(spark)
    docs.write.parquet(f"{tmp_path}/d")
    docs, word, byte = spark.read.parquet(f"{tmp_path}/d"), *(open(public_tokenizers.path(f), encoding="utf-8").read() for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and all(r[c] == c for r in kept.collect() for c in TAKEN)
    made = [(tokens.count_tokens(docs, word, docs.columns), ["n_tokens_"]), (packing.token_pieces(docs, byte, docs.columns), ["piece_", "start_", "length_", "ids_"]), (language_id.predict(docs, language_id.prototypes(docs), docs.columns), ["lang_pred_", "score_"])]
    for out, names in made:
        assert out.columns == [*docs.columns, *names]
        assert all(r[c] == c for r in out.collect() for c in TAKEN)


def test_query(spark, pipeline):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"](spark, D).count() > 100
