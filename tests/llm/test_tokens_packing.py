from __future__ import annotations

import binascii
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tests.llm.odd import documents, empty, rows
from tokenizers import Tokenizer

from docspark.llm import packing, tokens
from docspark.llm.common import table

WORD_JSON, BYTE_JSON = (open(public_tokenizers.path(n), encoding="utf-8").read() for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_str(WORD_JSON)
    got = sorted(map(tuple, tokens.count_tokens(documents(spark), WORD_JSON, ["doc_id", "text"]).collect()), key=str)
    want = sorted(((r[0], r[1], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows()), key=str)
    assert got == want
    assert tokens.count_tokens(empty(spark), WORD_JSON, ["doc_id"]).count() == 0


def test_whole_tokens_are_single_tokens():
    library = Tokenizer.from_str(WORD_JSON)
    whole = tokens.whole_tokens(WORD_JSON)
    assert len(whole) > 30_000
    some = random.Random(3).sample(sorted(whole), 3000)
    assert all(len(library.encode(p, add_special_tokens=False).ids) == 1 for p in some)


@pytest.mark.parametrize("text", ["it's  a   test\n\n x", " lead", "a'llb 're", "12 345½", "tab\there \x0b\x0c", "ÀÉÎÕÜ straße ǅ", "“–” €5", "…!!! ###  \n \n", "'' 's''ve", "日本 abc"])
def test_ids_equal_the_library(text):
    library = Tokenizer.from_str(BYTE_JSON)
    assert np.frombuffer(tokens.token_ids(BYTE_JSON)(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_random_texts_equal_the_library():
    rng, library, encode, words = random.Random(5), Tokenizer.from_str(BYTE_JSON), tokens.token_ids(BYTE_JSON), Tokenizer.from_str(WORD_JSON)
    count = tokens.token_counter(WORD_JSON, tokens.whole_tokens(WORD_JSON))
    sets = ["abcDEF éÉßñ ' 's\n\t 12.,!?-–’\x0b¼ªº×÷ĳŉſƀǅ­", "ab  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u200b\u3000'", "яЖΣσς日本語कि\u0301é \nа́👍🏽 .", "ab <|endoftext|>\n <|startoftext|> '"]
    for n in range(2000):
        letters = sets[n % 4]
        parts = ["<|endoftext|>", "<|startoftext|>", " ", "  ", "\n", "a", "'s", "<|"] if n % 4 == 3 else letters
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        assert np.frombuffer(encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert count(t) == len(words.encode(t, add_special_tokens=False).ids), repr(t)


def test_whole_tables_equal_the_library(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    words, library = Tokenizer.from_str(WORD_JSON), Tokenizer.from_str(BYTE_JSON)
    got = tokens.op2_token_counts(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {i: (len(t.encode()), n, n > 2048) for i, t in texts.items() for n in [len(words.encode(t, add_special_tokens=False).ids)]}
    pieces = packing.op6_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(ids.keys())
    assert all(r.ids_crc32 == binascii.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in pieces)
    assert sum(r.length for r in pieces) == sum(map(len, ids.values()))
    places = defaultdict(list)
    for r in pieces:
        places[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(p)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:])) and sum(n for _, n in p) <= 2048 for p in places.values())
    assert len(places) == best_fit([r.length for r in pieces], 2048)


def best_fit(lengths: list[int], size: int) -> int:
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = 64
    lengths = [rng.choice([rng.randint(1, 64), rng.randint(1, 9), 21]) for _ in range(rng.randrange(1, 400))]
    slots = packing.plan(Counter(lengths), size)
    used = defaultdict(list)
    ranks = defaultdict(set)
    for n, a, b, s, at in slots:
        for r in range(a, b):
            used[s + r - a].append((at, n))
            ranks[n].add(r)
    assert {n: len(r) for n, r in ranks.items()} == Counter(lengths) and all(r == set(range(len(r))) for r in ranks.values())
    for parts in used.values():
        at = 0
        for begin, n in sorted(parts):
            assert begin == at
            at += n
        assert at <= size
    assert len(used) == best_fit(lengths, size)


def test_cut():
    assert packing.cut(10, 4) == [(0, 2), (2, 4), (6, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


def test_packing_odd_documents(spark):
    library = Tokenizer.from_str(BYTE_JSON)
    got = packing.packed_digests(documents(spark), BYTE_JSON).collect()
    want = Counter()
    for r in rows():
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((r[0], k, s, n, binascii.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids))))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        assert sorted(parts)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
        assert sum(n for _, n in parts) <= 2048
    assert packing.packed_digests(empty(spark), BYTE_JSON).count() == 0
