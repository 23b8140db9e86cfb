"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1 that follows from its code point and a seed, so every script has vectors of
its own and none is stored. A letter n-gram binds its letters' vectors, permuted by place: the first rotated twice, the
second once, multiplied. A text bundles (adds) its n-gram vectors; a language's prototype bundles its training texts. A
text's language is the prototype with the largest cosine. Letters are folded to lower case one by one, marks count as
letters, and any other character as a space.

Tasks bundle by n-gram counts, so what they send is one vector for each language, summed by Spark. Bundles are whole
numbers, so neither the order of sums nor how texts are sliced changes them.
Null text, or one without a letter, is `und` with score 0; so is all text if nothing was learned. Ties go to the
smaller language name. Rows are independent otherwise; an empty table gives an empty one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import free
from docspark.llm.textbytes import buffers, code_points, mix, slices

DIM = 1024
#: Languages whose counts a task holds at once, and distinct n-grams before it bundles them; beyond either it sends what it has.
HELD, HELD_GRAMS = 32, 1_000_000
#: N-grams that are bound at once.
BOUND = 4096
SPACE = ord(" ")
_UNKNOWN, _OTHER, _MARK, _LETTER = range(4)
_kind = np.zeros(0x110000, np.int8)
_folded = np.zeros(0x110000, np.uint32)


def folded(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code point's letter (a space if it is none), and whether it is a letter rather than a mark or something else."""
    for c in np.unique(points[_kind[points] == _UNKNOWN]).tolist():
        category = unicodedata.category(chr(c))[0]
        _kind[c] = {"L": _LETTER, "M": _MARK}.get(category, _OTHER)
        _folded[c] = ord(chr(c).lower()[0]) if category in "LM" else SPACE
    return _folded[points], _kind[points] == _LETTER


def letter_vectors(points: np.ndarray, seed: int = 17) -> np.ndarray:
    """A row of DIM times +1 or -1 for each code point."""
    words = mix(mix(points.astype(np.uint64) + np.uint64(seed << 32))[:, None] + np.arange(1, DIM // 64 + 1, dtype=np.uint64))
    return np.unpackbits(words.astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray, seed: int = 17) -> np.ndarray:
    """The bound vectors of 3-grams, each three code points of 21 bits in one number."""
    triples = np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF])
    points, which = np.unique(triples, return_inverse=True)
    letters, (a, b, c) = letter_vectors(points, seed), which.reshape(3, -1)
    return np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every 3-gram and its row, and which rows have a letter. A text stands between two spaces; three spaces are no 3-gram."""
    points, lengths = code_points(data, offsets)
    points, letter = folded(points)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    spaced = np.full(len(points) + 2 * len(lengths), SPACE, np.int64)
    spaced[np.arange(len(points)) + 2 * rows + 1] = points
    owner = np.repeat(np.arange(len(lengths)), lengths + 2)
    codes = spaced[:-2] << 42 | spaced[1:-1] << 21 | spaced[2:]
    good = (owner[:-2] == owner[2:]) & (codes != (SPACE << 42 | SPACE << 21 | SPACE))
    return codes[good], owner[:-2][good], np.bincount(rows[letter], minlength=len(lengths)) > 0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def prototypes(labelled: DataFrame, seed: int = 17) -> DataFrame:
    """(lang, dim, value): the bundle of each language's texts in (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge() -> int:
            for name, parts in held.items():
                codes, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                counts = np.zeros(len(codes), np.int64)
                np.add.at(counts, which, np.concatenate([p[1] for p in parts]))
                held[name] = [(codes, counts)]
            return sum(len(parts[0][0]) for parts in held.values())

        def sent() -> Iterator[pa.RecordBatch]:
            merge()
            for lang, [(codes, counts)] in held.items():
                vector = np.zeros(DIM)
                for i in range(0, len(codes), BOUND):
                    vector += counts[i : i + BOUND].astype(np.float64) @ gram_vectors(codes[i : i + BOUND], seed).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(np.rint(vector).astype(np.int64))], names=["lang", "dim", "value"])
            held.clear()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            data, offsets = buffers(batch.column(0))
            for i, j in slices(offsets):
                codes, rows, _ = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                names, which = np.unique(np.array(langs[i:j], object).astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    if name not in held and len(held) >= HELD:
                        yield from sent()
                    held.setdefault(name, []).append(np.unique(codes[which[rows] == k], return_counts=True))
                if sum(len(p[0]) for parts in held.values() for p in parts) > HELD_GRAMS and merge() > HELD_GRAMS // 2:
                    yield from sent()
        yield from sent()

    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    return known.mapInArrow(run, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value"))


def bundles(codes: np.ndarray, rows: np.ndarray, n: int, seed: int = 17) -> np.ndarray:
    """The sum of each row's 3-gram vectors."""
    present, which = np.unique(codes, return_inverse=True)
    # Sums stay exact: whole numbers below 2**24 in the short form.
    kind = np.float32 if len(codes) < 2**24 else np.float64
    out = np.zeros((n, DIM), np.float64)
    for i in range(0, len(present), BOUND):
        some = slice(None) if len(present) <= BOUND else np.flatnonzero((which >= i) & (which < i + BOUND))
        width = min(BOUND, len(present) - i)
        counts = np.bincount(rows[some] * width + which[some] - i, minlength=n * width).reshape(n, width)
        out += counts.astype(kind) @ gram_vectors(present[i : i + BOUND], seed).astype(kind)
    return out


def predict(docs: DataFrame, model: DataFrame, columns: list[str], seed: int = 17) -> DataFrame:
    """`columns` of docs, lang_pred and score, with `_` behind a name that is one of columns. model: prototypes(), DIM rows for each language.

    A language has a name, so what comes to the driver grows with the number of languages, not of texts.
    """
    spark = docs.sparkSession
    rows = model.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v")).select("lang", F.col("v.value").alias("v")).collect()
    rows = sorted(rows, key=lambda r: r["lang"])
    vectors = np.array([r["v"] for r in rows], np.float64).reshape(-1, DIM)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    # A vector of DIM numbers for each language that has a name.
    shared = spark.sparkContext.broadcast(([r["lang"] for r in rows], vectors))
    text, made = free("_text", columns), [free(c, columns) for c in ("lang_pred", "score")]
    picked = docs.select(*columns, F.col("text").alias(text))
    schema = picked.drop(text).withColumns({made[0]: F.lit(""), made[1]: F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = shared.value
        for batch in batches:
            texts = batch.column(len(columns))
            data, offsets = buffers(texts)
            found, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            # Counts of a slice form a dense matrix: rows are limited too.
            for i, j in ((a, b) for x, y in slices(offsets) for a, b in ((k, min(k + 256, y)) for k in range(x, y, 256))):
                codes, row, letter = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if not len(codes) or not names:
                    continue
                bundle = bundles(codes, row, j - i, seed)
                # Sums along rows, each by itself: a text's score doesn't depend on its neighbours.
                dots = np.stack([(bundle * v).sum(1) for v in vectors], 1)
                cosine = dots / np.maximum(np.sqrt((bundle * bundle).sum(1, keepdims=True)), 1e-9)
                best = cosine.argmax(1)
                for k in np.flatnonzero(letter):
                    found[i + k], score[i + k] = names[best[k]], min(1.0, max(0.0, float(cosine[k, best[k]])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(score)], names=[*columns, *made])

    return picked.mapInArrow(run, schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    from docspark.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = prototypes(docs.where(F.col("doc_id").isNotNull() & ~F.col("held_out")))
    return predict(docs, model, ["doc_id", "held_out"])
