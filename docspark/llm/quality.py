"""Quality rules: plain text statistics, and bands of n-gram perplexity for each language.

The language model is over code points, as they are, with modified Kneser-Ney smoothing of order ORDER. Spark counts the
n-grams of the reference texts, each language by itself: texts that pass the plain rules and have few symbols and
repeated passages, so that junk is judged by what good text looks like and not by itself. Continuation counts, discounts,
context weights and probabilities are DataFrame aggregates and joins over n-grams, so the model grows with the corpus and
no task holds a language. It is stored as sorted arrays of 63-bit n-gram hashes with log probabilities and back-off
weights beside them, cut into PARTS by the last two code points of the context: all that one code point's probability
can ask for lies in one part. A model of up to BROADCAST_BYTES is sent to every task, a larger one part by part in passes
over the texts, whose sums are added up.

A text's perplexity is exp of the mean negative log probability of its code points. For each language, the quartiles of
log perplexity over its reference texts give a band; texts outside are rejected.

Nulls and odd rows: null text is empty, fails the plain rules and has null perplexity; null lang is a language of its
own; a language without a reference text has null perplexity and no band, and only the plain rules count. Rows are
independent otherwise, so repeated rows and ties change nothing but counts. An empty table gives an empty one. Columns of
any name pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import free, materialize, temporary
from docspark.llm.textbytes import Spans, buffers, code_points, lead_mask, mix, repeats, slices, space_mask, strings, tidy, total, words

ORDER = 5
MIN_WORDS, REPEAT_SHARE, WINDOW = 20, 30, 8
#: Reference texts have at most this many symbols, and repeated words, for 100 words.
REFERENCE_SYMBOLS, REFERENCE_REPEATS = 1, 5
#: A band reaches this many times the distance between the quartiles below the lower and above the upper one.
BELOW, ABOVE = 8.0, 4.0
#: Narrowest distance between the quartiles that a band is built on.
LEAST_SPREAD = 0.02
#: Parts of a model, and bytes of parts that are broadcast at once; further parts are scored in passes of their own.
PARTS, BROADCAST_BYTES = 256, 100_000_000
#: N-grams that a task holds before it merges them; it sends them if more than half of that are left.
HELD = 300_000
#: Bytes of text that are taken apart at once; the arrays that this needs are some 150 times as large.
SLICE = 300_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """STATS of each row of a column of texts."""
    n = len(offsets) - 1
    starts, ends, rows = words(data, offsets)
    spans = Spans(data)
    hashes = spans.hash(starts, ends)
    n_words = np.bincount(rows, minlength=n)
    repeated = np.zeros(n, np.int64)
    if (m := len(starts) - WINDOW + 1) > 0:
        inside = rows[:m] == rows[WINDOW - 1 :]
        window = mix(rows[:m].astype(np.uint64) + np.uint64(1))
        for k in range(WINDOW):
            window += hashes[k : k + m] * np.uint64(2 * k * 0x9E3779B97F4A7C15 + 0xBF58476D1CE4E5B9 & 2**64 - 1 | 1)
        at = np.flatnonzero(inside)
        at = at[repeats(window[at])]
        if len(at):
            edge = np.bincount(at, minlength=len(starts) + 1) - np.bincount(at + WINDOW, minlength=len(starts) + 1)
            repeated = np.bincount(rows[np.cumsum(edge[:-1]) > 0], minlength=n)
    begins = np.unique(np.r_[offsets[:-1][offsets[1:] > offsets[:-1]], np.flatnonzero(data == 10) + 1])
    begins = begins[begins < len(data)]
    stops = np.r_[begins, len(data)][1:].astype(np.int64)
    stops -= data[stops - 1] == 10
    solid = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
    begins, stops = begins[solid], stops[solid]
    owner = np.searchsorted(offsets, begins, "right") - 1
    # Equal keys stand together; which row they are of follows from any of them.
    line_key = mix(spans.hash(begins, stops) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(line_key, kind="stable")
    again = np.zeros(len(order), bool)
    again[1:] = line_key[order][1:] == line_key[order][:-1]
    return {
        "n_words": n_words,
        "word_chars": total(lead_mask(data) & ~space_mask(data), offsets),
        "n_symbols": total(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(owner[order][again], minlength=n),
        "n_repeat_words": repeated,
    }


def base_failed(stats: dict) -> np.ndarray:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > REPEAT_SHARE * stats["n_words"])


def is_reference(stats: dict) -> np.ndarray:
    return ~base_failed(stats) & (100 * stats["n_symbols"] <= REFERENCE_SYMBOLS * stats["n_words"]) & (100 * stats["n_repeat_words"] <= REFERENCE_REPEATS * stats["n_words"])


_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0xD1342543DE82EF95, k, 2**64) for k in range(ORDER)], np.uint64)


def gram_hash(grams: np.ndarray) -> np.ndarray:
    """63-bit hashes of the n-grams that are the rows of a matrix of code points."""
    spread = mix(grams.astype(np.uint64) + _STEP)
    return (mix((spread * _POWERS[: grams.shape[1]]).sum(1, dtype=np.uint64) + np.uint64(grams.shape[1])) >> np.uint64(1)).astype(np.int64)


def char_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All code points with ORDER - 1 spaces before each row's, and where in them each row's own begin."""
    points, lengths = code_points(data, offsets)
    ahead = ORDER - 1
    begins = np.r_[0, np.cumsum(lengths)][:-1]
    padded = np.full(len(points) + ahead * len(lengths), ord(" "), np.uint32)
    row = np.repeat(np.arange(len(lengths)), lengths)
    padded[np.arange(len(points)) + ahead * (row + 1)] = points
    return padded, begins + ahead * np.arange(1, len(lengths) + 1)


def distinct_grams(padded: np.ndarray, at: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the ORDER-grams that end at `at`: each one's key and first place within `at`, the number of times, and which one each is.

    salt: a number for each of `at`; n-grams of different salts differ.
    """
    spread = mix(padded.astype(np.uint64) + _STEP)
    whole = spread * _POWERS[ORDER - 1]
    for k in range(1, ORDER):
        whole[k:] += spread[: len(spread) - k] * _POWERS[ORDER - 1 - k]
    key = mix(whole[at] + salt)
    order = np.argsort(key)
    ordered = key[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(key) else np.zeros(0, bool)
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    return ordered[begin], order[begin], np.diff(np.r_[begin, len(key)]), which


def _rows_of(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    return padded[at[:, None] + np.arange(1 - ORDER, 1)]


def _char_places(begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all rows' own code points, and the row of each."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    return np.arange(len(row)) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths), row


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all reference texts of docs; '' stands for a null lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        ids: dict[str, int] = {}
        held: list[tuple[np.ndarray, ...]] = []

        def merge() -> None:
            key, lang, count, grams = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(key)
            new = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            held[:] = [(key[order[new]], lang[order[new]], np.add.reduceat(count[order], new, dtype=np.int64), grams[order[new]])]

        def sent() -> Iterator[pa.RecordBatch]:
            names = np.array(list(ids), object)
            for _, lang, count, grams in held:
                for i in range(0, len(lang), 100_000):
                    some = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(names[lang[some]], pa.string()), strings(grams[some]), pa.array(count[some].astype(np.int64))], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            data, offsets = buffers(batch.column(0))
            langs = [x or "" for x in batch.column(1).to_pylist()]
            for i, j in slices(offsets, SLICE):
                own, where = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                padded, begins = char_grams(own, where)
                lengths = np.diff(np.r_[begins, len(padded) + ORDER - 1]) - (ORDER - 1)
                at, row = _char_places(begins, lengths)
                good = is_reference(statistics(own, where))[row]
                at, lang = at[good], np.array([ids.setdefault(x, len(ids)) for x in langs[i:j]], np.int32)[row[good]]
                key, first, count, _ = distinct_grams(padded, at, mix(lang.astype(np.uint64)))
                if len(key):
                    held.append((key, lang[first], count.astype(np.int32), _rows_of(padded, at[first])))
                if sum(len(h[0]) for h in held) > HELD:
                    merge()
                    if len(held[0][0]) > HELD // 2:
                        yield from sent()
        if held:
            merge()
            yield from sent()
        tidy()

    return docs.select("text", "lang").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(level: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): discounts of counts 1, 2, and 3 or more, from the numbers of n-grams counted 1 to 4 times."""
    seen = level.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    n1, n2, n3, n4 = (F.col(f"n{k}") for k in (1, 2, 3, 4))
    y, known = n1 / (n1 + 2 * n2), (n1 > 0) & (n2 > 0) & (n3 > 0)

    def held(found: Column, least: float, most: float, other: float) -> Column:
        return F.when(known, F.least(F.greatest(found, F.lit(least)), F.lit(most))).otherwise(other)

    return seen.select("lang", held(1 - 2 * y * n2 / n1, 0.05, 1.0, 0.5).alias("d1"), held(2 - 3 * y * n3 / n2, 0.1, 2.0, 1.0).alias("d2"), held(3 - 4 * y * n4 / n3, 0.15, 3.0, 1.5).alias("d3"))


def smoothed(counts: DataFrame) -> DataFrame:
    """(lang, kind, n, gram, value) of all orders: kind p is an n-gram's log probability, kind b a context's log back-off weight.

    The row with n = 0 has the log probability of a code point that the language hasn't got. counts: a written table.
    """
    levels = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        # A lower order counts the distinct code points before an n-gram.
        levels[n] = materialize(levels[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("n")), f"grams-{n}")
    # One code point more than there are stands for all others.
    lower, out = levels[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p")).withColumn("suffix", F.lit("")), []
    for n in range(1, ORDER + 1):
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = levels[n].join(F.broadcast(_discounts(levels[n])), "lang")  # a row for each language
        own = own.select("lang", "gram", "n", F.least(taken, F.col("n")).alias("taken"), F.substring("gram", 1, n - 1).alias("context"), F.substring("gram", 2, n - 1).alias("suffix"))
        contexts = own.groupBy("lang", "context").agg(F.sum("n").alias("whole"), (F.sum("taken") / F.sum("n")).alias("weight"))
        p = (F.col("n") - F.col("taken")) / F.col("whole") + F.col("weight") * F.col("p")
        both = own.join(contexts, ["lang", "context"]).join(lower, ["lang", "suffix"]).select("lang", "gram", p.alias("p"))
        lower_now = materialize(both, f"smoothed-{n}")
        out.append(lower_now.select("lang", F.lit("p").alias("kind"), F.lit(n).alias("n"), "gram", F.log("p").alias("value")))
        if n == 1:
            rest = contexts.join(lower, "lang").select("lang", F.lit("p").alias("kind"), F.lit(0).alias("n"), F.lit("").alias("gram"), F.log(F.col("weight") * F.col("p")).alias("value"))
        else:
            rest = contexts.select("lang", F.lit("b").alias("kind"), F.lit(n - 1).alias("n"), F.col("context").alias("gram"), F.log("weight").alias("value"))
        out.append(rest)
        lower = lower_now.withColumnRenamed("gram", "suffix")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def _part(context: np.ndarray) -> np.ndarray:
    """The part of a model that belongs to a context: rows of two code points, the last ones before a character."""
    return (gram_hash(context) % PARTS).astype(np.int32)


def build_model(counts: DataFrame) -> DataFrame:
    """(lang, kind, n, part, keys, entries) of gram_counts(), a written table: hashes in ascending order and values beside them.

    Part -1 has what is shorter than two code points of context and goes with every other part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, n = np.array(batch.column(1).to_pylist(), object), batch.column(2).to_numpy()
            points, lengths = code_points(*buffers(batch.column(3)))
            begins = np.cumsum(lengths) - lengths
            hashes, parts = np.zeros(len(n), np.int64), np.full(len(n), -1, np.int32)
            for k in np.unique(n):
                mine = np.flatnonzero(n == k)
                grams = points[begins[mine][:, None] + np.arange(k)]
                hashes[mine] = gram_hash(grams)
                for is_p, least in ((True, 3), (False, 2)):
                    some = (kind[mine] == "p") == is_p
                    if k >= least and some.any():
                        parts[mine[some]] = _part(grams[some][:, -3:-1] if is_p else grams[some][:, -2:])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(parts), pa.array(hashes), pa.array(batch.column(4).to_numpy().astype(np.float32))], names=["lang", "kind", "n", "part", "key", "entry"])

    flat = smoothed(counts).mapInArrow(run, "lang string, kind string, n int, part int, key long, entry float")
    both = flat.groupBy("lang", "kind", "n", "part").agg(F.sort_array(F.collect_list(F.struct("key", "entry"))).alias("rows"))
    return both.select("lang", "kind", "n", "part", F.col("rows.key").alias("keys"), F.col("rows.entry").alias("entries"))


def fit(docs: DataFrame) -> DataFrame:
    """The model of docs' own reference texts, as a written table; the n-grams that it is made of go."""
    with temporary(docs.sparkSession) as keep:
        return keep(materialize(build_model(materialize(gram_counts(docs), "gram-counts")), "kneser-ney"))


class HashArray:
    """Sorted 63-bit hashes with an index on their leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(1, int(np.ceil(np.log2(len(keys) + 1))))
        self.shift = 63 - bits
        self.index = np.searchsorted(keys >> self.shift, np.arange(2**bits + 1)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        bucket = hashes >> self.shift
        at, end = self.index[bucket], self.index[bucket + 1]
        found = np.full(len(hashes), -1, np.int32)
        todo = np.flatnonzero(at < end)
        while len(todo):
            hit = self.keys[at[todo]] == hashes[todo]
            found[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return found


#: A language's arrays: by kind and n.
Model = dict[tuple[str, int], HashArray]


def log_probability(model: Model, grams: np.ndarray) -> np.ndarray:
    """Of the last code point of each row: the longest known n-gram's, and the back-off weights of the contexts that had none."""
    out, todo = np.zeros(len(grams)), np.arange(len(grams))
    for n in range(ORDER, 0, -1):
        own = grams[todo]
        if ("p", n) in model:
            at = model["p", n].find(gram_hash(own[:, ORDER - n :]))
            known = at >= 0
            out[todo[known]] += model["p", n].values[at[known]]
            todo, own = todo[~known], own[~known]
        if n > 1 and len(todo) and ("b", n - 1) in model:
            at = model["b", n - 1].find(gram_hash(own[:, ORDER - n : -1]))
            out[todo] += np.where(at >= 0, model["b", n - 1].values[at], np.float32(0))
    out[todo] += model["p", 0].values[0]
    return out


def _passes(model: DataFrame) -> list[tuple[int, int]]:
    """Ranges of parts, of all languages, that are sent together; they cover all parts."""
    sizes = {r["part"]: r["size"] for r in model.groupBy("part").agg(F.sum(F.size("keys") * 12).alias("size")).collect()}  # PARTS rows
    begins, held = [0], 0
    for part in range(PARTS):
        size = sizes.get(part, 0)
        if held and held + size > BROADCAST_BYTES:
            begins.append(part)
            held = 0
        held += size
    return list(zip(begins, [*begins[1:], PARTS], strict=True))


def _sent(model: DataFrame, low: int, high: int) -> dict[str, list[tuple]]:
    """{lang: [(kind, n, keys, values)]} of the parts from low to high and of part -1, hashes in order over all parts."""
    rows = model.where((F.col("part") < 0) | F.col("part").between(low, high - 1)).toArrow()
    held: dict[tuple, list] = {}
    for lang, kind, n, keys, values in zip(*(rows.column(c).to_pylist() for c in ("lang", "kind", "n")), *(rows.column(c).combine_chunks() for c in ("keys", "entries")), strict=True):
        held.setdefault((lang, kind, n), []).append((keys.values.to_numpy(), values.values.to_numpy()))
    out: dict[str, list[tuple]] = {}
    for (lang, kind, n), found in held.items():
        keys, values = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(keys)
        out.setdefault(lang, []).append((kind, n, keys[order], values[order]))
    return out


_MEASURES = {**dict.fromkeys(STATS, "bigint"), "base_failed": "boolean", "reference": "boolean", "chars": "bigint", "log_p": "double"}


def score(docs: DataFrame, model: DataFrame, name: str) -> DataFrame:
    """docs with `name`, a struct of STATS, base_failed, reference and log_perplexity (null for empty text or a language without a model).

    Only text and lang go to Python and only numbers come back. model: a written table of build_model().
    """
    groups = _passes(model)
    kind = f"struct<{','.join(f'{k}:{v}' for k, v in _MEASURES.items())}>"

    def measured(low: int, high: int) -> Callable:
        shared = docs.sparkSession.sparkContext.broadcast((_sent(model, low, high), low, high))

        @F.arrow_udf(kind)
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            tidy()
            measure = _measurer(*shared.value)
            for texts, langs in batches:
                yield pa.StructArray.from_arrays(measure(texts, langs), names=list(_MEASURES))

        return run

    lang = F.coalesce("lang", F.lit(""))
    if len(groups) == 1:
        held = docs.withColumn(name, measured(*groups[0])("text", lang))
    else:  # a text's sums over the passes meet by its hash and language
        key, pair = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
        parts = [docs.select(key.alias("k1"), pair.alias("k2"), lang.alias("l"), measured(*g)("text", lang).alias("m")).distinct() for g in groups]
        summed = parts[0]
        for more in parts[1:]:
            summed = summed.unionByName(more)
        first = F.first("m").alias("m")
        summed = summed.groupBy("k1", "k2", "l").agg(first, F.sum("m.log_p").alias("s"))
        summed = materialize(summed.select("k1", "k2", "l", F.col("m").withField("log_p", F.col("s")).alias(name)), "pass-sums")
        own = docs.withColumns(dict(zip(keys := [free(x, docs.columns) for x in ("_k1", "_k2", "_l")], (key, pair, lang), strict=True)))
        held = own.join(summed, (own[keys[0]] == summed["k1"]) & (own[keys[1]] == summed["k2"]) & (own[keys[2]] == summed["l"])).select(*[own[c] for c in docs.columns], summed[name])
    m = F.col(name)
    mean = F.when(m["chars"] > 0, -m["log_p"] / m["chars"])
    return held.withColumn(name, F.struct(*[m[s].alias(s) for s in STATS], m["base_failed"].alias("base_failed"), m["reference"].alias("reference"), mean.alias("log_perplexity")))


def _measurer(sent: dict[str, list[tuple]], low: int, high: int) -> Callable:
    """A function from texts and languages to arrays of _MEASURES, for use within a task; only characters of parts from low to high count in log_p."""
    models: dict[str, Model] = {lang: {(kind, n): HashArray(keys, values) for kind, n, keys, values in rows} for lang, rows in sent.items()}

    def measure(texts: pa.Array, languages: pa.Array) -> list[pa.Array]:
        data, offsets = buffers(texts)
        langs = np.array(languages.to_pylist(), object)
        parts = []
        for i, j in slices(offsets, SLICE):
            own, where = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            stats = statistics(own, where)
            padded, begins = char_grams(own, where)
            lengths = np.diff(np.r_[begins, len(padded) + ORDER - 1]) - (ORDER - 1)
            at, row = _char_places(begins, lengths)
            names, which = np.unique(langs[i:j].astype(str), return_inverse=True)
            # Few of the possible n-grams occur in a slice: each is looked up once.
            _, first, _, code = distinct_grams(padded, at, mix(which[row].astype(np.uint64)))
            grams, owner, log_p = _rows_of(padded, at[first]), which[row[first]], np.full(len(first), np.nan)
            for k, name in enumerate(names):
                if name in models:
                    mine = np.flatnonzero(owner == k)
                    part = _part(grams[mine, -3:-1])
                    log_p[mine] = np.where((part >= low) & (part < high), log_probability(models[name], grams[mine]), 0)
            sums, full = np.full(j - i, np.nan), np.flatnonzero(lengths > 0)
            if len(full):  # each row's own sum: equal texts get equal numbers
                sums[full] = np.add.reduceat(log_p[code], (np.cumsum(lengths) - lengths)[full])
            parts.append([*(stats[s] for s in STATS), base_failed(stats), is_reference(stats), lengths, sums])
        joined = [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [np.zeros(0)] * len(_MEASURES)
        kinds = [np.int64] * len(STATS) + [bool, bool, np.int64]
        return [pa.array(c.astype(t)) for c, t in zip(joined[:-1], kinds, strict=True)] + [pa.array(joined[-1].astype(np.float64), from_pandas=True)]

    return measure


def bands(scored: DataFrame, name: str, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """(lang, lower, upper) of log perplexity, from the quartiles of all reference texts of score()."""
    m = F.col(name)
    q = scored.where(m["reference"]).groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.percentile_approx(m["log_perplexity"], [0.25, 0.5, 0.75], 10_000).alias("q"))
    spread = F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(LEAST_SPREAD))
    return q.select("lang", (F.col("q")[0] - below * spread).alias("lower"), (F.col("q")[2] + above * spread).alias("upper"))


def verdict(scored: DataFrame, band: DataFrame, name: str, kept: str) -> DataFrame:
    """scored with the boolean `kept`: the text passes the plain rules and lies in its language's band, if there is one."""
    key, limits = free("_band", [*scored.columns, kept]), free("_limits", [*scored.columns, kept])
    b = band.select(F.col("lang").alias(key), F.struct("lower", "upper").alias(limits))
    m, lim = F.col(name), F.col(limits)
    inside = F.coalesce(m["log_perplexity"].between(lim["lower"], lim["upper"]), F.lit(True))
    joined = scored.join(F.broadcast(b), F.coalesce(scored["lang"], F.lit("")) == b[key], "left")  # a row for each language
    return joined.withColumn(kept, ~m["base_failed"] & inside).drop(key, limits)


def judged(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs, written with their measures and verdicts; the names of these two columns."""
    name = free("_measured", docs.columns)
    kept = free("_kept", [*docs.columns, name])
    with temporary(docs.sparkSession) as keep:
        scored = keep(materialize(score(docs, fit(docs), name), "quality-scores"))
    return verdict(scored, bands(scored, name), name, kept), name, kept


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    from docspark.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    name = "_measured"
    with temporary(spark) as keep:
        scored = keep(materialize(score(docs, fit(docs), name).drop("text"), "quality-scores"))
    m = F.col(name)
    out = verdict(scored, bands(scored, name), name, "kept")
    return out.select("doc_id", *[m[s].alias(s) for s in STATS], m["base_failed"].alias("base_failed"), "kept", F.exp(m["log_perplexity"]).alias("perplexity"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """docs without those that the rules reject."""
    found, _, kept = judged(docs)
    return found.where(F.col(kept)).select(*docs.columns)
