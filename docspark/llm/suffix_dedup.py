"""Removal of every byte that a repeated string of `length` bytes covers, by a parse into phrases.

A rolling hash over WIDTH bytes triggers phrases: of each run of REACH positions, the one with the smallest hash starts
a phrase. So a string of `length` bytes has its first phrase at a place that follows from its own bytes, wherever it
stands, and at least `right` = length - REACH + 1 of its bytes follow that place. The dictionary entry of a phrase is
those bytes; an entry found at a single place can't begin a repeat, and ends there. The other places bring their
context, and in each dictionary entry's group the suffixes that begin left of the phrase are put in corpus order: one
suffix array orders the text from the phrase on (the parse), one the text before it, read backwards (the phrases'
suffixes), and the longest common prefixes of neighbours say which places agree to any depth. A string that starts `a`
bytes before the phrase repeats if another place agrees on `a` bytes to the left and length - a to the right.

Equal texts count once, by a 64-bit key, and are removed whole if they have `length` bytes; repeated rows are equal
texts. Null text is empty. Shorter texts keep all. An empty table gives an empty one; other columns pass through.
A group holds the places of one dictionary entry, up to LARGE; places of a task with equal surroundings come as one.
Entries with more places have no group: each string of `length` bytes that their places begin is named by a 64-bit hash,
counted, and the counts are joined back, so a passage at the edge of which all texts differ is held by no task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import materialize, partitions
from docspark.llm.textbytes import Spans, buffers, mix, slices, tidy

LENGTH, REACH, WIDTH = 200, 120, 16
#: Rows of groups that are resolved together.
TOGETHER = 40_000
#: Places of an entry that are resolved as a group; strings of entries with more are counted by their hashes.
LARGE = 40_000


def text_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))


def places(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Row, first start, last start, phrase place (all within the row) and dictionary hash of each phrase that begins strings of `length` bytes.

    The strings that start from first to last start have this phrase as their first.
    """
    n = len(data)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    long_rows = np.flatnonzero(np.diff(offsets) >= length)
    if not len(long_rows):
        return none
    spans = Spans(data)
    rolling = mix((spans.sums[WIDTH:] - spans.sums[:-WIDTH]) * spans.down[: n - WIDTH + 1])
    # Hash above, place below: the minimum is the leftmost of the smallest.
    packed = (rolling & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(rolling), dtype=np.uint64)
    padded = np.full(-(-(len(packed) + REACH) // REACH) * REACH, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(packed)] = packed
    blocks = padded.reshape(-1, REACH)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    at = np.minimum(behind[: len(packed)], ahead[REACH - 1 : REACH - 1 + len(packed)]).astype(np.uint32).astype(np.int64)
    edge = np.zeros(n + 1, np.int8)
    edge[offsets[long_rows]] += 1
    edge[offsets[long_rows + 1] - length + 1] -= 1
    valid = np.cumsum(edge[: len(at)], dtype=np.int8) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    over = valid.copy()
    over[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    last = np.flatnonzero(over)
    phrase = at[first]
    row = np.searchsorted(offsets, first, "right") - 1
    begin = offsets[row]
    return row, first - begin, last - begin, phrase - begin, spans.hash(phrase, phrase + length - REACH + 1)


def _pack(first: np.ndarray, last: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """One long for a place: the phrase, and how far the first and the last start lie before it."""
    return (phrase << 16) | ((phrase - first) << 8) | (phrase - last)


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    phrase = place >> 16
    return phrase - (place >> 8 & 255), phrase - (place & 255), phrase


def phrase_places(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(entry, key, place, more) of each entry in each text; `more` has its other places there, as bytes: a text may repeat a word thousands of times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            data, offsets = buffers(batch.column(1))
            for i, j in slices(offsets, 1_000_000):
                row, first, last, phrase, entry = places(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                if not len(row):
                    continue
                order = np.lexsort((phrase, entry, row))
                row, entry, place = row[order], entry[order], _pack(first, last, phrase)[order]
                begin = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (entry[1:] != entry[:-1])])
                end = np.r_[begin[1:], len(row)]
                # The others' bytes lie side by side in `place` once the first of each run is left out.
                rest = np.ones(len(row), bool)
                rest[begin] = False
                alone = end - begin == 1
                where = np.r_[0, np.cumsum(8 * (end - begin - 1))].astype(np.int32)
                valid = np.packbits(~alone, bitorder="little")
                more = pa.Array.from_buffers(pa.binary(), len(begin), [pa.py_buffer(valid), pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(place[rest]))])
                yield pa.RecordBatch.from_arrays([pa.array(entry[begin].view(np.int64)), pa.array(keys[i + row[begin]]), pa.array(place[begin]), more], names=["entry", "key", "place", "more"])

    return keyed.select("key", "text").mapInArrow(run, "entry long, key long, place long, more binary")


def repeated_places(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, places) of the phrases whose dictionary entry stands at two places or more; `large` if at more than LARGE, copies included."""
    rows = phrase_places(keyed, length)
    # Smallest and largest differ if there are two places: copies of a text don't make one, and partial sums are one row an entry.
    one, other = F.xxhash64("key", "place"), F.when(F.col("more").isNotNull(), F.xxhash64("key", "more"))
    entries = rows.groupBy("entry").agg(F.min(F.least(one, other)).alias("a"), F.max(F.greatest(one, other)).alias("b"), F.sum(1 + F.coalesce(F.octet_length("more") / 8, F.lit(0))).alias("n")).where("a < b").select("entry", (F.col("n") > LARGE).alias("large"))
    return rows.join(entries, "entry").groupBy("key").agg(F.collect_set(F.struct("place", "more", "large")).alias("places"))


_NAMES = ["entry", "key", "place", "context", "twice", "begin", "end"]
_SCHEMA = "entry long, key long, place long, context binary, twice boolean, begin long, end long"


def _rows(n: int, **columns) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(_NAMES, kinds, strict=True)], names=_NAMES)


def contexts(texts: DataFrame, length: int = LENGTH, large: bool = False) -> DataFrame:
    """Of (key, text, places): (entry, key, place, context, twice), the bytes that the strings of each place cover, or (key, begin, end).

    Places of a task with one context repeat each other: all of them are answered at once, by `begin` and `end`, and one
    goes on to the other tasks, with twice set. large: the places of large entries, whose strings go on instead: entry is
    then a string's hash and place where it begins. The strings of a batch are merged as its contexts are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            data, offsets = buffers(batch.column(1))
            lists = batch.column(2)
            found = lists.flatten()
            owner = np.repeat(np.arange(len(keys)), np.diff(lists.offsets.to_numpy()))
            more, more_at = buffers(found.field("more"))
            owner = np.r_[owner, np.repeat(owner, np.diff(more_at) // 8)]
            place = np.r_[found.field("place").to_numpy(), np.frombuffer(more.tobytes(), np.int64)]
            flag = found.field("large").to_numpy(zero_copy_only=False)
            mine = np.r_[flag, np.repeat(flag, np.diff(more_at) // 8)] == large
            owner, place = owner[mine], place[mine]
            for i in range(0, len(place), 20_000):
                own, where = owner[i : i + 20_000], place[i : i + 20_000]
                start, last, phrase = _unpack(where)
                first, last, phrase = start + offsets[own], last + offsets[own], phrase + offsets[own]
                sizes = last + length - first
                edges = np.r_[0, np.cumsum(sizes)]
                block = data[np.arange(edges[-1]) + np.repeat(first - edges[:-1], sizes)]
                spans = Spans(block)
                to = phrase - first + edges[:-1]
                entry = spans.hash(to, to + length - REACH + 1).view(np.int64)
                same = mix(spans.hash(edges[:-1], edges[1:]) + (where & 0xFFFF).astype(np.uint64))
                _, one, which, count = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
                if large:
                    for k in range(0, len(one), 5_000):
                        some = one[k : k + 5_000]
                        yield from strings(spans, edges[some], (last - first)[some] + 1, keys[own[some]], start[some], count[k : k + 5_000] > 1)
                else:
                    blob = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(block)])
                    yield _rows(len(one), entry=entry[one], key=keys[own[one]], place=where[one], context=blob.take(pa.array(one)), twice=count > 1)
                if len(known := np.flatnonzero(count[which] > 1)):
                    own, begin, end = _merged_rows(own[known], start[known], (start + sizes)[known])
                    # No entry is theirs: any task will do.
                    yield _rows(len(own), entry=mix(keys[own].view(np.uint64) + begin.astype(np.uint64)).view(np.int64), key=keys[own], begin=begin, end=end)

    def strings(spans: Spans, at: np.ndarray, n: np.ndarray, key: np.ndarray, start: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
        place = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        begin = at[place] + step
        name = spans.hash(begin, begin + length).view(np.int64)
        _, one, which, count = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
        several = (count > 1) | (np.bincount(which, twice[place]) > 0)
        begin = start[place] + step
        yield _rows(len(one), entry=name[one], key=key[place[one]], place=begin[one], twice=several)
        if len(known := np.flatnonzero(several[which])):
            own, begin, end = _merged_rows(place[known], begin[known], begin[known] + length)
            yield _rows(len(own), entry=mix(key[own].view(np.uint64) + begin.astype(np.uint64)).view(np.int64), key=key[own], begin=begin, end=end)

    return texts.select("key", "text", "places").mapInArrow(run, _SCHEMA)


def _merged_rows(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of intervals of each row, as row, begin and end of their runs."""
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], end[order]
    wide = int(end.max()) + 1
    # Rows one after another on a line, so that one running maximum serves all.
    reach = np.maximum.accumulate(end + row * wide) - row * wide
    new = np.r_[True, (row[1:] != row[:-1]) | (begin[1:] > reach[:-1])]
    return row[new], begin[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(row) - 1]]


def _order(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the rows, and of each in that order how many bytes it shares with the one before."""
    order = np.argsort(np.ascontiguousarray(matrix).view(f"S{matrix.shape[1]}").ravel(), kind="stable")
    ordered = matrix[order]
    differ = ordered[1:] != ordered[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), matrix.shape[1])
    return order, np.r_[-1, shared]


def _filled(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, width: int, step: int) -> np.ndarray:
    """A row of `width` bytes for each run that goes from `begin` by `step`; zeros after its end."""
    cols = np.arange(width)
    index = begin[:, None] + step * cols
    return np.where(cols < sizes[:, None], data[np.clip(index, 0, max(len(data) - 1, 0))], np.uint8(0))


def resolve(entry: np.ndarray, place: np.ndarray, twice: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """[from, to) that repeated strings cover around each place, -1 if there are none. Rows of an entry stand together; twice: the row stands for more."""
    first, last, phrase = _unpack(place)
    left, least = phrase - first, phrase - last
    group = np.cumsum(np.r_[True, entry[1:] != entry[:-1]]).astype(">u4")
    head = group.view(np.uint8).reshape(-1, 4)
    right_order, right_shared = _order(np.hstack([head, _filled(data, offsets[:-1] + left, np.diff(offsets) - left, length, 1)]))
    left_order, left_shared = _order(np.hstack([head, _filled(data, offsets[:-1] + left - 1, left, REACH, -1)]))
    n = len(entry)
    low, high = np.full(n, REACH, np.int64), np.full(n, -1, np.int64)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(REACH):
        rows = np.flatnonzero((least <= a) & (a <= left))
        if not len(rows):
            continue
        right_class[right_order] = np.cumsum(right_shared < 4 + length - a)
        left_class[left_order] = np.cumsum(left_shared < 4 + a)
        pair = left_class[rows] * (n + 1) + right_class[rows]
        order = np.argsort(pair)
        begin = np.flatnonzero(np.r_[True, pair[order][1:] != pair[order][:-1]])
        several = np.add.reduceat(1 + twice[rows[order]], begin) > 1
        hit = rows[order[np.repeat(several, np.diff(np.r_[begin, len(rows)]))]]
        low[hit], high[hit] = np.minimum(low[hit], a), np.maximum(high[hit], a)
    # The strings of a place start less than `length` bytes apart, so their union has no gap.
    return np.where(high[:, None] >= 0, np.c_[phrase - high, phrase - low + length], -1)


def repeated_intervals(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, begin, end) of repeated strings' unions, from contexts()."""
    dealt = found.repartition(partitions(found.sparkSession), "entry").sortWithinPartitions("entry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        held: pa.Table | None = None

        def made(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            known = rows.filter(pa.compute.is_valid(rows.column("begin")))
            if known.num_rows:
                yield from known.select(["key", "begin", "end"]).to_batches()
            rows = rows.filter(pa.compute.is_null(rows.column("begin"))).combine_chunks()
            if not rows.num_rows:
                return
            entry, key, place, twice = (rows.column(c).to_numpy() for c in ("entry", "key", "place", "twice"))
            out = resolve(entry, place, twice.astype(np.int64), *buffers(rows.column("context")), length)
            hit = out[:, 0] >= 0
            yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(out[hit, 0]), pa.array(out[hit, 1])], names=["key", "begin", "end"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows >= TOGETHER:  # whole groups only; the last may go on
                entry = held.column("entry").to_numpy()
                cut = int(np.searchsorted(entry, entry[-1]))
                if cut:
                    yield from made(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None:
            yield from made(held)

    return dealt.mapInArrow(run, "key long, begin long, end long")


def repeated_strings(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, begin, end) of repeated strings' unions, from a written table of contexts() of large entries."""
    known = found.where("begin IS NOT NULL").select("key", "begin", "end")
    strings = found.where("begin IS NULL").select("entry", "key", "place", "twice")
    several = strings.groupBy("entry").agg(F.sum(1 + F.col("twice").cast("int")).alias("n")).where("n > 1").select("entry")
    hits = strings.join(several, "entry")
    # A place's neighbours bring much the same: strings that begin in one stretch of `length` bytes overlap or touch.
    runs = hits.groupBy("key", F.floor(F.col("place") / length)).agg(F.min("place").alias("begin"), (F.max("place") + length).alias("end"))
    return known.unionByName(runs.select("key", "begin", "end"))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of a union of intervals; runs that touch are one."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.r_[True, begin[1:] > reach[:-1]]
    return begin[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(begin) - 1]]


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, spans, kept) of each distinct text that loses bytes to repeats in other texts or in itself: spans of (begin, end), and the bytes that stay.

    docs: (text). A text that equals another goes whole, whatever this says of it.
    """
    keyed = text_key(docs).select("key", F.coalesce("text", F.lit("")).alias("text"))
    # Copies collapse before the texts are shuffled.
    texts = keyed.where(F.octet_length("text") >= length).groupBy("key").agg(F.first("text").alias("text"))
    held = materialize(texts.join(repeated_places(keyed, length), "key"), "repeated-texts")
    found = repeated_intervals(contexts(held, length), length)
    crowded = held.where(F.exists("places", lambda p: p["large"]))
    if not crowded.isEmpty():
        found = found.unionByName(repeated_strings(materialize(contexts(crowded, length, large=True), "strings"), length))
    spans = found.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            texts, lists = batch.column(1), batch.column(2)
            spans, kept = [], []
            for i in range(batch.num_rows):
                data, own = texts[i].as_py().encode(), lists[i].values
                begin, end = merged(own.field("begin").to_numpy(), own.field("end").to_numpy())
                spans.append([{"begin": b, "end": e} for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
                kept.append(b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["key", "spans", "kept"])

    return held.select("key", "text").join(spans, "key").select("key", "text", "spans").mapInArrow(run, "key long, spans array<struct<begin:long,end:long>>, kept binary")


def removal_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    heads = materialize(text_key(docs).select("doc_id", "key", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")), "text-heads")
    spans = removed_spans(docs, length).select("key", F.size("spans").cast("long").alias("n"), F.octet_length("kept").cast("long").alias("left"), F.sha2("kept", 256).alias("kept_sha"))
    copied = heads.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    known = spans.join(copied, "key", "full_outer")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return heads.join(known, "key", "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).when(F.col("n").isNotNull(), F.col("n_bytes") - F.col("left")).otherwise(0).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from docspark.llm.common import table

    return removal_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(n - 199)) AS i FROM d WHERE n >= 200)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM s) WHERE c > 1),
g AS (SELECT doc_id, i, sum(brk) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS brk FROM r)),
spans AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, g),
gaps AS (SELECT doc_id, b AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), NULL) AS b FROM spans UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY 1),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * g.a + 1, 2 * (coalesce(g.b, n) - g.a)), '' ORDER BY g.a) AS k FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM spans GROUP BY 1)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.k, h))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
