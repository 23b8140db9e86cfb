"""Best-fit packing into sequences of a fixed length, planned on the histogram of piece lengths.

A text is cut into pieces of at most `size` tokens. How many pieces there are of each length, `size` numbers at most,
is all that the plan needs: best-fit decreasing runs over counts, and moves whole ranges of sequences from one room
left to the next. A plan row says: pieces of this length with ranks from here on go to these sequences at this offset.
Pieces then look up their slot by their rank within their length; ranks come from bucket counts, so a length that a
third of all pieces share is never sorted in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import free, materialize, ranked
from docspark.llm.textbytes import tidy

SIZE = 2048


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens: one piece if it fits, else full pieces after a first one with the rest."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return ([(0, first)] if first else []) + [(s, size) for s in range(first, n, size)]


def token_pieces(docs: DataFrame, tokenizer_json: str, columns: list[str], end_id: int = 0, size: int = SIZE) -> DataFrame:
    """`columns` of docs, piece, start, length and ids (little-endian unsigned 32-bit) of each piece; null text is empty.

    Every row has one piece at least, since `end_id` closes each text. A new name that is one of `columns` has `_` behind it.
    """
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(tokenizer_json)
    text, made_names = free("_text", columns), [free(c, columns) for c in ("piece", "start", "length", "ids")]
    picked = docs.select(*columns, F.col("text").alias(text))
    kinds = zip(made_names, ("int", "long", "long", "binary"), strict=True)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]], *[f"`{n}` {k}" for n, k in kinds]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        from docspark.llm.tokens import token_ids

        encode, end = token_ids(source.value), np.array([end_id], "<u4").tobytes()

        def made(batch: pa.RecordBatch, out: list) -> pa.RecordBatch:
            row, piece, start, length, ids = zip(*out, strict=True)
            own = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:-1]]
            return pa.RecordBatch.from_arrays([*own, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=[*columns, *made_names])

        for batch in batches:
            out, held = [], 0
            texts = batch.column(len(columns))
            for row in range(batch.num_rows):
                ids = encode(texts[row].as_py() or "") + end
                out += [(row, k, s, n, ids[4 * s : 4 * (s + n)]) for k, (s, n) in enumerate(cut(len(ids) // 4, size))]
                held += len(ids)
                if held > 8_000_000:
                    yield made(batch, out)
                    out, held = [], 0
            if out:
                yield made(batch, out)
        del encode  # with all the pre-tokens that it remembers
        tidy()

    return picked.mapInArrow(run, schema)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """(length, rank_begin, rank_end, sequence_begin, offset): best fit of all pieces, longest first.

    Pieces with rank_begin <= rank < rank_end go to sequence_begin + rank - rank_begin. Ranges of sequences with equal
    room move together; each length splits one range at most and opens one, so their number is bounded by `size`.
    """
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    slots, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = next((r for r in range(length, size) if rooms[r]), None)
            if room is None:
                # As many new sequences as hold all that is left; each takes one piece here, the next turns fill them.
                begin, n, room = opened, -(-left // (size // length)), size
                opened += n
            else:
                begin, end = rooms[room].pop()
                n = min(left, end - begin)
                if begin + n < end:
                    rooms[room].append((begin + n, end))
            slots.append((length, rank, rank + n, begin, size - room))
            if room - length:
                rooms[room - length].append((begin, begin + n))
            rank, left = rank + n, left - n
    return slots


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces (doc_id, piece, length, ...), a written table, with sequence_id and offset.

    Pieces of one length rank by bucket of (doc_id, piece), then by all their columns; equal rows are interchangeable.
    Null ids count as a value. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `size` rows at most
    slots = np.array(sorted(plan(counts, size)), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(slots)
    plain = [f.name for f in pieces.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    order = ["doc_id", "piece", *[c for c in plain if c not in ("doc_id", "piece")]]
    dealt = ranked(pieces, ["length"], [F.col(c) for c in order], F.xxhash64("doc_id", "piece"), max(counts.values(), default=0))
    names = pieces.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema.fields)}, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        slots = shared.value
        begins = (slots[:, 0] << 48) | slots[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(begins, (length << 48) | rank, "right") - 1
            sequence = slots[at, 3] + rank - slots[at, 1]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(sequence), pa.array(slots[at, 4])], names=[*names, "sequence_id", "offset"])

    return dealt.mapInArrow(run, schema)


def packed_digests(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    pieces = token_pieces(docs, tokenizer_json, ["doc_id"])
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(materialize(pieces, "pieces"))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docspark.llm.common import table

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        source = f.read()
    return packed_digests(table(spark, sf_dir, "documents"), source)
