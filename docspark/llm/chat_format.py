"""Chat formatting by columnar byte assembly.

A conversation's turns become one string: `<turn>` role, line feed, text, `</turn>` line feed. In roles and texts a
backslash becomes two and `<` becomes backslash l; in roles a line feed becomes backslash n. So `<` stands only in
control strings, and unescaping gives back every role and text. All rows of an Arrow batch are assembled at once: the
length of each segment, running offsets, and the place of each byte are computed in numpy, and headers, contents and
ends are copied into one preallocated buffer.

Turns are ordered by (turn, role, text), nulls first; null roles and texts are empty; rows of a null conv_id are one
conversation; repeated rows are turns of their own. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.textbytes import buffers, lead_mask

OPEN, MIDDLE, CLOSE = b"<turn>", b"\n", b"</turn>\n"
SCHEMA = "conv_id long, formatted string, loss_spans array<struct<begin:long,end:long>>"
#: Bytes of text that are assembled at once.
TOGETHER = 16_000_000
_SLASH, _LESS, _FEED = 92, 60, 10


def _escaped(data: np.ndarray, offsets: np.ndarray, feeds: bool) -> tuple[np.ndarray, np.ndarray]:
    """The column with its special bytes written as two, and its offsets."""
    special = (data == _SLASH) | (data == _LESS) | (feeds & (data == _FEED))
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(special, out=before[1:])
    out = np.empty(len(data) + before[-1], np.uint8)
    place = np.arange(len(data)) + before[:-1]
    out[place] = np.where(special, np.uint8(_SLASH), data)
    at = np.flatnonzero(special)
    out[place[at] + 1] = np.select([data[at] == _SLASH, data[at] == _LESS], [np.uint8(_SLASH), np.uint8(ord("l"))], np.uint8(ord("n")))
    return out, offsets + before[offsets]


def _scatter(out: np.ndarray, data: np.ndarray, offsets: np.ndarray, to: np.ndarray) -> None:
    """Copy each row of a column to its place."""
    lengths = np.diff(offsets)
    out[np.arange(len(data)) + np.repeat(to - offsets[:-1], lengths)] = data


def assemble(roles: pa.Array, texts: pa.Array, firsts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The conversations' strings, and the byte spans of assistant texts within each; firsts: the first row of each conversation."""
    n = len(roles)
    raw, raw_offsets = buffers(roles)
    role, role_offsets = _escaped(raw, raw_offsets, True)
    text, text_offsets = _escaped(*buffers(texts), False)
    role_len, text_len = np.diff(role_offsets), np.diff(text_offsets)
    begins = np.zeros(n + 1, np.int64)
    np.cumsum(role_len + text_len + len(OPEN) + len(MIDDLE) + len(CLOSE), out=begins[1:])
    out = np.empty(begins[-1], np.uint8)
    at = begins[:-1]
    for fixed, place in ((OPEN, at), (MIDDLE, at + len(OPEN) + role_len), (CLOSE, begins[1:] - len(CLOSE))):
        out[(place[:, None] + np.arange(len(fixed))).ravel()] = np.tile(np.frombuffer(fixed, np.uint8), n)
    _scatter(out, role, role_offsets, at + len(OPEN))
    to = at + len(OPEN) + role_len + len(MIDDLE)
    _scatter(out, text, text_offsets, to)
    edges = np.r_[begins[firsts], begins[-1]]
    formatted = pa.LargeStringArray.from_buffers(len(firsts), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
    by = np.flatnonzero(np.array([r == "assistant" for r in roles.to_pylist()], bool))
    conversation = np.searchsorted(firsts, by, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(to[by] - edges[conversation]), pa.array(to[by] + text_len[by] - edges[conversation])], names=["begin", "end"])
    return formatted, pa.ListArray.from_arrays(pa.array(np.searchsorted(conversation, np.arange(len(firsts) + 1)), pa.int32()), spans)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of each conversation of (conv_id, turn, role, text).

    loss_spans holds the byte spans of assistant texts in the UTF-8 of `formatted`.
    """
    sorted_turns = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "formatted", "loss_spans"]
        held = None  # rows of the last conversation so far, which may go on in the next batch

        def made(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            conv, role, text = (table.column(c).combine_chunks() for c in ("conv_id", "role", "text"))
            number = conv.fill_null(0).to_numpy() if conv.null_count else conv.to_numpy()
            null = np.asarray(conv.is_null())
            firsts = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (null[1:] != null[:-1])])
            formatted, spans = assemble(role, text, firsts)
            return pa.RecordBatch.from_arrays([conv.take(pa.array(firsts)).cast(pa.int64()), formatted, spans], names=names)

        def parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """made() of runs of whole conversations of about TOGETHER bytes of text: the index arrays are some 20 times as large."""
            conv = table.column("conv_id").combine_chunks()
            number, null = (conv.fill_null(0).to_numpy() if conv.null_count else conv.to_numpy()), np.asarray(conv.is_null())
            begins = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (null[1:] != null[:-1])])
            size = np.r_[0, np.cumsum(pa.compute.fill_null(pa.compute.binary_length(table.column("text")), 0).to_numpy())]
            at = 0
            while at < len(begins):
                end = max(at + 1, int(np.searchsorted(size[begins], size[begins[at]] + TOGETHER, "right")) - 1)
                stop = begins[end] if end < len(begins) else table.num_rows
                yield made(table.slice(begins[at], stop - begins[at]))
                at = end

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            conv = rows.column("conv_id").combine_chunks()
            last = conv[len(conv) - 1].as_py()
            same = np.asarray(conv.is_null() if last is None else pa.compute.fill_null(pa.compute.equal(conv, last), False))
            cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from parts(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield from parts(held)

    return sorted_turns.mapInArrow(run, SCHEMA)


def unescape(text: str) -> str:
    parts = text.split("\\\\")
    return "\\".join([p.replace("\\l", "<").replace("\\n", "\n") for p in parts])


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, from the string alone."""
    turns = formatted.split(CLOSE.decode())[:-1]
    pairs = [t.removeprefix(OPEN.decode()).split(MIDDLE.decode(), 1) for t in turns]
    return [(unescape(role), unescape(text)) for role, text in pairs]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted strings and loss masks hold, parsed from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                digest = hashlib.sha256()
                turns = parse(text)
                for role, said in turns:
                    digest.update(f"{role}\n{said}\n".encode())
                data = text.encode()
                loss = "".join(unescape(data[s["begin"] : s["end"]].decode()) for s in spans)
                out.append((conv_id, len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    from docspark.llm.common import table

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return read_back(format_conversations(turns.unionByName(extra)))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(15 + length(replace(replace(replace(role, '\', '\\'), '<', '\l'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<', '\l')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
