"""Token counts and token ids of whole texts, as the `tokenizers` library gives them, from counted pre-tokens.

Both tokenizers here cut a text into pre-tokens by a pattern and merge bytes within each pre-token only, so a pre-token
has the same tokens wherever it stands. Words repeat: each task keeps what it has merged in a table of bounded size.
A text with a character whose class or lower case could differ between Unicode versions, or with a special string, is
first cut into chunks at white space that no pre-token reaches across, and only the chunks that hold such go through
the library, each by itself. (Where white space makes tokens, a text with a special string goes as a whole: the library
takes what stands on either side of it as texts of their own.)
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docspark.llm.common import free

#: The pre-token patterns of the two tokenizer files.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside these have a class or a lower case that isn't as old as Unicode itself.
SURE = r"\t\n\x0b\x0c\r\x20-\x7e\xa1-įı-ɏ‐-‧‰-⁞€"
UNSURE = re.compile(f"[^{SURE}]")
#: Pre-tokens that a task remembers, and their longest; beyond the number it starts anew. About 100 bytes each.
REMEMBERED, LONGEST = 300_000, 64
_CHUNKS = re.compile(r"[^\t-\r ]+")
#: A space before a character that is surely none begins a pre-token, whatever comes before it.
_BEGINS = re.compile(" (?=[!-~\xa1-\xac\xae-\u024f])")


def sure_pattern(pattern: str) -> str:
    """A pre-token pattern for texts of SURE characters alone, its classes spelled out: the standard library cuts by it faster."""
    known = regex.findall(f"[{SURE}]", "".join(map(chr, range(0x2100))))

    def spelled(kind: str) -> str:
        runs: list[list[int]] = []
        for c in map(ord, (c for c in known if regex.match(kind, c))):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)

    letters, numbers, space = spelled(r"\p{L}"), spelled(r"\p{N}"), r"\t-\r "
    for old, new in ((r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]"), (r"[\p{L}]", f"[{letters}]"), (r"[\p{N}]", f"[{numbers}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{space}]"), (r"\S", f"[^{space}]")):
        pattern = pattern.replace(old, new)
    return pattern


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Memory(dict):
    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, piece: str):
        out = self.make(piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out


class Merger:
    """Ids of one pre-token, by the tokenizer's own merges."""

    def __init__(self, tokenizer_json: str):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def ids(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize("".join([self.letters[b] for b in piece.encode()]))]

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def unsure(self, text: str) -> bool:
        return UNSURE.search(text) is not None or any(s in text for s in self.special)


def whole_tokens(tokenizer_json: str, pattern: str = WORD_PATTERN, suffix: str = "</w>") -> frozenset[str]:
    """The vocabulary strings that, standing as a pre-token, are one token: each is tried, none assumed.

    At most as many as the vocabulary has entries, so the set can be sent to every task.
    """
    merger, cut = Merger(tokenizer_json), regex.compile(pattern)
    back = {c: b for b, c in merger.letters.items()}
    found = set()
    for entry, number in merger.tokenizer.get_vocab(with_added_tokens=False).items():
        if not entry.endswith(suffix):
            continue
        try:
            piece = bytes(back[c] for c in entry[: -len(suffix) or None]).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if piece and cut.fullmatch(piece) and merger.ids(piece) == [number]:
            found.add(piece)
    return frozenset(found)


def count_tokens(docs: DataFrame, tokenizer_json: str, columns: list[str]) -> DataFrame:
    """`columns` of docs and n_tokens of `text` under a lower-casing tokenizer with word ends; null text has none.

    Rows are independent: repeated rows, ties and columns of any name change nothing, and an empty table gives an empty one.
    If one of `columns` is called n_tokens, the new column is n_tokens_.
    """
    spark = docs.sparkSession
    # The proof runs once, here; both broadcasts are bounded by the tokenizer file.
    shared = spark.sparkContext.broadcast((tokenizer_json, whole_tokens(tokenizer_json)))
    text, made = free("_text", columns), free("n_tokens", columns)
    picked = docs.select(*columns, F.col("text").alias(text))
    schema = picked.drop(text).withColumn(made, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(*shared.value)
        for batch in batches:
            counts = [count(text) if text else 0 for text in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*columns, made])

    return picked.mapInArrow(run, schema)


def token_counter(tokenizer_json: str, whole: frozenset[str]) -> Callable[[str], int]:
    """A function from text to its number of tokens, for use within a task. White space makes no tokens and ends pre-tokens."""
    merger, cut = Merger(tokenizer_json), regex.compile(WORD_PATTERN).findall
    merged = _Memory(lambda piece: len(merger.ids(piece)))

    def sure(text: str) -> int:
        pieces = cut(text.lower())
        rest = [p for p in pieces if p not in whole]
        return len(pieces) - len(rest) + sum(map(merged.__getitem__, rest))

    def count(text: str) -> int:
        if not merger.unsure(text):
            return sure(text)
        return sum(len(merger.library(c)) if merger.unsure(c) else sure(c) for c in _CHUNKS.findall(text))

    return count


def token_ids(tokenizer_json: str) -> Callable[[str], bytes]:
    """A function from text to its ids as little-endian unsigned 32-bit numbers; for use within a task."""
    merger, cut = Merger(tokenizer_json), re.compile(sure_pattern(BYTE_PATTERN)).findall
    merged = _Memory(lambda piece: np.array(merger.ids(piece), "<u4").tobytes())

    def library(text: str) -> bytes:
        return np.array(merger.library(text), "<u4").tobytes()

    def encode(text: str) -> bytes:
        if any(s in text for s in merger.special):
            return library(text)
        if UNSURE.search(text) is None:
            return b"".join(map(merged.__getitem__, cut(text)))
        first, *rest = _BEGINS.split(text)
        return b"".join(library(c) if merger.unsure(c) else b"".join(map(merged.__getitem__, cut(c))) for c in [first, *[" " + c for c in rest]])

    return encode


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docspark.llm.common import table

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        source = f.read()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    out = count_tokens(docs, source, ["doc_id", "n_bytes"])
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)
