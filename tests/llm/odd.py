"""Documents with every odd case: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank long, key string, pos int, word string"

LINE = "The quick brown fox jumps over the lazy dog near the river."


def rows():
    texts = [
        None, "", " \n\t ", "a", "word " * 3000, LINE, LINE.upper() + "\n" + LINE, "x\n" + LINE + "  \nÉté ÉTÉ un deux trois quatre cinq six",
        "été ÉTÉ un deux trois quatre cinq six\r\nÉTÉ", "<|endoftext|> <|startoftext|> it's 1234 日本語   ½ ﬁ İ", "naïve café — “quoted” it's  two\n\n\nthree   ",
        "line one of this longer document\nline two of this longer document\n" * 40, "\x1c\x85\xa0 odd spaces ​", "İstanbul K Σίσυφος é",
    ]
    out = [(i, t, ["en", "fr", None][i % 3], [f"s{i % 4}", None][i % 5 == 4], len(t or ""), 1, 2, "k", 3, "w") for i, t in enumerate(texts)]
    out += [out[5], out[5], (5, "another text of the same id " + LINE, "en", "s1", 1, 1, 1, "k", 1, "w"), (None, LINE, "en", "s0", 1, 1, 1, "k", 1, "w"), (None, None, None, None, None, None, None, None, None, None)]
    return out


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


#: Names that operators use within, or give to what they make.
TAKEN = ["_id", "_row", "_n", "_key", "_again", "_text", "_hash", "_lines", "_measured", "_kept", "n_tokens", "lang_pred", "score", "piece", "start", "length", "ids", "n", "row_key", "component_id", "keeper", "kept_text"]


def clashing(spark):
    """documents() with a column of each of TAKEN."""
    from pyspark.sql import functions as F

    return documents(spark).withColumns({c: F.lit(c) for c in TAKEN})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
