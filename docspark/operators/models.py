"""Model calls from tasks: tried again with growing pauses, and answers that come in pieces.

A call is a function of the task's process; what it raises is its row's matter, never the job's.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tries of an extraction, the first pause and the longest one, in seconds.
ATTEMPTS, DELAY, LONGEST = 4, 1.0, 8.0


def tries(call: Callable[[str], str | None], attempts: int = ATTEMPTS, delay: float = DELAY, longest: float = LONGEST, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[str | None, str | None, int]]:
    """The call as one that gives (answer, error, number of tries): pauses double up to `longest`; after the last try there is no answer, but its error."""

    def run(prompt: str) -> tuple[str | None, str | None, int]:
        pause = delay
        for attempt in range(1, attempts):
            try:
                return call(prompt), None, attempt
            except Exception:  # whatever a provider raises may pass
                sleep(pause)
                pause = min(2 * pause, longest)
        try:
            return call(prompt), None, attempts
        except Exception as e:
            return None, str(e)[:500], attempts

    return run


def ask(rows: DataFrame, call: Callable[[str], str | None], prompt: str = "prompt", attempts: int = ATTEMPTS, delay: float = DELAY, longest: float = LONGEST) -> DataFrame:
    """rows with answer, error and attempts of the call for each prompt; a null prompt isn't asked. Equal prompts of a batch are asked once."""
    schema = rows.withColumns({"answer": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "attempts": F.lit(0)}).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = tries(call, attempts, delay, longest)
        for frame in frames:
            known = {p: one(p) for p in frame[prompt].dropna().unique()}
            got = [known.get(p, (None, None, 0)) for p in frame[prompt]]
            yield frame.assign(answer=[a for a, _, _ in got], error=[e for _, e, _ in got], attempts=[n for _, _, n in got])

    return rows.mapInPandas(run, schema)


def pieces(rows: DataFrame, generate: Callable[[str], Iterator[str]], prompt: str = "prompt", at_once: int = 1000) -> DataFrame:
    """rows without the prompt, and position, piece and error: an answer as its generator gives it, piece by piece, in order.

    Pieces go on in batches of `at_once`, so an answer of any length is never held whole. A generator that breaks off has
    its error in a last row without a piece; one that gives nothing, and a null prompt, have no row.
    """
    keys = [c for c in rows.columns if c != prompt]
    schema = rows.select(*keys).withColumns({"position": F.lit(0), "piece": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).schema

    def told(row: dict) -> Iterator[tuple]:
        own, position = [row[k] for k in keys], 0
        try:
            for piece in generate(row[prompt]):
                yield (*own, position, piece, None)
                position += 1
        except Exception as e:  # what came before it stays
            yield (*own, position, None, str(e)[:500])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held: list[tuple] = []
            for row in frame[frame[prompt].notna()].to_dict("records"):
                for out in told(row):
                    held.append(out)
                    if len(held) >= at_once:
                        yield pd.DataFrame(held, columns=schema.names)
                        held = []
            if held:
                yield pd.DataFrame(held, columns=schema.names)

    return rows.mapInPandas(run, schema)
