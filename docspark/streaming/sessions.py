"""Claim batches of live sessions: one rule, replayed over finished sessions and kept as state in streams.

A tick each second fires a batch if there are unchecked segments and either the last one ended IDLE seconds ago, or
INTERVAL seconds have passed since the last batch and the unchecked texts have CHARS characters. Time is event time:
a segment arrives when it ends. In a stream, a session's state ends with its expiry, which sends what is left.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import MapState

from docspark.functions import text as T
from docspark.operators.claims import DUPLICATE
from docspark.sources.shared import written

IDLE, INTERVAL, CHARS, CAP, CONTEXT = 2.0, 6.0, 20, 100, 10
#: A session that is silent for so long has ended.
EXPIRE_MS = 4 * 3600 * 1000
#: After a silence of so many seconds nothing of a session but counts matters to what comes.
PAUSE = IDLE + INTERVAL + 2
SCHEMA = "session_id long, batch int, fired_at double, first_segment int, last_segment int, n_segments int, n_context int"
STATE = "state string"


class Buffer:
    """A session's state: unchecked segments as (index, arrival, characters), when it last checked and heard, and counts."""

    def __init__(self, saved: str | None = None):
        s = json.loads(saved) if saved else {}
        self.unchecked = [tuple(x) for x in s.get("unchecked", [])]
        self.checked, self.batch = s.get("checked", 0.0), s.get("batch", 0)
        self.before = s.get("before", 0)  # checked segments still in the buffer

    def save(self) -> str:
        return json.dumps({"unchecked": self.unchecked, "checked": self.checked, "batch": self.batch, "before": self.before})

    def due(self, t: float) -> bool:
        if not self.unchecked:
            return False
        if t - self.unchecked[-1][1] >= IDLE:
            return True
        return t - self.checked >= INTERVAL and sum(x[2] for x in self.unchecked) >= CHARS

    def fire(self, t: float) -> tuple:
        n = len(self.unchecked)
        row = (self.batch, t, self.unchecked[0][0], self.unchecked[-1][0], n, min(CONTEXT, self.before))
        self.before = min(CAP, self.before + n)
        self.unchecked, self.checked, self.batch = [], t, self.batch + 1
        return row

    def tick_to(self, until: float) -> Iterator[tuple]:
        """Fires of the ticks after the last segment and before `until`; once idle, later ticks have nothing to do."""
        while self.unchecked:
            begin = max(math.floor(self.unchecked[-1][1]), math.floor(self.checked))
            last = math.ceil(self.unchecked[-1][1] + IDLE)
            t = next((t for t in range(begin, last + 1) if t >= self.unchecked[-1][1] and t > self.checked and self.due(t)), None)
            if t is None or t >= until:
                return
            yield self.fire(float(t))

    def add(self, index: int, arrival: float, chars: int) -> Iterator[tuple]:
        yield from self.tick_to(arrival)
        self.append(index, arrival, chars)

    def append(self, index: int, arrival: float, chars: int) -> None:
        self.unchecked.append((int(index), float(arrival), int(chars)))
        excess = len(self.unchecked) + self.before - CAP
        if excess > 0:
            dropped = min(excess, self.before)
            self.before -= dropped
            self.unchecked = self.unchecked[excess - dropped :]


def _frame(session_id: int, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(session_id, *r) for r in rows], columns=["session_id", "batch", "fired_at", "first_segment", "last_segment", "n_segments", "n_context"])


class Piece(Buffer):
    """A Buffer that doesn't know how many checked segments it began with: that number is min(most, it + shift) by now."""

    def __init__(self):
        super().__init__()
        self.most, self.shift = CAP, 0

    def append(self, index: int, arrival: float, chars: int) -> None:
        super().append(index, arrival, chars)
        self.most = min(self.most, max(0, CAP - len(self.unchecked)))

    def fire(self, t: float) -> tuple:
        row = (*super().fire(t)[:5], self.most, self.shift)
        self.before, self.most, self.shift = 0, min(CAP, self.most + row[4]), self.shift + row[4]
        return row


_PIECES = "session_id long, piece long, batch int, fired_at double, first_segment int, last_segment int, n_segments int, most int, shift int"


def claim_batches(segments: DataFrame, pause: float = PAUSE) -> DataFrame:
    """Batches of finished sessions (session_id, segment_index, end_s, text), as the live rule would have cut them.

    After a silence of `pause` all has been checked, and so long ago that the rule asks no more when: sessions are cut
    there, and pieces are replayed each by itself. What they hand on is how many batches there were and how many checked
    segments the buffer still has; each piece turns the latter into min(most, it + shift), so sums and minima over the
    pieces of a session, in order, give both. A session without a pause is one piece.
    """
    order = Window.partitionBy("session_id").orderBy("segment_index")
    heard = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce(F.col("end_s") - heard >= pause, F.lit(False)).cast("long")
    pieces = segments.select("session_id", "segment_index", "end_s", "text", cut.alias("cut"))
    pieces = pieces.withColumn("piece", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("cut")

    names = [f.split()[0] for f in _PIECES.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[f.split()[1]] for f in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole pieces one after another; one may go on in the next batch. Most are short, so none has a frame of its own."""
        key, buffer, rows = None, Piece(), []
        told = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)
        for batch in batches:
            for session, piece, i, end, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (session, piece) != key:
                    rows += [(*key, *r) for r in buffer.tick_to(math.inf)] if key else []
                    key, buffer = (session, piece), Piece()
                    if piece:  # the last check was before this, or at the latest then
                        buffer.checked = end - pause + IDLE + 1
                rows += [(*key, *r) for r in buffer.add(i, end, chars)]
            yield told()
            rows.clear()
        rows += [(*key, *r) for r in buffer.tick_to(math.inf)] if key else []
        yield told()

    dealt = pieces.select("session_id", "piece", "segment_index", "end_s", F.char_length("text").alias("n_chars")).repartition("session_id", "piece")
    fires = written(dealt.sortWithinPartitions("session_id", "piece", "segment_index").mapInArrow(run, _PIECES), "claim-pieces")
    last = F.struct("batch", "most", "shift", "n_segments")
    ends = fires.groupBy("session_id", "piece").agg(F.count("*").alias("n"), F.max(last).alias("last"))
    ends = ends.select("session_id", "piece", "n", F.least(F.lit(CAP), F.col("last.most") + F.col("last.n_segments")).alias("most"), (F.col("last.shift") + F.col("last.n_segments")).alias("shift"))
    by_piece = Window.partitionBy("session_id").orderBy("piece")
    before = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("upto", F.sum("shift").over(by_piece.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.select(
        F.col("session_id").alias("_session"), F.col("piece").alias("_piece"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_batches"),
        (F.col("upto") - F.col("shift") + F.least(F.lit(0), F.coalesce(F.min(F.col("most") - F.col("upto")).over(before), F.lit(0)))).alias("_begin"),
    )
    rows = fires.join(ends, fires["session_id"].eqNullSafe(F.col("_session")) & (fires["piece"] == F.col("_piece")))
    kept = F.least(F.lit(CONTEXT), F.col("most"), F.col("_begin") + F.col("shift")).cast("int")
    return rows.select("session_id", (F.col("batch") + F.col("_batches")).cast("int").alias("batch"), "fired_at", "first_segment", "last_segment", "n_segments", kept.alias("n_context"))


def stream_claim_batches(segments: DataFrame, expire_ms: int | None = EXPIRE_MS) -> DataFrame:
    """The same over a stream of final segments. A row whose text is null ends its session: what is left goes out, and the state goes.

    A session that is silent for expire_ms of processing time ends too; with None, only end rows end one. Expiry wakes
    the query up again and again, so a query that is to stop by itself (availableNow) takes None.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, rows = Buffer(state.get[0] if state.exists else None), []
        ended = state.hasTimedOut
        if not ended:
            joined = pd.concat(list(frames)).sort_values("segment_index")
            for i, end, text in joined[["segment_index", "end_s", "text"]].itertuples(index=False):
                if text is None:
                    ended = True
                else:
                    rows += buffer.add(i, end, len(text))
        if ended:
            rows += buffer.tick_to(math.inf)
            if state.exists:
                state.remove()
        else:
            state.update((buffer.save(),))
            if expire_ms is not None:
                state.setTimeoutDuration(expire_ms)
        yield _frame(key[0], rows)

    grouped = segments.select("session_id", "segment_index", "end_s", "text").groupBy("session_id")
    timeout = GroupStateTimeout.NoTimeout if expire_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return grouped.applyInPandasWithState(step, SCHEMA, STATE, "append", timeout)


LIVE_SCHEMA = "session_id long, batch int, fired_at double, texts array<string>, context array<string>, entities array<string>, n_repeats int"
_LIVE_NAMES = [f.split()[0] for f in LIVE_SCHEMA.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _state_in_columns(df: DataFrame) -> None:
    """State variables of a processor are column families of the state store, which the default store hasn't got."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class KeptClaims:
    """The claims of a session that were kept, as sets of words, in two maps of the state: word -> claims, claim -> set.

    Sets stand in one order, so two sets of a Jaccard similarity of `threshold` share an element among the first
    n - ceil(threshold * n) + 1 of each: a new set looks up its first ones alone, takes the claims found there whose size
    can do, and compares those. What a claim reads and writes depends on its words, not on how many claims there are.
    """

    def __init__(self, words: MapState, sets: MapState, threshold: float = DUPLICATE):
        self.words, self.sets, self.threshold = words, sets, threshold
        self.compared = 0

    def _first(self, bag: list[str]) -> list[str]:
        # Numbers, and what boosting repeats, tell claims apart: they stand first.
        order = sorted(bag, key=lambda w: ("__" not in w, not w[:1].isdigit(), w))
        return order[: len(order) - math.ceil(self.threshold * len(order) - 1e-9) + 1]

    def keep(self, bag: list[str], number: int) -> bool:
        """Whether no kept claim is similar; if so, this one is kept as `number`. Claims without a word are always kept."""
        if not bag:
            return True
        n, own, first, seen = len(bag), set(bag), self._first(bag), set()
        found = {w: self.words.getValue((w,))[0] if self.words.containsKey((w,)) else [] for w in first}
        for number_and_size in (x for w in first for x in found[w]):
            other, m = number_and_size["claim"], number_and_size["size"]
            if other in seen or min(n, m) < self.threshold * max(n, m) - 1e-9:
                continue
            seen.add(other)
            self.compared += 1
            shared = len(own.intersection(self.sets.getValue((other,))[0]))
            if shared >= self.threshold * (n + m - shared) - 1e-9:
                return False
        self.sets.updateValue((number,), (list(bag),))
        for w in first:
            self.words.updateValue((w,), ([*[(x["claim"], x["size"]) for x in found[w]], (number, n)],))
        return True


class LiveSession(StatefulProcessor):
    """A session as state variables: unchecked segments and context as lists, clocks as a value, kept claims and entities as maps.

    The lists hold CAP and CONTEXT entries at most and are rewritten; of the maps only what a trigger names is. A session
    ends with a row whose text is null, or `expire_ms` after its last row: what is unchecked goes out, and all of it goes.
    """

    def __init__(self, expire_ms: int | None):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.unchecked = handle.getListState("unchecked", "segment int, arrival double, text string, bag array<string>, entities array<string>")
        self.context = handle.getListState("context", "text string")
        self.clock = handle.getValueState("clock", "checked double, batch int, before int, claims long")
        self.words = handle.getMapState("words", "word string", "claims array<struct<claim:long,size:int>>")
        self.sets = handle.getMapState("sets", "claim long", "bag array<string>")
        self.entities = handle.getMapState("entities", "entity string", "claim long")

    def _load(self) -> tuple[Buffer, dict, list, int]:
        buffer, waiting = Buffer(), {}
        if (clock := self.clock.get()) is not None:
            buffer.checked, buffer.batch, buffer.before = clock[0], clock[1], clock[2]
        for segment, arrival, text, bag, entities in self.unchecked.get():
            buffer.unchecked.append((segment, arrival, len(text)))
            waiting[segment] = (text, list(bag or []), list(entities or []))
        return buffer, waiting, [c[0] for c in self.context.get()], clock[3] if clock is not None else 0

    def _save(self, buffer: Buffer, waiting: dict, context: list, claims: int) -> None:
        self.clock.update((buffer.checked, buffer.batch, buffer.before, claims))
        for state, rows in ((self.unchecked, [(i, at, *waiting[i]) for i, at, _ in buffer.unchecked]), (self.context, [(c,) for c in context])):
            if rows:
                state.put(rows)
            else:
                state.clear()

    def _clear(self) -> None:
        for state in (self.unchecked, self.context, self.clock, self.words, self.sets, self.entities):
            state.clear()
        self._no_timers()

    def _no_timers(self) -> None:
        if self.expire_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)

    def _told(self, fire: tuple, waiting: dict, context: list, claims: int) -> tuple[tuple, list, int]:
        """The output row of a batch, and the context and number of claims after it."""
        batch, at, first, last = fire[:4]
        said = [waiting.pop(i) for i in sorted(waiting) if first <= i <= last]
        kept, new = KeptClaims(self.words, self.sets), []
        for text, bag, entities in said:
            for e in entities:
                if not self.entities.containsKey((e,)):
                    self.entities.updateValue((e,), (claims,))
            if kept.keep(bag, claims):
                new.append(text)
            claims += 1
        named = sorted(k[0] for k in self.entities.keys())
        return (batch, at, new, context, named, len(said) - len(new)), (context + [t for t, _, _ in said])[-CONTEXT:], claims

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        buffer, waiting, context, claims = self._load()
        out, ended = [], False
        for i, end, text, bag, entities in pd.concat(list(rows)).sort_values("segment_index")[["segment_index", "end_s", "text", "bag", "entities"]].itertuples(index=False):
            fires = buffer.tick_to(math.inf) if text is None else buffer.tick_to(end)
            for fire in fires:
                row, context, claims = self._told(fire, waiting, context, claims)
                out.append(row)
            if text is None:
                ended = True
                continue
            waiting[int(i)] = (text, list(bag), list(entities))
            buffer.append(int(i), float(end), len(text))
            held = {x[0] for x in buffer.unchecked}
            waiting = {k: v for k, v in waiting.items() if k in held}
        if ended:
            self._clear()
        else:
            self._save(buffer, waiting, context, claims)
            if self.expire_ms is not None:
                self._no_timers()
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expire_ms)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=_LIVE_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        buffer, waiting, context, claims = self._load()
        out = []
        for fire in buffer.tick_to(math.inf):
            row, context, claims = self._told(fire, waiting, context, claims)
            out.append(row)
        self._clear()
        yield pd.DataFrame([(key[0], *r) for r in out], columns=_LIVE_NAMES)

    def close(self) -> None:
        pass


def stream_live_sessions(segments: DataFrame, expire_ms: int | None = EXPIRE_MS) -> DataFrame:
    """Claim batches of a stream of final segments, as stream_claim_batches cuts them, with what they say.

    texts are the batch's segments less those similar to one kept before in the session, as dedup_claims would drop them,
    n_repeats their number; context is what was said just before; entities all reference numbers named so far.
    """
    _state_in_columns(segments)
    said = segments.select(
        "session_id", "segment_index", "end_s", "text", F.coalesce(T.boosted_bag(F.col("text")), F.array().cast("array<string>")).alias("bag"),
        F.coalesce(T.extract_mentions(F.col("text"))["reference_numbers"], F.array().cast("array<string>")).alias("entities"),
    )
    return said.groupBy("session_id").transformWithStateInPandas(LiveSession(expire_ms), LIVE_SCHEMA, "append", "none" if expire_ms is None else "processingTime")


TOTALS_SCHEMA = "session_id long, segment_count long, speaker_count long, first_heard timestamp, last_heard timestamp, ended boolean"
_TOTALS_NAMES = [f.split()[0] for f in TOTALS_SCHEMA.split(", ")]


class RunningTotals(StatefulProcessor):
    """A session's totals, told again with every trigger that adds to them; `gap_ms` of event time after its last segment they are told once more, ended, and go."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n long, first timestamp, last timestamp")
        self.speakers = handle.getMapState("speakers", "speaker int", "n long")

    def _row(self, key, ended: bool) -> pd.DataFrame:
        n, first, last = self.totals.get()
        return pd.DataFrame([(key[0], n, sum(1 for _ in self.speakers.keys()), first, last, ended)], columns=_TOTALS_NAMES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        old = self.totals.get()
        first, last = frame["at"].min().to_pydatetime(), frame["at"].max().to_pydatetime()
        if old is not None:
            first, last = min(old[1], first), max(old[2], last)
        self.totals.update(((old[0] if old is not None else 0) + len(frame), first, last))
        for speaker, n in frame["speaker"].dropna().astype(int).value_counts().items():
            had = self.speakers.getValue((int(speaker),))[0] if self.speakers.containsKey((int(speaker),)) else 0
            self.speakers.updateValue((int(speaker),), (had + int(n),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(pd.Timestamp(last, tz="UTC").timestamp() * 1000) + self.gap_ms if last.tzinfo is None else int(last.timestamp() * 1000) + self.gap_ms)
        yield self._row(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, True)
        self.totals.clear()
        self.speakers.clear()

    def close(self) -> None:
        pass


def session_totals(segments: DataFrame, time: str = "ts", late: str = "10 minutes", gap_s: int = 4 * 3600) -> DataFrame:
    """Running totals of each session (session_id, speaker, `time`) of a stream, in update mode.

    A session that has no segment for `gap_s` of event time, behind a watermark of `late`, has a last row with `ended` and
    leaves the state; what comes for it later begins anew.
    """
    _state_in_columns(segments)
    timed = segments.select("session_id", F.col("speaker").cast("int").alias("speaker"), F.col(time).cast("timestamp").alias("at")).withWatermark("at", late)
    return timed.groupBy("session_id").transformWithStateInPandas(RunningTotals(1000 * gap_s), TOTALS_SCHEMA, "update", "eventTime")
