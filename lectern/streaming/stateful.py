"""The same streams with state of their own by key: folds, debounce, newest wins and entries that expire, one micro-batch after another.

Each function takes a streaming DataFrame with an event-time column and gives one; they need the state store of prepare(). A row
later than ``late`` behind the newest is dropped by the watermark. Whatever the order and the number of repeats in which rows within it come,
the result is that of the batch function named with it. State is kept by key and goes with its timer, so it is bounded by the keys
that are active within ``late`` and the function's own span; a query that is lost goes on from its checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "10 minutes"
#: Seconds of life that an entry must have left to be used (fixed value).
MINIMUM_TTL = 120
#: The first of all times, for streams that haven't closed anything yet.
NEVER = -(2**62)


def prepare(spark: SparkSession) -> None:
    """Choose the state store that these functions need; to be called before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _micros(at) -> int:
    return pd.Timestamp(at).value // 1000


def _frame(columns: list[str], rows: list[tuple]) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(columns)})


class _ByKey(StatefulProcessor):
    """A processor whose whole state is one JSON value a key; subclasses say what comes of new rows, and of a timer."""

    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")

    def load(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {}

    def store(self, state: dict, wake: int | None) -> None:
        """Keep the state, and be woken at a time in milliseconds; without one the key is forgotten."""
        before = state.pop("wake", None)
        if before is not None and before != wake:
            self.handle.deleteTimer(before)
        if wake is None:
            self.state.clear()
            return
        if before != wake:
            self.handle.registerTimer(wake)
        self.state.update((json.dumps({**state, "wake": wake}),))

    def close(self) -> None:
        pass


def _rows(frames: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    return [tuple(None if pd.isna(x) else x for x in r) for f in frames for r in f[columns].itertuples(index=False, name=None)]


def _run(rows: DataFrame, key: str, at: str, late: str, processor: _ByKey, schema: str, mode: str = "append") -> DataFrame:
    marked = rows.withWatermark(at, late)
    return marked.groupBy(key).transformWithStateInPandas(processor, StructType.fromDDL(schema), mode, "eventTime")


# Folds of server-sent lines


class _Fold(_ByKey):
    """Pieces by their number; what a stream says once it has ended, or been idle."""

    columns = ["stream", "text", "failed", "ended"]

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.load()
        state.setdefault("pieces", {})
        last = state.get("last", NEVER)
        for n, line, at in _rows(rows, ["n", "line", "at"]):
            last = max(last, _micros(at))
            state["pieces"].setdefault(str(n), line)
        state["last"] = last
        self.store(state, last // 1000 + self.idle_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.load()
        lines = [state["pieces"][n] for n in sorted(state["pieces"], key=int)]
        self.store({"wake": None}, None)
        yield from _frame(self.columns, [(key[0], *fold_lines(lines))])


def _event(line: str | None) -> dict | str | None:
    """The JSON of a server-sent line, "[DONE]" for the end mark, null for anything else."""
    line = (line or "").strip()
    if not line.startswith("data:"):
        return None
    body = line[5:].strip()
    if body == "[DONE]":
        return body
    try:
        found = json.loads(body)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def fold_lines(lines: list[str | None]) -> tuple[str, bool, bool]:
    """(text, failed, ended) of a stream's lines in order, in either of the two forms: chat deltas, or typed events whose done text wins."""
    out, done, failed, ended = [], None, False, False
    for event in map(_event, lines):
        if event == "[DONE]":
            ended = True
        elif event:
            kind = event.get("type") or ""
            delta = event.get("delta")
            if kind.endswith("delta"):
                out.append(delta if isinstance(delta, str) else "")
            elif kind.endswith("done"):
                done, ended = done if done is not None else event.get("text") or "", True
            elif kind.endswith("failed"):
                failed = ended = True
            else:
                choices = event.get("choices")
                first = choices[0] if isinstance(choices, list) and choices and isinstance(choices[0], dict) else {}
                content = (first.get("delta") or {}).get("content") if isinstance(first.get("delta"), dict) else None
                out.append(content if isinstance(content, str) else "")
    return (done if done is not None else "".join(out)).strip(), failed, ended


def fold_stream(lines: DataFrame, late: str = LATE, idle_seconds: int = 60) -> DataFrame:
    """(stream, text, failed, ended) of lines(stream, n, line, at): one row a stream, after it has had no line for a while.

    Lines are put in the order of their numbers, a number that comes again is not read again. ``ended`` tells whether an end mark came. The batch
    functions are events.fold_chat and events.fold_responses.
    """
    return _run(lines.select("stream", F.col("n").cast("long").alias("n"), "line", "at"), "stream", "at", late, _Fold(idle_seconds * 1000), "stream string, text string, failed boolean, ended boolean")


# Debounce


def _sessions(held: list[list], gap: int, upto: int) -> tuple[list[tuple[int, str]], list[list]]:
    """What is painted by ``upto`` from updates [at, value, final] in order, and the updates that wait still."""
    out, waiting = [], []
    for i, (at, value, final) in enumerate(held):
        waiting.append([at, value, final])
        after = held[i + 1][0] if i + 1 < len(held) else None
        if final:
            out.append((at, value))
            waiting = []
        elif (after is not None and after - at >= gap and at + gap <= upto) or (after is None and at + gap <= upto):
            out.append((at + gap, value))
            waiting = []
        elif after is not None and after - at >= gap:
            # what stands before an open gap can still change; it and all after it wait
            return out, waiting + held[i + 1 :]
    return out, waiting


class _Debounce(_ByKey):
    columns = ["key", "at", "value"]

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.load()
        held = {tuple(x) for x in state.get("held", [])}
        closed = state.get("closed", NEVER)
        # what comes after a final one that it stands before has been said already
        held |= {(_micros(at), value, bool(final)) for at, value, final in _rows(rows, ["at", "value", "final"]) if _micros(at) > closed}
        # a final update is painted at once, with all before it
        ends = [at for at, _, final in held if final]
        now, self_held = [], sorted(held, key=lambda x: (x[0], x[2], x[1] or ""))
        if ends:
            last = max(ends)
            now, _ = _sessions([list(x) for x in self_held if x[0] <= last], self.gap_ms * 1000, last)
            self_held, state["closed"] = [x for x in self_held if x[0] > last], last
        state["held"] = [list(x) for x in self_held]
        self.wait(state, timerValues)
        yield from _frame(self.columns, [(key[0], pd.Timestamp(at, unit="us"), value) for at, value in now])

    def wait(self, state: dict, timerValues) -> None:
        # woken when the first of the open sessions may close, or to forget what was closed
        first = min((x[0] for x in state["held"]), default=None)
        if first is not None:
            self.store(state, max(first // 1000 + self.gap_ms + 1, timerValues.getCurrentWatermarkInMs() + 1))
        elif state.get("closed", NEVER) > NEVER:
            self.store(state, max(state["closed"] // 1000 + self.gap_ms, timerValues.getCurrentWatermarkInMs()) + 1)
        else:
            self.store(state, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.load()
        state["wake"] = None
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        now, held = _sessions(state.get("held", []), self.gap_ms * 1000, upto)
        if not state.get("held"):
            self.state.clear()
            return
        state["held"] = held
        self.wait(state, timerValues)
        yield from _frame(self.columns, [(key[0], pd.Timestamp(at, unit="us"), value) for at, value in now])


def debounce_stream(updates: DataFrame, gap_ms: int, late: str = LATE) -> DataFrame:
    """(key, at, value) of updates(key, at, value, final): the last of updates less than a gap apart, a gap after it; a final one at once, with it all before it.

    The batch function is debounce_final; repeated updates are one. An update that comes after a final one it stands before is left out.
    """
    if gap_ms < 1:
        raise ValueError("gap_ms: 1 or more")
    return _run(updates.select("key", "at", "value", "final"), "key", "at", late, _Debounce(gap_ms), "key string, at timestamp, value string")


def debounce_final(updates: DataFrame, gap_ms: int) -> DataFrame:
    """debounce_stream's result for a table of updates. Null values are values; of updates of one time the final one, then the greatest value counts."""
    order = W.partitionBy("key").orderBy("at", F.coalesce("final", F.lit(False)), F.coalesce("value", F.lit("")))
    final = F.coalesce("final", F.lit(False))
    apart = F.unix_micros(F.lead("at").over(order)) - F.unix_micros("at") >= gap_ms * 1000
    last = updates.distinct().withColumn("__last", final | F.coalesce(apart, F.lit(True))).filter("__last")
    painted = F.when(final, F.col("at")).otherwise(F.timestamp_micros(F.unix_micros("at") + gap_ms * 1000))
    return last.select("key", painted.alias("at"), "value")


# Newest wins, and entries that expire


class _Newest(_ByKey):
    columns = ["key", "n", "value"]

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.load()
        best, last = state.get("best"), state.get("last", NEVER)
        before = best
        for n, value, at in _rows(rows, ["n", "value", "at"]):
            last = max(last, _micros(at))
            if n is not None and (best is None or (n, value or "") > (best[0], best[1] or "")):
                best = [int(n), value]
        state |= {"best": best, "last": last}
        self.store(state, last // 1000 + self.keep_ms)
        if best is not None and best != before:
            yield from _frame(self.columns, [(key[0], best[0], best[1])])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()


def newest_stream(writes: DataFrame, late: str = LATE, keep_seconds: int = 3600) -> DataFrame:
    """(key, n, value) of writes(key, n, value, at): what each micro-batch lets through, only ever a write of a higher number than all before it.

    A key is forgotten after keep_seconds without a write. The last row of a key is that of the batch function events.newest; of equal
    numbers the greater value counts.
    """
    return _run(writes.select("key", F.col("n").cast("long").alias("n"), "value", "at"), "key", "at", late, _Newest(keep_seconds * 1000), "key string, n long, value string", "update")


class _Expiring(_ByKey):
    columns = ["key", "value", "put", "ended", "replaced"]

    def __init__(self, minimum: int):
        self.minimum = minimum

    def settle(self, key, state: dict, timerValues, upto: int) -> Iterator[pd.DataFrame]:
        """What has ended by ``upto``: an entry ends when it has no more than the minimum to live, or when the next one is put."""
        puts, out = sorted(map(tuple, state.get("puts", [])), key=lambda x: (x[0], x[1] or "")), []
        while puts:
            at, value, expires = puts[0]
            dies = None if expires is None else max(at, expires - self.minimum * 1_000_000)
            after = puts[1][0] if len(puts) > 1 else None
            end = min((x for x in (dies, after) if x is not None), default=None)
            if end is None or end > upto:
                break
            out.append((key[0], value, pd.Timestamp(at, unit="us"), pd.Timestamp(end, unit="us"), after is not None and end == after and (dies is None or after < dies)))
            puts.pop(0)
        state["puts"] = [list(x) for x in puts]
        ends = [e for i, (at, _, x) in enumerate(puts) for e in ([max(at, x - self.minimum * 1_000_000)] if x is not None else []) + ([puts[i + 1][0]] if i + 1 < len(puts) else [])]
        # one that never ends waits until it is replaced
        wake = max(min(ends) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1) if ends else 2**52
        self.store(state, wake if puts else None)
        yield from _frame(self.columns, out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.load()
        puts = {tuple(x) for x in state.get("puts", [])}
        puts |= {(_micros(at), value, None if expires is None else _micros(expires)) for at, value, expires in _rows(rows, ["at", "value", "expires"])}
        state["puts"] = list(puts)
        return self.settle(key, state, timerValues, NEVER)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.load()
        state["wake"] = None
        return self.settle(key, state, timerValues, timerValues.getCurrentWatermarkInMs() * 1000)


def expire_stream(entries: DataFrame, late: str = LATE, minimum: int = MINIMUM_TTL) -> DataFrame:
    """(key, value, put, ended, replaced) of entries(key, value, expires, at): when each entry could be used no longer, by age or since another took its place.

    An entry without an end is used until it is replaced. The batch function is expire_table.
    """
    return _run(entries.select("key", "value", "expires", "at"), "key", "at", late, _Expiring(minimum), "key string, value string, put timestamp, ended timestamp, replaced boolean")


def expire_table(entries: DataFrame, minimum: int = MINIMUM_TTL) -> DataFrame:
    """expire_stream's result for a table of entries(key, value, expires, at), those that are in use in the end left out; repeated entries are one."""
    order = W.partitionBy("key").orderBy("at", F.coalesce("value", F.lit("")))
    after, dies = F.lead("at").over(order), F.greatest(F.col("at"), F.timestamp_micros(F.unix_micros("expires") - minimum * 1_000_000))
    rows = entries.distinct().withColumns({"after": after, "dies": F.when(F.col("expires").isNotNull(), dies)})
    rows = rows.withColumn("ended", F.least("after", "dies")).filter("ended is not null")
    return rows.select("key", "value", F.col("at").alias("put"), "ended", F.coalesce((F.col("after") == F.col("ended")) & (F.col("dies").isNull() | (F.col("after") < F.col("dies"))), F.lit(False)).alias("replaced"))
