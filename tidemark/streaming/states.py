"""Streams: carried smoothing states, daily realised variance under a watermark, and idempotent writes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.panel import keep_last
from ..operators.recursion import smooth
from ..operators.store import Store

_OUT = "entity_id string, at long, price double, r double, state double, k long"
#: Ticks of an entity that are held together (microseconds of their times), rows of a frame that goes back to Spark, and ticks that are gathered before they are held. Fixed values.
_SPAN, _FRAME, _GATHERED = 3_600_000_000, 1 << 16, 1 << 20
Carried = tuple[float | None, float | None, int | None, int]


def _sorted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    at, price = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((price, at))
    return at[order], price[order]


def _advance(entity: Any, at: np.ndarray, price: np.ndarray, carried: Carried, gate: float) -> tuple[pd.DataFrame, Carried]:
    """The rows of at least one tick in order, and what is carried behind them: variance, last log price, last time, number of ticks."""
    v, last, _, k = carried
    logs = np.log(price)
    r = np.diff(logs, prepend=np.nan if last is None else last)
    state, squares = np.full(len(r), np.nan), r * r
    first = 1 if last is None else 0
    if v is None and first < len(r):
        state[first] = v = float(squares[first])
        first += 1
    if first < len(r):
        state[first:] = smooth(squares[first:], gate, v)
        v = float(state[-1])
    rows = pd.DataFrame({"entity_id": entity, "at": at, "price": price, "r": r, "state": state, "k": np.arange(k + 1, k + 1 + len(r))})
    return rows, (v, float(logs[-1]), int(at[-1]), k + len(r))


def _ticks(ticks: DataFrame) -> DataFrame:
    """Those with a price, and their times in microseconds."""
    return ticks.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).filter("at is not null and price > 0 and not isnan(price)")


def _told(out: DataFrame) -> DataFrame:
    """Times as such, and null where an entity's first tick has no return or its state no value yet."""
    return out.select("entity_id", F.timestamp_micros("at").alias("ts"), "price", *(F.when(F.col("k") > 1, F.col(c)).alias(c) for c in ("r", "state")), "k")


def smoothed(ticks: DataFrame, gate: float = 0.06) -> DataFrame:
    """For each tick of ``ticks(entity_id, ts, price)`` its return, the smoothed variance, carried across batches, and ``k``, its number among the entity's ticks.

    The state of an entity is its variance, last log price, last time and number of ticks. A batch's ticks are taken by time, ties by price; ticks of one time all count. Ticks
    earlier than the last time cannot be taken back into a recursion and are left out.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carried = state.get if state.exists else (None, None, None, 0)
        at, price = _sorted([(b["at"].to_numpy(np.int64), b["price"].to_numpy(float)) for b in batches])
        begin = 0 if carried[2] is None else int(np.searchsorted(at, carried[2]))
        for i in range(begin, len(at), _FRAME):
            rows, carried = _advance(key[0], at[i : i + _FRAME], price[i : i + _FRAME], carried, gate)
            yield rows
        state.update(carried)

    grouped = _ticks(ticks).select("entity_id", "at", "price").groupBy("entity_id")
    return _told(grouped.applyInPandasWithState(step, _OUT, "v double, last double, seen long, k long", "append", GroupStateTimeout.NoTimeout))


class _InOrder(StatefulProcessor):
    """The recursion of one entity over ticks in the order of their times.

    Ticks wait until the watermark has passed them, in a map by the hour of their times, several parts an hour, each part the bytes of two arrays: what comes is
    written once, what is due is read an hour at a time, and only the hour that the watermark lies in is written again.
    """

    def __init__(self, gate: float, forget_ms: int | None):
        self.gate, self.forget_ms = gate, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", "v double, last double, until long, k long")
        self.parts = handle.getValueState("parts", "n long")
        self.held = handle.getMapState("held", "span long, part long", "ticks binary")

    def _hold(self, fresh: list[tuple[np.ndarray, np.ndarray]]) -> None:
        at, price = _sorted(fresh)
        if not len(at):
            return
        n = (self.parts.get() or (0,))[0]
        edges = np.flatnonzero(np.diff(at // _SPAN, prepend=at[0] // _SPAN - 1))
        for a, b in zip(edges, [*edges[1:], len(at)], strict=True):
            self.held.updateValue((int(at[a]) // _SPAN, n), (at[a:b].tobytes() + price[a:b].tobytes(),))
        self.parts.update((n + 1,))

    def _read(self, span: int, part: int) -> tuple[np.ndarray, np.ndarray]:
        data = bytes(self.held.getValue((span, part))[0])
        return np.frombuffer(data, np.int64, len(data) // 16), np.frombuffer(data, float, offset=len(data) // 2)

    def _release(self, entity: Any, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Run over what the watermark has passed, keep the rest, and ask for a call when it passes what is next, or when the entity has been silent for long."""
        edge, known = watermark_ms * 1000, self.carried.get()
        carried, spans, nearest = known or (None, None, None, 0), defaultdict(list), None
        for span, part in list(self.held.keys()):
            spans[span].append(part)
        for span in sorted(spans):
            if span * _SPAN > edge:
                nearest = span * _SPAN
                break
            at, price = _sorted([self._read(span, part) for part in spans[span]])
            due = int(np.searchsorted(at, edge, "right"))
            if due:
                for part in spans[span]:
                    self.held.removeKey((span, part))
                if due < len(at):
                    self._hold([(at[due:], price[due:])])
            for i in range(0, due, _FRAME):
                to = min(i + _FRAME, due)
                rows, carried = _advance(entity, at[i:to], price[i:to], carried, self.gate)
                yield rows
            if due < len(at):
                nearest = int(at[due])
                break
        if carried != (known or (None, None, None, 0)):
            self.carried.update(carried)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        if nearest is not None:
            self.handle.registerTimer(max(-(-nearest // 1000), watermark_ms + 1))
        elif carried[2] is not None and self.forget_ms is not None:
            self.handle.registerTimer(carried[2] // 1000 + self.forget_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh, until = [], (self.carried.get() or (None, None, None, 0))[2]
        for batch in rows:
            at, price = batch["at"].to_numpy(np.int64), batch["price"].to_numpy(float)
            fresh.append((at, price) if until is None else (at[at > until], price[at > until]))
            if sum(len(a) for a, _ in fresh) >= _GATHERED:
                self._hold(fresh)
                fresh = []
        if fresh:
            self._hold(fresh)
        yield from self._release(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark, known, made = timerValues.getCurrentWatermarkInMs(), self.carried.get(), False
        for rows in self._release(key[0], watermark):
            made = True
            yield rows
        if not made and self.forget_ms is not None and known and not self.held.exists() and known[2] // 1000 + self.forget_ms <= watermark:
            self.carried.clear()
            self.parts.clear()
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t if isinstance(t, int) else t[0])

    def close(self) -> None:
        pass


def rocks_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their states in RocksDB, as ``smoothed_in_order`` needs."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def smoothed_in_order(ticks: DataFrame, gate: float = 0.06, late: str = "1 hour", forget: str | None = None) -> DataFrame:
    """``smoothed`` for ticks in any order within ``late``: for every tick of ``ticks(entity_id, ts, price)`` that the watermark has passed, what one batch of all in order gives.

    Ticks wait by hours of their entity until then, ties by price; an event-time timer calls when the watermark passes the next one, so that an
    entity without new ticks is not stuck. Ticks behind the watermark are Spark's to drop; prices that are null or not positive are left out. An entity that is silent
    for ``forget`` is forgotten and begins anew, and so does its ``k``. The stream must run in a session of ``rocks_session``; rows come in no order.
    """
    rows = _ticks(ticks.withWatermark("ts", late)).select("entity_id", "ts", "at", "price")
    forget_ms = None if forget is None else int(pd.Timedelta(forget).total_seconds() * 1000)
    return _told(rows.groupBy("entity_id").transformWithStateInPandas(_InOrder(gate, forget_ms), _OUT, "Append", "EventTime"))


def daily_variance(returns: DataFrame, late: str = "1 hour") -> DataFrame:
    """(entity_id, day, rv, n) of ``returns(entity_id, ts, r)``: days close when the watermark passes them."""
    day = F.window("ts", "1 day")
    out = returns.withWatermark("ts", late).groupBy("entity_id", day.alias("w")).agg(F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0)).alias("rv"), F.count("*").alias("n"))
    return out.select("entity_id", F.to_date("w.start").alias("day"), "rv", "n")


def upsert_stream(rows: DataFrame, store: Store, table: str, checkpoint: str):
    """Each micro-batch appended to the store, where the last row of a key counts (of one batch, that of the latest ``seen_utc``, if there is one); a batch that runs twice changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        if "seen_utc" in batch.columns:
            keys = [c for c in ("model_id", "ticker", "asof_utc", "target_utc", "horizon") if c in batch.columns]
            batch = keep_last(batch, keys, "seen_utc").drop("seen_utc")
        (store.upsert_forecasts if table == "forecasts" else store.upsert_actuals)(batch)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
