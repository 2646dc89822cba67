"""Streams against the same rows in one batch."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import states


@pytest.fixture()
def ticks(spark, tmp_path):
    g = np.random.default_rng(0)
    begin = dt.datetime(2024, 1, 1)
    rows = [(e, begin + dt.timedelta(minutes=37 * i), float(100 * np.exp(g.normal(0, 0.01)))) for e in ("a", "b") for i in range(120)]
    frame = spark.createDataFrame(rows, "entity_id string, ts timestamp, price double")
    for k in range(3):
        lo, hi = begin + dt.timedelta(minutes=37 * 40 * k), begin + dt.timedelta(minutes=37 * 40 * (k + 1))
        frame.filter((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi))).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    return frame


def test_carried_state_equals_batch(spark, ticks, tmp_path):
    source = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = states.smoothed(source, 0.1).writeStream.format("memory").queryName("smoothed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.entity_id, r.ts): r.state for r in spark.table("smoothed").collect()}
    for e in ("a", "b"):
        rows = sorted((r.ts, r.price) for r in ticks.filter(F.col("entity_id") == e).collect())
        r = np.diff(np.log([p for _, p in rows]))
        v = None
        for (ts, _), x in zip(rows[1:], r, strict=True):
            v = x * x if v is None else 0.1 * x * x + 0.9 * v
            assert got[(e, ts)] == pytest.approx(v)


def test_ticks_of_one_time_all_count(spark, tmp_path):
    """Ties within a batch, by price, and with the last time of the batch before; what is earlier than that is left out."""
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    batches = [[(at(1), 5.0), (at(0), 4.0), (at(1), 5.0), (at(1), 3.0)], [(at(1), 6.0), (at(0), 9.0), (at(2), 7.0), (at(2), 0.0), (at(2), None)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame([("a", *r) for r in rows], "entity_id string, ts timestamp, price double").coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    source = spark.readStream.schema("entity_id string, ts timestamp, price double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    states.smoothed(source, 0.1).writeStream.format("memory").queryName("ties").outputMode("append").option("checkpointLocation", str(tmp_path / "cp-ties")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(spark.table("ties").collect(), key=lambda r: r.k)
    assert [(r.k, r.price) for r in got] == [(1, 4.0), (2, 3.0), (3, 5.0), (4, 5.0), (5, 6.0), (6, 7.0)] and got[0].state is None
    v = None
    for r, x in zip(got[1:], np.diff(np.log([r.price for r in got])), strict=True):
        v = x * x if v is None else 0.1 * x * x + 0.9 * v
        assert r.state == pytest.approx(v) and r.r == pytest.approx(x)


def test_days_close_behind_the_watermark(spark, ticks, tmp_path):
    source = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    returns = source.withColumn("r", F.col("price") / 100 - 1)
    q = states.daily_variance(returns).writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.entity_id, r.day): r.rv for r in ticks.withColumn("r", F.col("price") / 100 - 1).groupBy("entity_id", F.to_date("ts").alias("day")).agg(F.sum(F.col("r") * F.col("r")).alias("rv")).collect()}
    got = {(r.entity_id, r.day): r.rv for r in spark.table("daily").collect()}
    assert got and all(want[k] == pytest.approx(v) for k, v in got.items()) and len(got) >= len(want) - 2


def test_stream_into_the_store(spark, ticks, tmp_path):
    from tidemark.operators.store import Store

    source = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    rows = source.select(F.col("entity_id").alias("ticker"), F.date_trunc("day", "ts").alias("target_utc"), F.lit(1).alias("horizon"), F.col("price").alias("y"))
    states.upsert_stream(rows, store, "actuals", str(tmp_path / "cp3")).trigger(availableNow=True).start().awaitTermination()
    assert store.read("actuals").count() == ticks.select("entity_id", F.to_date("ts")).distinct().count()


def in_order(ticks, gate):
    """(entity, ts, price) -> state of one batch of all ticks in order."""
    out = {}
    for e in ("a", "b"):
        v = last = None
        for ts, price in sorted((r.ts, r.price) for r in ticks if r.entity_id == e and r.price is not None and r.price > 0):
            if last is not None:
                x = np.log(price) - last
                v = x * x if v is None else gate * x * x + (1 - gate) * v
            last = np.log(price)
            out[(e, ts, price)] = v
    return out


def run_in_order(spark, folder, schema, name, tmp_path, **options):
    own = states.rocks_session(spark)
    source = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    q = states.smoothed_in_order(source, 0.1, **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return own.table(name).collect()


def test_ticks_out_of_order_give_the_states_of_one_batch(spark, tmp_path):
    """Shuffled within two days, in six batches, with equal times and prices that are no prices: every tick that the watermark passed has the state of the whole in order."""
    g = np.random.default_rng(5)
    begin = dt.datetime(2024, 1, 1)
    rows = [(e, begin + dt.timedelta(minutes=17 * (i // 2) * 2), None if i % 41 == 7 else float(100 * np.exp(g.normal(0, 0.01)))) for e in ("a", "b") for i in range(300)]
    rows.sort(key=lambda r: r[1].timestamp() + g.uniform(0, 86400))  # late by a day at most
    frame = spark.createDataFrame(rows, "entity_id string, ts timestamp, price double")
    for k in range(6):
        part = spark.createDataFrame(rows[100 * k : 100 * k + 100], frame.schema)
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    got = run_in_order(spark, tmp_path / "in", frame.schema, "shuffled", tmp_path, late="2 days")
    want = in_order(frame.collect(), 0.1)
    edge = max(r[1] for r in rows) - dt.timedelta(days=2)
    due = {k: v for k, v in want.items() if k[1] <= edge}
    assert len(got) == len(due) > 200
    for r in got:
        assert (r.state is None) == (due[(r.entity_id, r.ts, r.price)] is None) and (r.state is None or r.state == pytest.approx(due[(r.entity_id, r.ts, r.price)]))


def test_a_silent_entity_is_forgotten(spark, tmp_path):
    begin = dt.datetime(2024, 1, 1)
    days = {"a": (0, 1, 2, 30, 31), "b": tuple(range(40))}  # a is silent for four weeks
    for k in range(40):
        rows = [(e, begin + dt.timedelta(days=k), 100.0 + k) for e, own in days.items() if k in own]
        if k % 4 == 0:
            batch = []
        batch += rows
        if k % 4 == 3:
            spark.createDataFrame(batch, "entity_id string, ts timestamp, price double").coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k:02d}"))
    schema = spark.createDataFrame([], "entity_id string, ts timestamp, price double").schema
    for name, options, again in (("kept", {}, False), ("forgotten", {"forget": "7 days"}, True)):
        got = {(r.entity_id, (r.ts - begin).days): r.r for r in run_in_order(spark, tmp_path / "in", schema, name, tmp_path, late="1 hour", **options)}
        assert (got[("a", 30)] is None) == again and got[("a", 31)] is not None and got[("b", 30)] is not None


class Memory:
    """The states, timers and watermark of one entity, in memory; ``written`` counts the ticks that are put into a state."""

    def __init__(self):
        self.values, self.timers, self.written, self.watermark = {}, [], 0, 0
        self.listTimers, self.registerTimer, self.deleteTimer = (lambda: list(self.timers)), self.timers.append, self.timers.remove
        self.getCurrentWatermarkInMs = lambda: self.watermark

    def getValueState(self, name, schema):
        return type("V", (), {"get": lambda _: self.values.get(name), "update": lambda _, v: self.values.update({name: v}), "clear": lambda _: self.values.pop(name, None)})()

    def getListState(self, name, schema):
        own, memory = [], self

        class Lists:
            def get(_):
                return iter(list(own))

            def put(_, rows):
                own[:] = rows
                memory.written += len(rows)

            def clear(_):
                own.clear()

        return Lists()

    def getMapState(self, name, keys, values):
        own, memory = {}, self

        class Maps:
            keys, getValue, exists = (lambda _: iter(list(own))), (lambda _, k: own[k]), (lambda _: bool(own))

            def updateValue(_, k, v):
                own[k] = v
                memory.written += len(v[0]) // 16

            def removeKey(_, k):
                del own[k]

        return Maps()


def test_a_held_tick_is_written_once_or_twice(monkeypatch):
    """Ninety batches of one entity, each shuffled over two hours, held for a day: the rows are those of one batch in order, and what waits is not written anew by each batch."""
    monkeypatch.setattr(states, "_FRAME", 7)
    monkeypatch.setattr(states, "_GATHERED", 25)
    g, memory, hour = np.random.default_rng(2), Memory(), 3_600_000_000
    processor, got, sent = states._InOrder(0.1, None), [], []
    processor.init(memory)
    for k in range(90):
        at, price = (hour * k + g.integers(0, 2 * hour, 40)) // 1000 * 1000, np.exp(g.normal(0, 0.01, 40))
        at[:3], price[:2] = at[0], price[0]  # ties, of equal and of other prices
        sent += zip(at.tolist(), price.tolist(), strict=True)
        frames = [pd.DataFrame({"at": at[i : i + 10], "price": price[i : i + 10]}) for i in range(0, 40, 10)]
        got += processor.handleInputRows(("a",), iter(frames), memory)
        memory.watermark = max(0, int(hour * (k - 24) // 1000) + 7)
        assert len(memory.timers) == 1
        if memory.timers[0] <= memory.watermark:
            got += processor.handleExpiredTimer(("a",), memory, None)
    assert memory.written <= 2.5 * len(sent)
    memory.watermark = 10**9
    got += processor.handleExpiredTimer(("a",), memory, None)
    got, v = pd.concat(got), None
    assert list(zip(got["at"], got["price"], strict=True)) == sorted(sent) and got["k"].tolist() == list(range(1, len(sent) + 1)) and not memory.timers
    for state, r in zip(got["state"].tolist()[1:], np.diff(np.log(got["price"])), strict=True):
        v = r * r if v is None else 0.1 * r * r + 0.9 * v
        assert state == pytest.approx(v)
