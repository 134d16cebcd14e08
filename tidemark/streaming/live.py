"""The live side: closed bars from trades, guarded ingest, streaming levels, alerts, snapshots.

Every function takes a streaming DataFrame and returns one; ``run`` drives it to a parquet
sink with a checkpoint, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.functions.scans import previous_row
from tidemark.operators.detectors import Trackers
from tidemark.session import scratch


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def read_folder(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """A folder as a stream, of at most ``files`` files in a micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def run(df: DataFrame, label: str, out: str | None = None, check: str | None = None) -> DataFrame:
    """Process everything available, then return what the sink holds.

    With the same ``out`` and ``check`` (sink and checkpoint) a later run goes on where this one stopped.
    """
    spark = df.sparkSession
    out, check = out or scratch(spark, label), check or scratch(spark, f"{label}-state")
    q = (
        df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_batches(df: DataFrame, label: str, each) -> None:
    """foreachBatch with a checkpoint: ``each(batch, batch_id)`` must be idempotent."""
    q = df.writeStream.option("checkpointLocation", scratch(df.sparkSession, f"{label}-state")).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()


def closed_bars(trades: DataFrame, step: str, delay: str) -> DataFrame:
    """Bars in append mode: a bar appears once the watermark has passed its end, never before.

    ``trades``: symbol, ts (timestamp), seq, price, quantity. Later trades of a closed bar are dropped; ``BarStore``
    keeps them.
    """
    w = F.window("ts", step)
    d = trades.withWatermark("ts", delay).groupBy("symbol", w.alias("w")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("trade_count"),
    )
    return d.select("symbol", F.unix_millis("w.start").alias("open_time"), F.unix_millis("w.end").alias("end"), "open", "high", "low", "close", "volume", "trade_count")


def _batches(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """All batches' rows of a store; a folder that no batch has written yet is an empty table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(f"{path}/{name}") if there else spark.createDataFrame([], schema)


class BarStore:
    """Bars of one step in a folder, with the trades that came too late beside them.

    A trade is late if, when its micro-batch begins, the newest trade of all earlier ones lies ``delay`` or more behind
    the end of its bar. Each micro-batch writes its late trades, mergeable sums of its other ones and its newest time under its own number,
    so that a batch that runs again replaces itself; nothing is held in one task. A bar is closed when the
    watermark has passed its end, and no later trade can change it.
    """

    def __init__(self, spark: SparkSession, path: str, step: int, delay: int):
        self.spark, self.path, self.step, self.delay = spark, path, step, delay

    LATE = "symbol string, seq long, timestamp long, price double, quantity double, batch long"
    PARTS = (
        "symbol string, open_time long, first struct<seq:long,price:double>, last struct<seq:long,price:double>, high double, low double, volume double, trade_count long, batch long"
    )
    MARKS = "newest long, batch long"

    def _read(self, name: str, schema: str) -> DataFrame:
        return _batches(self.spark, self.path, name, schema)

    def watermark(self, before: int | None = None) -> int | None:
        """Newest time of all batches (before one of them) less the delay; one number."""
        marks = self._read("marks", self.MARKS)
        newest = (marks if before is None else marks.filter(F.col("batch") < before)).agg(F.max("newest")).first()[0]
        return None if newest is None else newest - self.delay

    def take(self, batch: DataFrame, number: int) -> None:
        """One micro-batch of trades (symbol, seq, timestamp, price, quantity)."""
        line = self.watermark(number)
        start = F.col("timestamp") - F.pmod("timestamp", F.lit(self.step))
        rows = batch.select("symbol", "seq", "timestamp", "price", "quantity").withColumn("open_time", start).withColumn("_late", F.lit(False) if line is None else F.col("open_time") + self.step <= line)
        rows = rows.persist()
        put = lambda d, name: d.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        put(rows.filter("_late").drop("open_time", "_late"), "late")
        trade = F.struct("seq", "price")
        put(
            rows.filter("not _late").groupBy("symbol", "open_time").agg(
                F.min(trade).alias("first"), F.max(trade).alias("last"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("trade_count")
            ), "parts",
        )
        put(rows.agg(F.max("timestamp").alias("newest")).filter("newest is not null"), "marks")
        rows.unpersist()

    def run(self, trades: DataFrame) -> None:
        """All that is there of a stream; a later run with the same folder goes on behind it."""
        q = trades.writeStream.option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).foreachBatch(self.take).start()
        q.awaitTermination()

    def late(self) -> DataFrame:
        return self._read("late", self.LATE)

    def closed(self) -> DataFrame:
        """Bars whose end the watermark has passed."""
        line = self.watermark()
        bars = self._read("parts", self.PARTS).groupBy("symbol", "open_time").agg(
            F.min("first").alias("f"), F.max("last").alias("l"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count")
        )
        bars = bars.filter(F.col("open_time") + self.step <= F.lit(line))
        return bars.select("symbol", "open_time", (F.col("open_time") + self.step).alias("end"), F.col("f.price").alias("open"), "high", "low", F.col("l.price").alias("close"), "volume", "trade_count")


def dedup(trades: DataFrame, delay: str = "1 hour") -> DataFrame:
    return trades.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "id"])


def sessions(touches: DataFrame, gap: str, delay: str = "0 seconds") -> DataFrame:
    """Runs of touches with less than ``gap`` between neighbours."""
    d = touches.withWatermark("ts", delay).groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("touches"))
    return d.select("key", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "touches")


def _guard(step: int):
    def check(key, frames, state):
        last_open, last_end, last_close = state.get if state.exists else (-1, -1, float("nan"))
        rows = pd.concat(list(frames)).sort_values(["open_time", "arrival"])
        out = []
        for t, c in zip(rows["open_time"], rows["close"]):
            if last_open < 0 or t == last_open + step:
                status, last_open, last_close = "OK", t, c
            elif t == last_open:
                status = "DUPLICATE" if c == last_close else "CONFLICT"
            elif t < last_open:
                status = "LATE"
            else:
                status, last_open, last_close = "GAP", t, c
            out.append((key[0], int(t), status))
        state.update((int(last_open), int(last_open + step), float(last_close)))
        yield pd.DataFrame(out, columns=["symbol", "open_time", "status"])

    return check


def guard(bars: DataFrame, step: int) -> DataFrame:
    """One verdict per arriving bar: OK, GAP (page does not start where the last ended), DUPLICATE, CONFLICT, LATE."""
    return bars.groupBy("symbol").applyInPandasWithState(
        _guard(step), "symbol string, open_time long, status string", "last_open long, last_end long, last_close double", "append", GroupStateTimeout.NoTimeout
    )


LEVEL = "symbol string, kind string, price double, known_at long"


def _pairs(key, frames, state):
    prev = state.get if state.exists else None
    out = []
    rows = pd.concat(list(frames)).sort_values("open_time")
    for t, e, o, h, l, c in rows[["open_time", "end", "open", "high", "low", "close"]].itertuples(index=False):
        if prev is not None and prev[0] == t:
            _, po, ph, pl, pc = prev
            if pc > po and c < o:
                out.append((key[0], "RESISTANCE", min(h, ph), int(e)))
            elif pc < po and c > o:
                out.append((key[0], "SUPPORT", max(l, pl), int(e)))
        prev = (int(e), float(o), float(h), float(l), float(c))
    if prev is not None:
        state.update(prev)
    yield pd.DataFrame(out, columns=["symbol", "kind", "price", "known_at"])


def detect_pairs(bars: DataFrame) -> DataFrame:
    """Reversal pairs on the closed-bar stream; the state is the previous bar."""
    return bars.groupBy("symbol").applyInPandasWithState(_pairs, LEVEL, "end long, open double, high double, low double, close double", "append", GroupStateTimeout.NoTimeout)


def _reversals(fraction: float):
    def fold(key, frames, state):
        rows = pd.concat(list(frames)).sort_values("open_time").reset_index(drop=True)
        h, l, c, start, end = (list(rows[x]) for x in ("high", "low", "close", "open_time", "end"))
        run, first = None, 0
        if state.exists:  # the carried extremes are one bar in front, which ends where the last one did
            top, bottom, last_end = state.get
            h, l, c, start, end = [top, *h], [bottom, *l], [0.0, *c], [last_end, *start], [last_end, *end]
            run, first = Trackers(0, h, l, c, fraction), 1
        out = []
        for i in range(first, len(h)):
            if run is None or start[i] != end[i - 1]:  # the first bar, or one after a hole
                run = Trackers(i, h, l, c, fraction)
                continue
            for up, e in run.feed(i):
                out.append((key[0], "SUPPORT" if up else "RESISTANCE", float(l[e] if up else h[e]), int(end[i])))
        state.update((float(h[run.top]), float(l[run.bottom]), int(end[-1])))
        yield pd.DataFrame(out, columns=["symbol", "kind", "price", "known_at"])

    return fold


def detect_reversals(bars: DataFrame, fraction: float) -> DataFrame:
    """Confirmed reversals on the closed-bar stream; the state is the running high and low and the last bar's end."""
    return bars.groupBy("symbol").applyInPandasWithState(
        _reversals(fraction), LEVEL, "top double, bottom double, last_end long", "append", GroupStateTimeout.NoTimeout
    )


def _clock(key, frames, state):
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values("arrival")
    out = []
    for arrival, i in zip(rows["arrival"], rows["id"]):
        if last is not None and i < last:
            out.append((key[0], int(arrival), int(i)))
        last = int(i)
    state.update((last,))
    yield pd.DataFrame(out, columns=["symbol", "arrival", "id"])


def clock_guard(trades: DataFrame) -> DataFrame:
    """Trades (symbol, arrival, id) whose id is below that of the trade that arrived before, in this batch or an earlier one.

    A symbol's rows of a micro-batch are one group in one task; ``ClockGuard`` takes batches of any size.
    """
    return trades.select("symbol", "arrival", "id").groupBy("symbol").applyInPandasWithState(_clock, "symbol string, arrival long, id long", "last long", "append", GroupStateTimeout.NoTimeout)


class ClockGuard:
    """The trades of ``clock_guard``, in a folder, with no series in one task.

    Inside a micro-batch the trade before comes from chunks of ``chunk`` arrival numbers; a symbol's first trade is held against the last one
    of the earlier batches. Each micro-batch writes what it found and its last trades under its own number, so that
    a batch that runs again replaces itself. Of equal arrivals the smaller id is first.
    """

    FOUND = "symbol string, arrival long, id long, batch long"
    LAST = "symbol string, id long, batch long"

    def __init__(self, spark: SparkSession, path: str, chunk: int = 1 << 20):
        self.spark, self.path, self.chunk = spark, path, chunk

    def take(self, batch: DataFrame, number: int) -> None:
        """One micro-batch of trades (symbol, arrival, id)."""
        rows = batch.select("symbol", "arrival", "id")
        put = lambda d, name: d.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        earlier = _batches(self.spark, self.path, "last", self.LAST).filter(F.col("batch") < number)
        earlier = earlier.groupBy("symbol").agg(F.max_by("id", "batch").alias("_earlier"))
        d = previous_row(rows, ["symbol"], ["arrival", "id"], F.floor(F.col("arrival") / F.lit(self.chunk)), ["id"])
        d = d.join(earlier, "symbol", "left").filter(F.col("id") < F.coalesce("prev.id", "_earlier"))
        put(d.select("symbol", "arrival", "id"), "found")
        put(rows.groupBy("symbol").agg(F.max(F.struct("arrival", "id")).alias("_l")).select("symbol", "_l.id"), "last")

    def run(self, trades: DataFrame) -> None:
        """All that is there of a stream; a later run with the same folder goes on behind it."""
        q = trades.writeStream.option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).foreachBatch(self.take).start()
        q.awaitTermination()

    def found(self) -> DataFrame:
        return _batches(self.spark, self.path, "found", self.FOUND).drop("batch")


def _transitions(key, frames, state):
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values("seq")
    out = []
    for seq, s in zip(rows["seq"], rows["state"]):
        if last is not None and s != last:
            out.append((int(key[0]), int(seq), last, s))
        last = s
    state.update((last,))
    yield pd.DataFrame(out, columns=["key", "seq", "before", "after"])


def transition_alerts(rows: DataFrame) -> DataFrame:
    """One alert when a key changes state (key, seq, state)."""
    return rows.groupBy("key").applyInPandasWithState(_transitions, "key long, seq long, before string, after string", "last string", "append", GroupStateTimeout.NoTimeout)


def split_conflicts(batch: DataFrame, store: DataFrame, keys, value: str, order: str = "arrival"):
    """New rows, and rows that contradict an accepted one (same key, other value); equal rows vanish.

    Of new rows with one key the first by ``order`` (then by value) is accepted, the others are held against it.
    """
    keys = list(keys)
    old = store.select(*keys, F.col(value).alias("_old"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order, value))
    first = F.first(value).over(Window.partitionBy(*keys).orderBy(order, value))
    j = batch.join(old, keys, "left").withColumn("_nth", nth).withColumn("_held", F.coalesce("_old", first))
    new = j.filter("_old is null and _nth = 1")
    bad = j.filter((F.col("_old").isNotNull() | (F.col("_nth") > 1)) & (F.col("_held") != F.col(value)))
    return new.drop("_old", "_nth", "_held"), bad.drop("_old", "_nth", "_held")


def append_missing(batch: DataFrame, path: str, keys) -> None:
    """Append only observations the store does not hold yet: safe to repeat after a failure."""
    spark = batch.sparkSession
    new = batch.dropDuplicates(list(keys))
    try:
        new = new.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(exc):
            raise
    new.write.mode("append").parquet(path)


def freshness(ticks: DataFrame, now: int, stale_ms: int = 15_000) -> DataFrame:
    """FRESH, STALE or DISCONNECTED per symbol from the age of its last tick."""
    d = ticks.groupBy("symbol").agg(F.max("timestamp").alias("last"))
    age = F.lit(now) - F.col("last")
    return d.withColumn("age_ms", age).withColumn("status", F.when(age <= stale_ms, "FRESH").when(age <= 20 * stale_ms, "STALE").otherwise("DISCONNECTED"))
