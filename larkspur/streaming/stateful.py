"""Streams with a state of their own: sessions that end when they fall idle, and changes that wait for a quiet moment.

Both have a batch form over a table that gives the same rows, so that a stream can be checked against its history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkspur.operators.predicates import first_case
from larkspur.streaming.changes import PATH_KINDS

SESSION = "session string, started timestamp, last timestamp, n_calls long, tools string, evicted boolean"
_STATE = "started_us long, last_us long, n_calls long, tools array<string>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sessions(idle_us: int) -> StatefulProcessor:
    """The processor of sessions. Its class is made here, so that it travels whole to workers that cannot import this module."""

    class Sessions(StatefulProcessor):
        """One session's state: since when it runs, its last call, its calls and its different tools. A timer evicts it once it is idle."""

        def __init__(self, idle_us: int):
            self.idle_us = idle_us

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("session", _STATE)

        def _row(self, key, s, evicted: bool) -> dict:
            return {"session": key[0], "started": pd.Timestamp(s[0], unit="us"), "last": pd.Timestamp(s[1], unit="us"), "n_calls": s[2], "tools": ",".join(sorted(s[3])), "evicted": evicted}

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            calls = pd.concat(list(rows))
            held, out = self.state.get() if self.state.exists() else None, []
            for us, tool in sorted(zip(calls["us"].tolist(), calls["tool"].tolist(), strict=True)):
                if held is not None and us - held[1] > self.idle_us:
                    out.append(self._row(key, held, True))
                    held = None
                held = (us, us, 1, [tool]) if held is None else (min(us, held[0]), max(us, held[1]), held[2] + 1, sorted({*held[3], tool}))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.state.update(held)
            self.handle.registerTimer((held[1] + self.idle_us) // 1_000 + 1)
            out.append(self._row(key, held, False))
            yield pd.DataFrame(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.state.exists():
                held = self.state.get()
                self.state.clear()
                yield pd.DataFrame([self._row(key, held, True)])

        def close(self) -> None:
            pass

    return Sessions(idle_us)


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs Spark's store on disk, which also keeps large states out of memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def tracked_sessions(calls: DataFrame, idle: str = "30 minutes", late: str = "0 seconds") -> DataFrame:
    """A stream of calls (session, tool, ts) as changes of its sessions: a row for each that a batch touched, and one, evicted, when it ends.

    A session ends after more than idle without a call: with the next call, or with a timer, once the watermark has passed. State is kept
    for live sessions only. Session names are cut to 200 characters. Calls later than late may be lost, as with any watermark.
    """
    use_rocksdb(calls.sparkSession)
    span = calls.sparkSession.range(1).select((F.unix_micros(F.to_timestamp(F.lit("1970-01-02")) + F.expr(f"interval {idle}")) - F.unix_micros(F.to_timestamp(F.lit("1970-01-02")))).alias("us")).first()["us"]
    named = calls.withWatermark("ts", late).where("session IS NOT NULL AND ts IS NOT NULL").select(F.left("session", F.lit(200)).alias("session"), F.coalesce("tool", F.lit("")).alias("tool"), "ts", F.unix_micros("ts").alias("us"))
    return named.groupBy("session").transformWithStateInPandas(_sessions(span), SESSION, "Update", "EventTime")


def sessions_of(calls: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """The sessions of a whole table of calls: session, started, last, n_calls and tools."""
    named = calls.where("session IS NOT NULL AND ts IS NOT NULL").select(F.left("session", F.lit(200)).alias("session"), F.coalesce("tool", F.lit("")).alias("tool"), "ts")
    order = Window.partitionBy("session").orderBy("ts")
    opens = F.coalesce((F.col("ts") - F.lag("ts").over(order)) > F.expr(f"interval {idle}"), F.lit(False)).cast("int")
    numbered = named.withColumn("opens", opens).withColumn("nth", F.sum("opens").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("session", "nth").agg(F.min("ts").alias("started"), F.max("ts").alias("last"), F.count("*").alias("n_calls"), F.array_join(F.sort_array(F.collect_set("tool")), ",").alias("tools")).drop("nth")


def latest(changes: DataFrame) -> DataFrame:
    """The newest state of every session out of all its changes."""
    best = changes.groupBy("session", "started").agg(F.max_by(F.struct("last", "n_calls", "tools"), F.struct("n_calls", "evicted")).alias("x"))
    return best.select("session", "started", "x.*")


def debounced(changes: DataFrame, quiet: str = "1500 milliseconds", late: str | None = None, root: str = "root", path: str = "path") -> DataFrame:
    """Changes (root, path, ts) as batches of each root that end with a quiet time: root, started, ended, n_changes, n_paths and the kinds met.

    On a stream, late is how long changes may be late; a batch is given once the watermark has passed its quiet time, and only then.
    """
    seen = changes if late is None else changes.withWatermark("ts", late)
    kinds = F.sort_array(F.collect_set(first_case(F.col(path), PATH_KINDS, "other")))
    grouped = seen.groupBy(root, F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n_changes"), F.sort_array(F.collect_set(path)).alias("_paths"), F.array_join(kinds, ",").alias("kinds"), F.max("ts").alias("ended"))
    return grouped.select(root, F.col("w.start").alias("started"), "ended", "n_changes", F.size("_paths").cast("long").alias("n_paths"), "kinds")
