"""Incremental refresh: fingerprint-gated views, change batches, session counters."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.operators.predicates import first_case
from larkspur.sources.files import fingerprint, listing

# Kinds of changed paths, first match first.
PATH_KINDS = (
    (r"(?:^|/)app/models/", "models"), (r"(?:^|/)app/controllers/", "controllers"), (r"(?:^|/)app/views/", "views"), (r"(?:^|/)app/jobs/", "jobs"), (r"(?:^|/)app/mailers/", "mailers"),
    (r"(?:^|/)app/javascript/", "javascript"), (r"(?:^|/)config/routes", "routes"), (r"(?:^|/)config/locales/", "locales"), (r"(?:^|/)config/", "config"), (r"(?:^|/)db/migrate/", "migrations"), (r"(?:^|/)db/", "schema"),
    (r"(?:^|/)(?:spec|test)/", "tests"),
)


class Refreshed:
    """A DataFrame kept for ``ttl_s`` seconds, then while the fingerprint of its files stays; rebuilt otherwise."""

    def __init__(self, spark: SparkSession, path: str, build: Callable[[SparkSession], DataFrame], ttl_s: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.spark, self.path, self.build, self.ttl_s, self.clock = spark, path, build, ttl_s, clock
        self.frame: DataFrame | None = None
        self.seen, self.checked, self.builds = "", 0.0, 0

    def get(self) -> DataFrame:
        now = self.clock()
        if self.frame is not None and now - self.checked < self.ttl_s:
            return self.frame
        mark = fingerprint(listing(self.spark, self.path)).first()["fingerprint"]
        if self.frame is None or mark != self.seen:
            if self.frame is not None:
                self.frame.unpersist()
            self.frame, self.seen = self.build(self.spark).persist(), mark
            self.builds += 1
        self.checked = now
        return self.frame


def counted_kinds(changes: DataFrame, path: str = "path") -> DataFrame:
    """Changes of one batch counted by the kind of their path."""
    return changes.groupBy(first_case(F.col(path), PATH_KINDS, "other").alias("kind")).agg(F.count("*").alias("n"))


def watch(spark: SparkSession, path: str, schema: str, react: Callable[[DataFrame, int], None], checkpoint: str, debounce: str = "1500 milliseconds", once: bool = False) -> StreamingQuery:
    """React to batches of new JSON change records below path. A reaction that fails stops the query; Spark runs the batch again on restart."""
    stream = spark.readStream.schema(schema).json(path)
    writer = stream.writeStream.foreachBatch(react).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()


def session_calls(calls: DataFrame, ts: str = "ts") -> DataFrame:
    """Calls of each session by tool and parameters: count and last time. Works on batches and, in update mode, on streams."""
    return calls.groupBy(F.left("session", F.lit(200)).alias("session"), "tool", "params").agg(F.count("*").alias("call_count"), F.max(ts).alias("last_ts"))


def windowed_calls(calls: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls of a stream by tool and window; windows close when the watermark passes them."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", size), "tool").agg(F.count("*").alias("n"))


def recent_sessions(rows: DataFrame, session: str, ts: str, keep: int = 100) -> DataFrame:
    """The sessions used last, as many as are kept; ties go to the smaller name."""
    last = rows.groupBy(session).agg(F.max(ts).alias("last_ts"))
    few = last.orderBy(F.desc("last_ts"), session).limit(keep)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("last_ts"), session)))


def session_totals(calls: DataFrame, session: str, tool: str, params: Column) -> DataFrame:
    """Calls, different tools and different parameters of each session."""
    return calls.groupBy(session).agg(F.count("*").alias("n_calls"), F.countDistinct(tool).alias("n_tools"), F.countDistinct(params).alias("n_params"))
