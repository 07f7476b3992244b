"""Results kept by the digest of the text they were made from, so that what did not change is not computed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ContentCache:
    """Values of texts in a table below ``path``, by SHA-256; ``compute`` takes a frame of digest and text, and gives digest and value.

    A call computes the different texts that the table lacks, once each, and writes the table anew with the time of their last use.
    Beyond ``most`` entries a quarter of that many goes, those used longest ago first, ties by digest; texts of the call itself are
    answered all the same. Null texts have no value. One caller at a time writes a path.
    """

    def __init__(self, spark: SparkSession, path: str, compute: Callable[[DataFrame], DataFrame], most: int = 1_000_000):
        self.spark, self.path, self.compute, self.most, self.calls = spark, path.rstrip("/"), compute, most, 0
        self.held: DataFrame | None = None

    def get(self, rows: DataFrame, text: str) -> DataFrame:
        """rows with value, and hit: whether the table had it before this call."""
        self.calls += 1
        marked = rows.withColumn("digest", F.sha2(text, 256))
        wanted = marked.where("digest IS NOT NULL").groupBy("digest").agg(F.any_value(text).alias("text"))
        lacking = wanted if self.held is None else wanted.join(self.held.select("digest"), "digest", "left_anti")
        fresh = self.compute(lacking).select("digest", "value", F.lit(self.calls).alias("used"), F.lit(False).alias("hit"))
        if self.held is not None:
            again = self.held.join(wanted.select("digest", F.lit(True).alias("_now")), "digest", "left")
            fresh = fresh.unionByName(again.select("digest", "value", F.when(F.col("_now"), self.calls).otherwise(F.col("used")).alias("used"), F.lit(True).alias("hit")))
        written = f"{self.path}/call-{self.calls}"
        fresh.write.mode("overwrite").parquet(written)
        whole = self.spark.read.schema(fresh.schema).parquet(written)
        kept = whole.select("digest", "value", "used")
        if whole.count() > self.most:
            kept = kept.orderBy(F.desc("used"), "digest").limit(self.most - self.most // 4)
            kept.write.mode("overwrite").parquet(f"{written}-kept")
            kept = self.spark.read.schema(kept.schema).parquet(f"{written}-kept")
        self.held = kept
        return marked.join(whole.select("digest", "value", "hit"), "digest", "left").drop("digest")
