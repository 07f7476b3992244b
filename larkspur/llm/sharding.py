"""Contiguous shards of near-equal bytes, from a distributed prefix sum.

The rows are range-partitioned by id and each partition's bytes are summed; the prefix sums of these few totals
give every partition its global offset, and a running sum inside the partition gives every row its own. A row
goes to the shard that holds the middle of its bytes, so that the cuts lie at equal targets and no shard is off
by more than its two border rows. Only as many totals as there are partitions, and one start for each shard, are
ever broadcast.

Null texts count as no bytes and as checksum 0. Rows with equal ids are ordered by checksum and size, so that
repeated rows stay together; equal rows are interchangeable, and a number of their own lets ranges cut between them. Very
long texts are never split. An empty table gives an empty result. Other columns, whatever their names, are ignored unless
asked for in ``carry``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut, fresh


def assign_shards(
    docs: DataFrame,
    n_shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Rows of id, size, text_crc32, shard, slot (in the shard, from 0) and global_slot, plus the carried columns as a struct."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    order = ["doc_id", "text_crc32", "size", "row"]
    numbered = cut(narrow.withColumn("row", F.monotonically_increasing_id()))  # sampling the ranges then reads no text
    ranged = cut(numbered.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    before, everywhere = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("size_offset"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("row_offset"),
        F.sum("part_size").over(everywhere).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumn("running", F.sum("size").over(inside))
        .withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
        .join(F.broadcast(offsets), "part")
        .withColumn("global_slot", F.col("row_offset") + F.col("nth") - 1)
        .withColumn("middle", 2 * (F.col("size_offset") + F.col("running")) - F.col("size"))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"(middle * {n_shards}) div (2 * greatest(total, 1))")).cast("int"))
    )
    starts = placed.groupBy("shard").agg(F.min("global_slot").alias("first_slot"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("global_slot") - F.col("first_slot")).alias("slot"), "global_slot", *(["carried"] if carry else [])
    )


def write_shards(docs: DataFrame, path: str, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the documents as one folder for each shard and give the name of the folders' column, which docs has not.

    A shard is written by as many tasks as its size asks for; its files, by name, and the rows in them lie in slot order.
    """
    placed = assign_shards(docs, n_shards, id_col, text_col, carry=tuple(docs.columns))
    name = fresh(docs, "shard")
    tasks = max(n_shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = placed.select(F.col("shard").alias(name), F.col("slot").alias(fresh(docs, "slot")), "carried").repartitionByRange(tasks, name, fresh(docs, "slot"))
    ordered.sortWithinPartitions(name, fresh(docs, "slot")).select(name, "carried.*").write.partitionBy(name).parquet(path)
    return name
