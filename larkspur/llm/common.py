"""Shared helpers of the text operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of what separates words: the six ASCII white-space characters.
GAPS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Session setting that ends an Arrow batch by its bytes, and the bytes of a batch of texts.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir, or the checkpoint folder set on its context.

    Where neither is set, a session that runs in this process alone gets a temporary folder; any other one is refused.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the shared folder, so that lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty array."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAPS, -1))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row.

    An expression in a plain projection may be copied into the lambdas and filters above it and then runs once for
    each element; a generator is never copied.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def limit_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let an Arrow batch that goes to Python end after ``most`` bytes, where the session allows more; a smaller limit stays.

    Batches end after 10,000 rows by default, some 34 MB of texts. The limit of the session is read when a plan is
    made, so it stays lowered for frames that are computed later. It decides how rows travel, never which.
    """
    size = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(ARROW_BYTES).strip().lower())
    now = int(size[1]) * 1024 ** " kmgtp".index(size[2] or " ") if size else 0
    if not 0 < now <= most:
        spark.conf.set(ARROW_BYTES, str(most))


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, which has been cut, marked for broadcast if it has at most that many rows; larger ones are joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
