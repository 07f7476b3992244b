"""Counts, tallies, shares and grouped samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tally(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def most_frequent(df: DataFrame, group: str, value: str) -> DataFrame:
    """The commonest value of each group; of equals, the smallest."""
    counted = tally(df, group, value)
    return counted.groupBy(group).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("b")).select(group, f"b.{value}", "b.n")


def histogram(df: DataFrame, value: Column, labels: list[str]) -> DataFrame:
    """One row with a count for each label."""
    return df.select(value.alias("_v")).agg(*(F.count_if(F.col("_v") == x).alias(x) for x in labels))


def same_signature(df: DataFrame, member: str, signature: Column, at_least: int = 3) -> DataFrame:
    """Members that share a signature, where at least that many do."""
    grouped = df.groupBy(signature.alias("signature")).agg(F.count("*").alias("n"), F.min(member).alias("first_member"))
    return grouped.where(F.col("n") >= at_least)


def signature_members(df: DataFrame, member: str, signature: Column, at_least: int = 3, block: int = 10_000) -> DataFrame:
    """Signatures that at least so many members share: n, and the members in sorted blocks of bounded size (nth from 0), so that a signature of any size stays in many rows."""
    marked = df.select(signature.alias("signature"), F.col(member).alias("_m"))
    sized = marked.groupBy("signature").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    spread = marked.join(sized, "signature").withColumn("nth", F.pmod(F.xxhash64("_m"), F.ceil(F.col("n") / block)).cast("int"))
    return spread.groupBy("signature", "n", "nth").agg(F.sort_array(F.collect_list("_m")).alias("members"))


def joined_set(df: DataFrame, keys: list[str], value: str, separator: str = "|") -> DataFrame:
    """Different values of each group, sorted and joined."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(value)), separator).alias("joined"))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """part of whole in percent; nothing of nothing is null."""
    return F.when(whole != 0, F.round(100.0 * part / whole, digits))


def coverage(reference: DataFrame, found: DataFrame, group: str, key: str) -> DataFrame:
    """For each group of found: keys of the reference it has, lacks and adds, and the share it has."""
    total = reference.select(key).distinct()
    have = found.select(group, key).distinct()
    marked = have.join(total.withColumn("_in", F.lit(1)), key, "left")
    n = total.agg(F.count("*").alias("n_reference"))
    counts = marked.groupBy(group).agg(F.count("_in").alias("present"), F.count_if(F.col("_in").isNull()).alias("extra"))
    return counts.join(F.broadcast(n)).select(group, "present", "extra", (F.col("n_reference") - F.col("present")).alias("missing"), percent(F.col("present"), F.col("n_reference")).alias("pct"))


def score(status: Column) -> Column:
    """Checks as one percentage: 10 for a pass, 5 for a warning, of 10 each."""
    points = F.sum(F.when(status == "pass", 10).when(status == "warn", 5).otherwise(0))
    return F.round(100.0 * points / (F.count("*") * 10), 0)


def sample_of(df: DataFrame, group: str, value: str, n: int = 3) -> DataFrame:
    """Each group's count and its n smallest different values, without gathering the group."""
    counts = tally(df, group)
    few = df.select(group, value).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(value))).where(F.col("_r") <= n)
    return counts.join(few.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(value)), "|").alias("sample")), group)


def merged_verbs(routes: DataFrame) -> DataFrame:
    """Routes with the two verbs of an update merged into one row, PATCH first."""
    kind = F.when(F.col("verb").isin("PUT", "PATCH"), "PATCH|PUT").otherwise(F.col("verb"))
    grouped = routes.groupBy("path", "action", kind.alias("_kind")).agg(F.array_join(F.sort_array(F.collect_set("verb")), "|").alias("verb"))
    return grouped.drop("_kind")
