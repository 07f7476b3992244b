"""Operators over ordered rows: carry-forward, context, blocks, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, value: Column, into: str, partition: list[str], order: list[str]) -> DataFrame:
    """The last value that was not null, up to and with this row."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.last(value, ignorenulls=True).over(w))


def tail(df: DataFrame, n: int, partition: list[str], order: list[str]) -> DataFrame:
    """The last n rows of each partition."""
    w = Window.partitionBy(*partition).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_from_end", F.row_number().over(w)).where(F.col("_from_end") <= n).drop("_from_end")


def tail_bytes(df: DataFrame, text: str, most: int, partition: list[str], order: list[str]) -> DataFrame:
    """The last rows of each partition whose bytes, line ends included, fit into ``most``."""
    w = Window.partitionBy(*partition).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_bytes", F.sum(F.octet_length(text) + 1).over(w)).where(F.col("_bytes") <= most).drop("_bytes")


def with_context(df: DataFrame, match: Column, around: int, partition: list[str], order: str) -> DataFrame:
    """Matching rows and those at most ``around`` positions away, with is_match."""
    w = Window.partitionBy(*partition).orderBy(order).rangeBetween(-around, around)
    marked = df.withColumn("is_match", F.coalesce(match, F.lit(False)))
    return marked.withColumn("_near", F.max(F.col("is_match").cast("int")).over(w)).where("_near = 1").drop("_near")


def block_end(df: DataFrame, opens: Column, indent: Column, closes: Column, partition: list[str], order: str) -> DataFrame:
    """Opening rows with the first closing row after them at the same indent."""
    w = Window.partitionBy(*partition, "_indent").orderBy(order).rangeBetween(1, Window.unboundedFollowing)
    marked = df.withColumn("_indent", indent)
    ended = marked.withColumn("block_end", F.min(F.when(closes, F.col(order))).over(w))
    return ended.where(opens).drop("_indent")


def after_mark(df: DataFrame, mark: Column, into: str, partition: list[str], order: list[str]) -> DataFrame:
    """Whether a marked row lies before this one in its partition."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(into, F.coalesce(F.max(mark.cast("int")).over(w), F.lit(0)) == 1)


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("_b"))
    return best.select(*key, "_b.*")


def headings(df: DataFrame, value: str, partition: list[str], order: list[str]) -> DataFrame:
    """Rows at which a value begins anew."""
    before = F.lag(value).over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("_before", before).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def ranked(df: DataFrame, by: list[Column], n: int, partition: list[str] = ()) -> DataFrame:
    """The best n rows (of each partition), with their rank."""
    if not partition:
        few = df.orderBy(*by).limit(n)
        return few.withColumn("rank", F.row_number().over(Window.orderBy(*by)))
    w = Window.partitionBy(*partition).orderBy(*by)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def page_info(total: int, offset: int = 0, limit: int = 50) -> dict:
    """How a page of :func:`page` lies in all rows: total, from and to (from 1; 0 for an empty page), and the offset of the next page or None."""
    first, size = max(0, offset), max(1, limit)
    shown = max(0, min(size, total - first))
    return {"total": total, "from": first + 1 if shown else 0, "to": first + shown if shown else 0, "next_offset": first + size if first + size < total else None}


def page(df: DataFrame, order: list[str], offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of a total order; a negative offset counts as 0, a limit below 1 as 1."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, limit))


def page_size(total: int) -> int:
    """All of up to 10 rows, half (rounded up) of up to 100, else 100."""
    return total if total <= 10 else -(-total // 2) if total <= 100 else 100


def listed_order(value: Column, order: list[str], otherwise: int = 99) -> Column:
    """A value's place in a list, from 1; others come last."""
    place = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(place > 0, place).otherwise(otherwise)


def within_budget(df: DataFrame, budget: int, partition: list[str], order: list[str]) -> DataFrame:
    """The leading rows of each partition whose JSON fits into a budget of characters, separators included."""
    w = Window.partitionBy(*partition).orderBy(*order)
    # A row takes three characters at least, so only so many can fit; that rank is cut in each task before the shuffle.
    few = df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= max(1, budget // 3))
    sized = few.withColumn("_size", F.length(F.to_json(F.struct(*df.columns))) + 1)
    return sized.withColumn("json_chars", F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("json_chars") <= budget).drop("_size", "_nth")
