"""Temperature mixing of sources, realised as budgeted block permutations.

Token shares are raised to an exponent alpha in steps of one thousandth. The exponent is bisected: the largest
that reaches the target entropy, but never below the smallest that keeps the most repeated source within the
repetition limit. Weights times the budget give each source a quota of tokens. A source plays its quota as whole
passes over all of its documents plus a part of one more pass. Every pass is a permutation made of blocks: a keyed
hash of pass, id and text names the block and the place in it, block totals give the offsets, and a document is
played while the tokens before it in its source are below the quota. Tokens are words.

Without a budget, the smallest one is taken that plays the largest source once, so that no document is lost.

The texts are read once, for their words and hashes; what is dealt is narrow. Rows that agree in id, source and text are
one unit, counted first and played or left out together, so that copies never fill a block, and the stage that repeats
the documents themselves (:func:`replay`) plays exactly what :func:`mix` lists. A hot source is spread over blocks of bounded
size, so no task holds a whole source. Sources are never collected: the bisection reads a few sums over the table of
source totals in every round.

Null texts have no tokens; a null source is a source of its own. Documents without tokens are played in every whole
pass. A source without any tokens is played once and has no weight. Very long texts count in whole. An empty table gives an
empty result. Other columns, whatever their names, are ignored by :func:`mix` and kept by :func:`replay`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import WORD, cut, small

STEPS = 1000


def _key(seed: int, turn: Column, doc: Column, mark: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), F.coalesce(doc.cast("string"), F.lit("")), mark))


def _mark(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, mark (of the text), n_tokens and copies: one row for all rows that agree in id, source and text."""
    tokens = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _mark(F.col(text_col)).alias("mark"), tokens.alias("n_tokens"))
    return narrow.groupBy("doc_id", "source", "mark").agg(F.min("n_tokens").alias("n_tokens"), F.count("*").alias("copies"))


def source_totals(counted: DataFrame) -> DataFrame:
    """Tokens, documents and units of each source."""
    return counted.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("total"), F.sum("copies").alias("n_docs"), F.count("*").alias("n_units"))


def solve_alpha(totals: DataFrame, entropy_share: float, max_passes: float, budget: int | None = None, fan: int = 20) -> int:
    """The exponent in thousandths; every round of the bisection tries ``fan`` points in one aggregation."""
    share = F.col("total").cast("double")
    some = totals.where("total > 0")

    def measured(points: list[int]) -> list[tuple[float, float]]:
        columns = [F.count("*").alias("k"), F.max(share).alias("most"), F.min(share).alias("least")]
        for p in points:
            power = F.pow(share, F.lit(p / STEPS))
            columns += [F.sum(power).alias(f"z{p}"), F.sum(power * F.log(share)).alias(f"s{p}")]
        row = some.agg(*columns).first()
        if not row["k"]:
            return [(1.0, 1.0)] * len(points)
        out = []
        for p in points:
            alpha, z = p / STEPS, row[f"z{p}"]
            entropy = math.log(z) - alpha * row[f"s{p}"] / z
            passes = (row["most"] / row["least"]) ** (1 - alpha) if budget is None else budget * row["least"] ** (alpha - 1) / z
            out.append((entropy / math.log(row["k"]) if row["k"] > 1 else 1.0, passes))
        return out

    def bisect(accept, low: int, high: int) -> int:
        """The largest accepted point if low is accepted, for a test that turns false once; low otherwise."""
        while high - low > 0:
            points = sorted({low + max(1, (high - low) * (i + 1) // fan) for i in range(fan)} - {low})
            good = [p for p, m in zip(points, measured(points), strict=True) if accept(m)]
            best = max(good, default=low)
            low, high = best, min([p - 1 for p in points if p > best], default=best)
        return low

    by_entropy = bisect(lambda m: m[0] >= entropy_share, 0, STEPS)
    too_often = bisect(lambda m: m[1] > max_passes, -1, STEPS)  # the last point that repeats too often
    return min(STEPS, max(by_entropy, too_often + 1))


def quotas(counted: DataFrame, entropy_share: float = 0.95, max_passes: float = 3.0, budget: int | None = None) -> DataFrame:
    """source, total, n_docs, n_units, alpha (thousandths) and quota, one row for each source of the units."""
    totals = cut(source_totals(counted))
    milli = solve_alpha(totals, entropy_share, max_passes, budget)
    alpha, total = F.lit(milli / STEPS), F.col("total").cast("double")
    power = F.when(total > 0, F.pow(total, alpha)).otherwise(F.lit(0.0))
    over_all = totals.agg(F.max(total).alias("most"), F.sum(power).alias("z")).first()
    if budget is None:
        quota = F.floor(total * F.pow(F.lit(over_all["most"]) / F.greatest(total, F.lit(1.0)), 1 - alpha) + 0.5)
    else:
        quota = F.floor(F.lit(float(budget)) * power / F.lit(over_all["z"]))
    return cut(totals.select("source", "total", "n_docs", "n_units", F.lit(milli).alias("alpha"), quota.cast("long").alias("quota")))


def _played(docs: DataFrame, entropy_share: float, max_passes: float, budget: int | None, seed: int, block_docs: int, group_blocks: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row for each time that a unit is played."""
    counted = cut(units(docs, id_col, text_col, source_col))
    plan = quotas(counted, entropy_share, max_passes, budget)
    plays = F.when(F.col("total") == 0, F.lit(1)).otherwise(F.expr("(quota + total - 1) div total"))
    dealt = (
        counted.join(small(plan).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn("plays", plays.cast("int"))
        .where("plays > 0")
        .withColumn("pass", F.explode(F.expr("sequence(0, plays - 1)")))
        .withColumn("key", _key(seed, F.col("pass"), F.col("doc_id"), F.col("mark")))
        .withColumn("blocks", F.expr(f"(n_units + {block_docs - 1}) div {block_docs}"))
        .withColumn("block", F.expr("(cast(conv(substring(key, 1, 8), 16, 10) as long) * blocks) div 4294967296"))
        .withColumn("held", F.col("n_tokens") * F.col("copies"))
    )
    # Prefix sums in two levels: inside groups of ``group_blocks`` blocks, then over the groups' totals.
    of = ["source", "pass"]
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy(*of, "block").agg(F.sum("held").alias("held")).withColumn("upper", F.expr(f"block div {group_blocks}"))
    inner = held.withColumn("inner_offset", F.coalesce(F.sum("held").over(earlier(*of, "upper", "block")), F.lit(0)))
    outer = held.groupBy(*of, "upper").agg(F.sum("held").alias("held")).withColumn("outer_offset", F.coalesce(F.sum("held").over(earlier(*of, "upper")), F.lit(0)))
    outer = outer.select(*(F.col(c).alias(f"_{c}") for c in [*of, "upper"]), "outer_offset")
    grouped = inner.join(outer, [inner[c].eqNullSafe(F.col(f"_{c}")) for c in [*of, "upper"]])
    offsets = grouped.select(
        F.col("source").alias("of"), F.col("pass").alias("in_pass"), F.col("block").alias("in_block"), (F.col("inner_offset") + F.col("outer_offset")).alias("block_offset")
    )
    inside = Window.partitionBy("source", "pass", "block").orderBy("key", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, 0)
    here = F.col("source").eqNullSafe(F.col("of")) & (F.col("pass") == F.col("in_pass")) & (F.col("block") == F.col("in_block"))
    return (
        dealt.withColumn("running", F.sum("held").over(inside) - F.col("held"))
        .join(offsets, here)
        .withColumn("token_offset", F.col("pass") * F.col("total") + F.col("block_offset") + F.col("running"))
        .where("token_offset < quota or pass < quota div greatest(total, 1) or total = 0")
        .select("doc_id", "source", "mark", "key", F.col("pass").cast("int").alias("pass"), "n_tokens", "copies", "token_offset", "quota", "alpha")
    )


def mix(
    docs: DataFrame,
    entropy_share: float = 0.95,
    max_passes: float = 3.0,
    budget: int | None = None,
    seed: int = 7,
    block_docs: int = 2_048,
    group_blocks: int = 2_048,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row for each time that a document is played: doc_id, source, pass, n_tokens, token_offset in its source, quota, alpha, mix_pos.

    mix_pos is the offset's share of the quota in billionths: sorted by it, the sources interleave at their weights.
    """
    played = _played(docs, entropy_share, max_passes, budget, seed, block_docs, group_blocks, id_col, text_col, source_col)
    each = played.withColumn("_copy", F.explode(F.expr("sequence(0L, copies - 1)"))).withColumn("token_offset", F.col("token_offset") + F.col("_copy") * F.col("n_tokens"))
    share = F.floor(F.col("token_offset").cast("double") * 1e9 / F.greatest(F.col("quota"), F.lit(1)).cast("double")).cast("long")
    return each.select("doc_id", "source", "pass", "n_tokens", "token_offset", "quota", "alpha", share.alias("mix_pos"))


def replay(
    docs: DataFrame,
    entropy_share: float = 0.95,
    max_passes: float = 3.0,
    budget: int | None = None,
    seed: int = 7,
    block_docs: int = 2_048,
    group_blocks: int = 2_048,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The documents themselves, each as often as :func:`mix` plays it, in the columns of docs.

    Whether a document is in its source's last, partial pass is a matter of its key alone: the largest key that the
    pass plays is found for each source, and texts are then compared with it where they lie, without a shuffle.
    """
    played = _played(docs, entropy_share, max_passes, budget, seed, block_docs, group_blocks, id_col, text_col, source_col)
    last = played.groupBy("source", "pass").agg(F.max("key").alias("last_key"))
    cuts = cut(last.groupBy("source").agg(F.max("pass").alias("turns"), F.max_by("last_key", "pass").alias("last_key")))
    cuts = small(cuts).select(F.col("source").alias("_of"), F.col("turns").alias("_turns"), F.col("last_key").alias("_last_key"))
    here = docs.select(F.struct(*docs.columns).alias("_row")).join(cuts, F.col("_row")[source_col].eqNullSafe(F.col("_of")))
    final = _key(seed, F.col("_turns"), F.col("_row")[id_col], _mark(F.col("_row")[text_col])) <= F.col("_last_key")
    times = F.col("_turns") + F.when(final, 1).otherwise(0)
    return here.withColumn("_times", times).where("_times > 0").withColumn("_nth", F.explode(F.expr("sequence(1, _times)"))).select("_row.*")
