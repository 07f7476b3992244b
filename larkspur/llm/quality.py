"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Tokens are runs of letters, digits and underscores, or runs of other signs. Single tokens and pairs of tokens are hashed
into buckets, whose number grows with the corpus: the power of two from ``8 * sqrt(bytes of text)`` on, as the number of
different n-grams grows more slowly than the text. Raw counts cover every document. Trusted counts cover every document
labelled good and not toxic, but for a quarter by hashed id, which is held out. Each bucket has the weight
ln(p_trusted / p_raw), add-one smoothed, in whole sixteenths between -63 and 63, so that sums do not depend on their order
and the table stays small. A document's
score is the mean weight of its n-grams; it is kept if its base rules pass and the score reaches the threshold. No
document is skipped, and none is sampled for its verdict.

The threshold is fitted on all held-out documents, good and bad, and on them alone: the one with the least sum of the shares
judged wrongly in each class, in the middle between two neighbouring means. Means are dealt by ranges; sums inside a range and
over the ranges before it place each of them, so neither one task nor the driver sees them all.

Up to ``inline_buckets`` the weights are a constant of the plan, and everything about one document is computed in its own
row: no text is shuffled. Beyond it the weights stay a table, and the n-grams, counted for each text first, are joined with
it; both ways give the same scores.

A text without words fails the base rules. A text without tokens scores zero. Null texts count as texts without words. Very
long texts are read in whole. Repeated rows get equal verdicts; an id with several texts has one verdict for each text.
Without held-out documents of both classes no threshold can be fitted, and the base rules decide alone. An empty table
gives an empty result. Other columns, whatever their names, are ignored by :func:`judge` and kept by :func:`keep_good`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut, once, small, words

UNIT, MOST = 16, 63
TOKEN = r"[\p{L}\p{M}\p{N}_]++|[^\p{L}\p{M}\p{N}_\s]++"


def with_repeated_words(split: DataFrame, width: int = 5) -> DataFrame:
    """Adds n_repeat_words: words of ``found`` in windows of ``width`` words that occur twice or more in it, first included.

    Words are hashed once, and windows compared by their words' hashes, shifted by their place and mixed to 64 bits. Texts without an equal pair, nearly all of them, stop after one pass.
    """
    last = F.size("found") - width
    each = once(split, "_w", F.transform("found", lambda w: F.xxhash64(w)))
    mixed = lambda i: reduce(lambda a, b: a.bitwiseXOR(b), (F.call_function("shiftleft", F.get("_w", i + k), F.lit(3 * k)) for k in range(width)))
    window = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), mixed)
    hashed = once(each, "_h", F.when(last > 0, window).otherwise(F.array().cast("array<bigint>")))
    entries = F.sort_array(F.arrays_zip(F.col("_h").alias("h"), F.sequence(F.lit(0), F.size("_h") - 1).alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    placed = once(hashed, "_p", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), entries).otherwise(none))
    n = F.size("_p")
    blank = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    around = F.arrays_zip(
        F.col("_p").alias("x"),
        F.concat(blank, F.slice("_p", F.lit(1), F.greatest(n - 1, F.lit(0)))).alias("a"),
        F.concat(F.slice("_p", F.lit(2), F.greatest(n - 1, F.lit(0))), blank).alias("b"),
    )
    twins = F.filter(around, lambda e: F.coalesce(e["x"]["h"] == e["a"]["h"], F.lit(False)) | F.coalesce(e["x"]["h"] == e["b"]["h"], F.lit(False)))
    starts = F.sort_array(F.transform(twins, lambda e: e["x"]["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-1).alias("upto")),
        lambda s, at: F.struct((s["n"] + at + width - F.greatest(s["upto"], at)).alias("n"), (at + width).alias("upto")),
        lambda s: s["n"],
    )
    return placed.withColumn("n_repeat_words", F.when(n > 0, covered).otherwise(0).cast("long")).drop("_w", "_h", "_p")


def base_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "")
    split = once(once(narrow, "found", words(F.col("text"))), "lines", lines)
    counted = with_repeated_words(split).select(
        "doc_id",
        "text",
        F.size("found").cast("long").alias("n_words"),
        F.length(F.array_join("found", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    return counted.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


@dataclass
class Model:
    """Weights of n_buckets buckets in sixteenths, as a JSON array or as a table (bucket, weight), and the least mean score."""

    n_buckets: int
    inline: str | None
    table: DataFrame
    threshold: float | None = None


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _hashes(text: Column) -> Column:
    return F.transform(_tokens(text), lambda t: F.xxhash64(t))


def _pair(first: Column, second: Column) -> Column:
    """The hash of two tokens out of theirs; their order counts."""
    return first.bitwiseXOR(F.call_function("shiftleft", second, F.lit(1)))


def _grams(split: DataFrame, n_buckets: int, *keep: str) -> DataFrame:
    """Rows of the columns kept and bucket, for each token and each pair of tokens of ``t``."""
    cell = lambda h: h.bitwiseAND(F.lit(n_buckets - 1)).cast("int")
    placed = split.where("size(t) > 0").select(*keep, "t", F.explode(F.expr("sequence(0, size(t) - 1)")).alias("i"))
    here, before = F.xxhash64(F.expr("t[i]")), F.xxhash64(F.expr("t[i - 1]"))
    pair = F.when(F.col("i") > 0, cell(_pair(before, here)))
    return placed.select(*keep, F.explode(F.array(cell(here), pair)).alias("bucket")).where("bucket is not null")


def buckets_for(n_bytes: int) -> int:
    return 1 << max(12, math.ceil(math.log2(8 * math.sqrt(max(1, n_bytes)))))


def train(
    docs: DataFrame, labels: DataFrame, inline_buckets: int = 1 << 21, n_buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """Counts over all documents against counts over trusted ones, and the threshold that the held-out ones ask for."""
    model, held_out = _weights(docs, labels, inline_buckets, n_buckets, id_col, text_col)
    plain = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model.threshold = _threshold(scored(plain.join(held_out, F.col("_id") == F.col("_of")).select("text", "good"), model))
    return model


def _weights(docs: DataFrame, labels: DataFrame, inline_buckets: int = 1 << 21, n_buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model without a threshold, and the held-out ids (_of) with their class (good)."""
    plain = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if n_buckets is None:
        n_buckets = buckets_for(plain.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0)
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int") - F.coalesce(F.col("toxic"), F.lit(0))).alias("good"), F.max("quality").alias("quality"))
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) == 0
    known = cut(known.where("good = 1 or quality = 0").select(F.col("doc_id").alias("_of"), (F.col("good") == 1).alias("good"), held_out.alias("held_out")))
    trusted = small(cut(known.where("good and not held_out").select("_of")))
    marked = plain.join(trusted, F.col("_id") == F.col("_of"), "left").select(F.col("_of").isNotNull().cast("int").alias("trusted"), "_text")
    counts = cut(_grams(once(marked, "t", _tokens(F.col("_text"))), n_buckets, "trusted").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("good")))
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    n_raw, n_good = (total["raw"] or 0) + n_buckets, (total["good"] or 0) + n_buckets
    share = lambda c, n: F.log((F.coalesce(F.col(c), F.lit(0)) + 1).cast("double") / F.lit(float(n)))
    weight = F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.round(UNIT * (share("good", n_good) - share("raw", n_raw))).cast("int")))
    every = docs.sparkSession.range(0, n_buckets, 1).select(F.col("id").cast("int").alias("bucket"))
    table, inline = every.join(counts, "bucket", "left").select("bucket", weight.alias("weight")), None
    if n_buckets <= inline_buckets:  # rows of 4,096 weights each, as text
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"].cast("string"))
        parts = table.groupBy(F.expr("bucket div 4096").alias("part")).agg(F.array_join(ordered, ",").alias("w"))
        inline = "[" + ",".join(r["w"] for r in parts.orderBy("part").collect()) + "]"
    return Model(n_buckets, inline, cut(table) if inline is None else table), small(cut(known.where("held_out").select("_of", "good")))


def _threshold(tested: DataFrame) -> float | None:
    """The least mean score that parts the rows (good, n_grams, score) best; of equal ones the one in the widest gap, then the lowest."""
    mean = tested.where("n_grams > 0").select("good", (F.col("score") / F.col("n_grams")).alias("mean"))
    places = cut(mean.groupBy("mean").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")))
    n = places.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not n["good"] or not n["bad"]:
        return None
    ranged = cut(places.repartitionByRange("mean").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(*(F.sum(c).alias(f"part_{c}") for c in ("good", "bad")), F.max("mean").alias("part_last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", *(F.coalesce(F.sum(f"part_{c}").over(before), F.lit(0)).alias(f"{c}_offset") for c in ("good", "bad")), F.max("part_last").over(before).alias("last_before"))
    inside = Window.partitionBy("part").orderBy("mean")
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("part", "mean", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("good", "bad")), F.lag("mean").over(inside).alias("lag")).join(F.broadcast(offsets), "part")
    prior = F.coalesce("lag", "last_before")
    wrong = (F.col("good") + F.col("good_offset")) * n["bad"] - (F.col("bad") + F.col("bad_offset")) * n["good"]  # in whole numbers, as shares of both classes
    cuts = placed.select("mean", wrong.alias("wrong"), F.coalesce((prior + F.col("mean")) / 2, F.col("mean") - 1).alias("cut"), F.coalesce(F.col("mean") - prior, F.lit(0.0)).alias("gap"))
    return cuts.orderBy("wrong", F.desc("gap"), "mean").first()["cut"]


def scored(base: DataFrame, model: Model) -> DataFrame:
    """base (with a column text, and none named h) with n_grams and score (the summed weights) of each text."""
    n, mask = F.size("h"), F.lit(model.n_buckets - 1)
    if model.inline is not None:
        weights = F.from_json(F.lit(model.inline), "array<bigint>")  # folded into one constant
        hashed = once(base, "h", _hashes(F.col("text")))
        of = lambda h: F.get(weights, h.bitwiseAND(mask).cast("int"))
        last = F.greatest(n - 1, F.lit(0))
        alone = F.aggregate("h", F.lit(0).cast("long"), lambda s, h: s + of(h))
        pairs = F.aggregate(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), F.lit(0).cast("long"), lambda s, i: s + of(_pair(F.get("h", i - 1), F.get("h", i))))
        total = F.when(n > 0, alone).otherwise(F.lit(0).cast("long")) + F.when(n > 1, pairs).otherwise(F.lit(0).cast("long"))
        return once(hashed, "score", total).select(*base.columns, F.greatest(2 * n - 1, F.lit(0)).cast("long").alias("n_grams"), "score")
    key = lambda: [F.xxhash64("text").alias("_k"), F.xxhash64("text", F.lit(1)).alias("_l")]  # noqa: E731  equal texts have equal scores
    hashed = base.select(*key(), "text").dropDuplicates(["_k", "_l"]).select("_k", "_l", _tokens(F.col("text")).alias("t"))
    counted = _grams(hashed, model.n_buckets, "_k", "_l").groupBy("_k", "_l", "bucket").agg(F.count("*").alias("n"))
    sums = counted.join(model.table, "bucket").groupBy("_k", "_l").agg(F.sum("n").alias("n_grams"), F.sum(F.col("n") * F.col("weight")).alias("score"))
    out = base.select("*", *key()).join(sums, ["_k", "_l"], "left").drop("_k", "_l")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_grams", "score")})


def _passes(model: Model, threshold: float | None) -> Column:
    """threshold: a mean log-likelihood ratio, instead of the fitted one."""
    least = model.threshold if threshold is None else threshold * UNIT
    fine = ~F.col("base_failed")
    return fine if least is None else fine & (F.col("score") >= F.lit(float(least)) * F.col("n_grams"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Verdicts for every document: the base counts, base_failed, n_grams, score and kept. settings are those of :func:`train`."""
    model, held_out = _weights(docs, labels, id_col=id_col, text_col=text_col, **settings)
    rows = cut(scored(base_rules(docs, id_col, text_col), model).drop("text"))  # narrow; the threshold is fitted on these scores, so no text is read or scored again
    model.threshold = _threshold(rows.join(held_out, F.col("doc_id") == F.col("_of")))
    return rows.withColumn("kept", _passes(model, threshold))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents that are kept, with their own columns only."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, **settings)
    whole = docs.select(F.struct(*docs.columns).alias("doc_id"), F.col(text_col).alias("text"))
    return scored(base_rules(whole), model).where(_passes(model, threshold)).select("doc_id.*")
