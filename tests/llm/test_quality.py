import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.llm import quality


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def rows_of(frame):
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in frame.collect()}


def test_base_rules_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(quality.base_rules(docs)) == {r.doc_id: brute_base(r.text) for r in docs.collect()}
    rng = random.Random(5)
    made = [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(300)]
    odd = [None, "", "\n\n", " a\x0bb\x0cc\r\n", "x\nx\n x\nx", "  a", "a " * 60_000, "w" * 200_000, "a b c d e a b c d e", "1 2 3 4 5 6"]
    frame = spark.createDataFrame(list(enumerate(odd + made)), "doc_id long, text string").selectExpr("*", "'x' as found", "1 as n_words", "2 as t", "3 as _h")
    assert rows_of(quality.base_rules(frame)) == {i: brute_base(t) for i, t in enumerate(odd + made)}
    assert quality.base_rules(frame.limit(0)).count() == 0


def buckets(spark, grams, n):
    frame = spark.createDataFrame([(list(g),) for g in grams], "g array<string>")
    one, two = (F.xxhash64(F.get("g", F.lit(i))) for i in (0, 1))
    cell = F.when(F.size("g") == 1, one).otherwise(one.bitwiseXOR(F.shiftleft(two, 1))).bitwiseAND(F.lit(n - 1))
    return dict(zip(grams, (r.b for r in frame.select(cell.alias("b")).collect()), strict=True))


@pytest.mark.parametrize("inline", [1 << 21, 0])
def test_scores_match_brute_force(spark, sf, inline):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame([(None, None, "x"), (-5, "", "x"), (-6, "one two " * 30_000, "x")], "doc_id long, text string, source string"))
    model = quality.train(docs, labels, inline_buckets=inline)
    n = model.n_buckets
    assert n == quality.buckets_for(sum(len((r.text or "").encode()) for r in docs.collect())) and n > quality.buckets_for(100)
    texts = {r.doc_id: re.findall(r"(?:[^\W])+|[^\w\s]+", r.text or "") for r in docs.collect()}
    grams = {d: [(t,) for t in x] + list(zip(x, x[1:], strict=False)) for d, x in texts.items()}
    of = buckets(spark, sorted({g for x in grams.values() for g in x}), n)
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) == 0
    known = {r.doc_id: r for r in labels.withColumn("held", held_out).collect()}
    good = {d for d, r in known.items() if r.quality == 1 and not r.toxic and not r.held}
    raw, trusted = Counter(range(n)), Counter(range(n))
    for d, x in grams.items():
        for g in x:
            raw[of[g]] += 1
            trusted[of[g]] += d in good
    n_raw, n_good = sum(raw.values()), sum(trusted.values())
    weight = {b: max(-63, min(63, round(16 * (math.log(trusted[b] / n_good) - math.log(raw[b] / n_raw))))) for b in set(of.values())}
    want = {d: (len(x), sum(weight[of[g]] for g in x)) for d, x in grams.items()}
    judged = quality.judge(docs, labels, inline_buckets=inline)
    got = {r.doc_id: (r.n_grams, r.score) for r in judged.collect()}
    assert got.keys() == want.keys() and all(got[d][0] == w[0] and abs(got[d][1] - w[1]) <= w[0] for d, w in want.items())  # logarithms may round apart
    base = rows_of(judged)
    kept = {r.doc_id for r in judged.where("kept").collect()}
    assert kept == {d for d, (k, s) in got.items() if not base[d][5] and (model.threshold is None or s >= model.threshold * k)}
    stage = quality.keep_good(docs.withColumn("score", F.lit("clash")).withColumn("h", F.lit(1)), labels, inline_buckets=inline)
    assert {r.doc_id for r in stage.collect()} == kept and stage.columns == [*docs.columns, "score", "h"]


def test_agrees_with_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    unseen = labels.where("doc_id % 2 = 1")
    judged = quality.judge(docs, labels.where("doc_id % 2 = 0")).join(unseen, "doc_id").where("n_words >= 40")
    row = judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n"))
    share = {r.quality: r.kept for r in row.collect()}
    assert share[1] > 0.95 and share[0] < 0.05


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (None, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()} == {1: True, 2: False, None: False}
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0


def brute_threshold(rows):
    mean = [(good, score / n) for good, n, score in rows if n]
    good, bad = (sorted(m for g, m in mean if g is x) for x in (True, False))
    if not good or not bad:
        return None
    places = sorted({*good, *bad})
    cuts = [(places[0] - 1, 0.0)] + [((a + b) / 2, b - a) for a, b in zip(places, places[1:], strict=False)]
    wrong = [sum(m < c for m in good) * len(bad) - sum(m < c for m in bad) * len(good) for c, _ in cuts]
    return min(zip(wrong, (-gap for _, gap in cuts), (c for c, _ in cuts), strict=True))[2]


def test_threshold_matches_brute_force(spark):
    rng = random.Random(7)
    for n in (0, 1, 2, 3, 40, 400):
        for least in (-30, 5):  # the classes lie apart, or good ones below bad ones
            rows = [(good, k := rng.randrange(30), k * rng.randrange(-60, 30) + (least * k if good else 0)) for good in (rng.random() < 0.7 for _ in range(n))]
            frame = spark.createDataFrame(rows, "good boolean, n_grams long, score long").repartition(7)
            assert quality._threshold(frame) == brute_threshold(rows)


def many_held_out(spark):
    """Documents, labels and facts: over 2,000 held-out good documents have the smallest hashes and a text of their own."""
    held_out, late = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(4)) == 0, F.xxhash64("id", F.lit(12)) > 0
    rare = F.when(held_out, late).otherwise(F.col("id") % 5 == 0)
    kind = F.when(F.col("id") % 10 == 0, "bad").when(rare, "rare").otherwise("usual")
    of = spark.range(24_000).select(F.col("id").alias("doc_id"), kind.alias("kind"), held_out.alias("held_out"))
    docs = of.select("doc_id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat("kind", i.cast("string"))), " ").alias("text"))
    docs = docs.unionByName(docs.where("doc_id % 40 = 1").withColumn("text", F.lit("an id with two texts")))
    labels = of.select("doc_id", (F.col("kind") != "bad").cast("int").alias("quality"), F.lit(0).alias("toxic"))
    assert of.where("held_out and kind = 'usual'").count() > 2_000 < of.where("held_out and kind = 'rare'").count()
    return docs, labels, of


def test_threshold_is_fitted_on_every_held_out_document(spark):
    docs, labels, of = many_held_out(spark)
    judged = quality.judge(docs, labels).join(of, "doc_id").cache()
    rows = judged.where("held_out").select(F.col("kind") != "bad", "n_grams", "score").collect()
    assert quality.train(docs, labels).threshold == brute_threshold([tuple(r) for r in rows])
    assert judged.where("n_words = 12 and kept != (kind != 'bad')").isEmpty()
