"""The additive quality model: numbers against a plain count, tables against their definition, accuracy on held-out rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import additive

TEXTS = [None, "", " \n\t", "one", "a b c d e f a b c d e", "SHOUT!! OUT!! LOUD!!", "x | y | z.\nx | y | z.\n", "Grüße %%% an*** alle\r\nGrüße", "w " * 3_000 + "end.", "k" * 40]


def brute(text):
    """A few of the numbers, counted plainly."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    if not words:
        return {n: 0.0 for n in ("words", "distinct", "commonest", "doubled", "repeated_windows", "shouted", "equal_lines")}
    n, seen = len(words), Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + j for i in range(n - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.encode().split(b"\n") if x.strip()]
    return {
        "words": np.log1p(n),
        "distinct": len(set(words)) / n,
        "commonest": max(Counter(words).values()) / n,
        "doubled": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "repeated_windows": len(inside) / n,
        "shouted": sum(len(w) > 1 and w.isupper() for w in words) / n,
        "equal_lines": 1 - len(set(lines)) / len(lines),
    }


@pytest.mark.parametrize("piece", [8, 1 << 20])
def test_numbers_match_a_plain_count(monkeypatch, sf, spark, piece):
    monkeypatch.setattr(additive, "PIECE", piece)
    texts = [t or "" for t in TEXTS] + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    for text in texts:
        got = dict(zip(additive.NUMBERS, additive.measure(text.encode()), strict=True))
        for name, value in brute(text).items():
            assert got[name] == pytest.approx(value), (name, text[:50])
        assert all(np.isfinite(v) for v in got.values())


def test_tree_takes_the_best_cuts():
    g, h = np.array([4.0, 4.0, -6.0, -6.0, 1.0]), np.full(5, 2.0)
    gains = {}
    for a in range(1, 5):
        for b in range(a + 1, 5):
            gains[a, b] = sum(g[i:j].sum() ** 2 / (h[i:j].sum() + 1) for i, j in ((0, a), (a, b), (b, 5)))
    a, b = max(gains, key=gains.get)
    want = np.concatenate([np.full(j - i, -g[i:j].sum() / (h[i:j].sum() + 1)) for i, j in ((0, a), (a, b), (b, 5))])
    assert np.allclose(additive.tree(g, h), want)


def test_pairs_learn_what_single_numbers_cannot():
    rng = np.random.default_rng(5)
    x = rng.random((2_000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    alone, model = additive.learn(x, y, n_pairs=0), additive.learn(x, y)
    right = lambda m: float(((m.score(x) > 0.5) == y).mean())
    assert right(alone) < 0.75 and right(model) > 0.95 and model.pairs[0] == (0, 1)
    # A score is nothing but looked-up bins.
    for row in x[:20]:
        total = model.intercept + sum(t[int((e <= v).sum())] for t, e, v in zip(model.tables, model.edges, row, strict=True))
        total += sum(t[int((model.coarse[i] <= row[i]).sum()), int((model.coarse[j] <= row[j]).sum())] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert model.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_accuracy_on_rows_never_learned_from(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in additive.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 50 and all((r.predicted == 1) == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert np.mean([r.predicted == q for r, q in held]) > 0.95
    # Neither the labels of held-out rows nor any other column change a score.
    turned = labels.withColumn("quality", F.when(additive.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(1))
    again = additive.classify(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("s")), turned).collect()
    assert {r.doc_id: r.score for r in again} == {d: r.score for d, r in got.items()}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "one")], "doc_id long, text string").selectExpr("*", "1 as x", "2 as score", "3 as y", "4 as id")
    labels = spark.createDataFrame([(3, 1, 5), (3, 0, 5), (4, 1, 5), (5, 0, 5), (None, 0, 5), (6, None, 5), (99, 1, 5)], "doc_id long, quality int, y int")
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = additive.classify(docs, some).collect()
        assert len(rows) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in rows)
        assert [r.held_out for r in rows if r.doc_id is None] == [True]
    assert {r.score for r in additive.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert additive.classify(docs.limit(0), labels).count() == 0
