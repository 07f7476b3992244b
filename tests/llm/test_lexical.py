"""Two-level search against scoring every document in full."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from larkspur.llm import lexical
from larkspur.llm.common import ARROW_BYTES, BATCH_BYTES

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def brute(docs, items, k):
    split = lambda t: PATTERN.findall((t or "").translate(LOWER))
    held = [(d, Counter(split(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, Counter()).update(split(t))
    out = []
    for item, asked in wanted.items():
        scored = []
        for d, c in held:
            score = 0
            for t, often in asked.items():
                if c[t]:
                    m = 25 + 75 * c.total() * n_docs // total
                    score += often * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score:
                scored.append((-score, d is None, d or 0))
        out += [(str(item), rank, str(None if none else d), -s) for rank, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def rows_of(frame):
    return sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in frame.collect())


@pytest.mark.parametrize(("block_docs", "block_bytes", "block_items", "elements"), [(1_024, 4 << 20, 1_024, 1 << 20), (7, 4 << 20, 9, 50), (64, 3_000, 100, 1 << 20)])
def test_search_matches_brute_force(spark, sf, monkeypatch, tmp_path, block_docs, block_bytes, block_items, elements):
    monkeypatch.setattr(lexical, "ELEMENTS", elements)
    odd = [(None, "and the and"), (None, None), (900, ""), (901, "!!! ---"), (902, "ÉTÉ été Été"), (903, "the " * 50_000), (5, "and then"), (5, "and then")] + [(1_000 + i, "copy of the same words and more") for i in range(60)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("terms", F.lit("clash")).withColumn("score", F.lit(1))
    asked = [(None, "copy words"), (500, None), (501, "?"), (502, "été and AND the the"), (503, "zzzz qqqq"), (504, "same"), (504, "same copy")]
    items = spark.read.parquet(f"{sf}/benchmark.parquet").unionByName(spark.createDataFrame(asked, "item_id long, text string")).withColumn("rank", F.lit("clash")).withColumn("doc_id", F.lit(1))
    index = lexical.build(docs, str(tmp_path / "index"), block_docs, block_bytes)
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], 10)
    assert rows_of(lexical.search(index, items, 10, block_items)) == want
    held = spark.read.parquet(index.path)
    assert held.selectExpr("sum(size(doc_ids))").first()[0] == docs.count()


def test_bytes_bound_the_shares():
    tf, m = np.meshgrid(np.array([1, 2, 3, 10, 1_000, 10**8]), np.array([25, 26, 100, 1_000, 10**7]))
    share = lexical.share(tf.ravel(), m.ravel())
    byte = -(-share // lexical.STEP)
    assert byte.max() <= 255 and (lexical.STEP * byte >= share).all() and (lexical.STEP * (byte - 1) < share).all()
    assert lexical.share(np.array([10**9]), np.array([25]))[0] < lexical.WHOLE


def test_only_documents_that_reach_the_bound_are_scored_again(spark, sf, tmp_path, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    index = lexical.build(docs, str(tmp_path / "index"))
    blocks = list(lexical._blocks(iter(spark.read.parquet(index.path).toArrow().to_batches())))
    pairs = lexical.item_terms(items)
    df = spark.read.parquet(index.path).select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
    query = lexical.asked(pairs.join(df, "term").collect(), index)
    reached = touched = 0
    for block in blocks:
        n = len(block["lengths"])
        high, weights = (a.reshape(len(query.items), n) for a in lexical._sums(block, query, n))
        low = np.sort(lexical.STEP * (high - weights) + weights, axis=1)[:, -10]
        reached += int((lexical.STEP * high >= np.maximum(low, 1)[:, None]).sum())
        touched += int((high > 0).sum())
    assert 10 * len(query.items) <= reached < touched / 2


def test_empty_tables(spark, sf, tmp_path):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert lexical.search(lexical.build(docs.limit(0), str(tmp_path / "a")), items).count() == 0
    assert lexical.search(lexical.build(docs, str(tmp_path / "b")), items.limit(0)).count() == 0
    assert lexical.search(lexical.build(docs.withColumn("text", F.lit("--")), str(tmp_path / "c")), items).count() == 0


def test_memory_is_bounded_whatever_a_file_holds(spark, tmp_path):
    normal = spark.conf.get(ARROW_BYTES)
    chance = np.random.default_rng(1)
    texts = [(i, " ".join(f"{x:x}" for x in chance.integers(1 << 16, 1 << 28, 50_000).tolist())) for i in range(24)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, " ".join(t.split()[0] for _, t in texts))], "item_id long, text string")
    spark.conf.set(ARROW_BYTES, str(256 << 20))
    try:
        index = lexical.build(docs, str(tmp_path / "index"), block_bytes=1 << 18)
        spark.conf.set(ARROW_BYTES, str(256 << 20))
        assert lexical.search(index, items, 50).count() == 24
        read = spark.read.parquet(index.path)
        size = lambda batches: (pa.RecordBatch.from_pydict({"size": [b.nbytes]}) for b in batches)
        assert read.count() == 24 and read.mapInArrow(size, "size long").agg(F.max("size")).first()[0] < 2 * BATCH_BYTES
    finally:
        spark.conf.set(ARROW_BYTES, normal)
    for path in tmp_path.glob("index/*.parquet"):
        held = pq.ParquetFile(path).metadata
        assert all(held.row_group(i).total_byte_size < 2 * lexical.GROUP_BYTES for i in range(held.num_row_groups))


@pytest.mark.parametrize("values", [[], [0], [0, 255], [256, 1, 0], [65_535, 65_536, 7], [2**31 - 1, 0, 5, 2**40]])
def test_packed_numbers(values):
    planes = lexical.packed(np.array(values, np.int64))
    assert lexical.unpacked(np.frombuffer(planes, np.uint8), len(values)).tolist() == values
