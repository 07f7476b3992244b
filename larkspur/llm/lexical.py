"""Ranked lexical search over a two-level quantised index.

The index is a table of blocks of whole documents, each a small inverted file: for every term its documents, their counts
and one byte each. That byte is the share that a count gets of its term's weight, divided by a fixed step and rounded
upward, so ``step * byte`` is never less than the share, and the share always more than ``step * (byte - 1)``. Postings never
leave the task that read the text; only the number and total length of all documents must be known before, from one count.

A search reads the bytes first: sums of bytes times weights give every document an upper and a lower bound, and each item
its k-th largest lower bound. Then every document whose upper bound reaches that is scored again from the exact counts, in
64-bit integers. No document of the answer is missed: its score is at least the k-th lower bound, and its upper bound at
least its score. Items are taken in blocks of about ``block_items``, so the accumulators are bounded; postings are added up
``ELEMENTS`` at a time.

Memory does not follow the size of the files: texts and blocks reach Python in batches of bounded bytes, and the stored index
has row groups of about ``GROUP_BYTES``, since a reader may hold a row group at once. The documents, counts and bytes of a
block's postings are three binary values, not arrays, whose elements take several times as much when read.

Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased. Null and
blank texts have none: such documents count nowhere and match nothing, such items have no rows. Items of one id are one
item with the terms of all its rows; a null id is an id. Every document row is a document of its own, also if ids or texts
repeat; equal scores are ordered by id, null ids last. Very long texts are read in whole, a block of its own each. Empty
tables give an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import cut, limit_batches, shared_path, small

#: Bytes of terms: A-Z become small letters, what separates terms becomes a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: A share is under ``WHOLE``; 255 steps cover it.
WHOLE = 1_000_000
STEP = -(-WHOLE // 255)
ELEMENTS = 1 << 18
#: Bytes of a row group of the index, and the options with which its writer looks at them after every row.
GROUP_BYTES = 4 << 20
STORED = {"parquet.block.size": str(GROUP_BYTES), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(_FOLD).split()


def norm(length: int, n_docs: int, n_total: int) -> int:
    """A document's m."""
    return 25 + 75 * length * n_docs // n_total


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1_000 * tf + 8 * m)


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all spans, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as planes of bytes, the lowest bytes first, as many as the largest number needs."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(planes: np.ndarray, n: int) -> np.ndarray:
    """The n numbers of such planes."""
    out = np.zeros(n, np.int64)
    for i in range(0, len(planes), max(1, n)):
        out |= planes[i : i + n].astype(np.int64) << 8 * (i // n)
    return out


@dataclass(frozen=True)
class Index:
    """Where the blocks lie, and the counts of all documents that their bytes rest on."""

    path: str
    n_docs: int
    n_total: int


def build(docs: DataFrame, path: str | None = None, block_docs: int = 512, block_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every row of docs under path; a block has at most 32,767 documents."""
    spark = docs.sparkSession
    limit_batches(spark)
    block_docs = min(block_docs, (1 << 15) - 1)
    path = path or shared_path(spark, "lexical-index")
    plain = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(terms(text.as_buffer().to_pybytes())) for text in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"n_docs": [sum(map(bool, sizes))], "n_total": [sum(sizes)]})

    totals = plain.select("text").mapInArrow(count, "n_docs long, n_total long").agg(F.sum("n_docs"), F.sum("n_total")).first()
    n_docs, n_total = totals[0] or 0, totals[1] or 0
    ids, longs = docs.schema[id_col].dataType, T.ArrayType(T.LongType())
    schema = T.StructType(
        [
            T.StructField("doc_ids", T.ArrayType(ids)),
            T.StructField("lengths", longs),
            T.StructField("terms", T.ArrayType(T.BinaryType())),
            T.StructField("dfs", T.ArrayType(T.IntegerType())),
            T.StructField("docs", T.BinaryType()),
            T.StructField("tfs", T.BinaryType()),
            T.StructField("impacts", T.BinaryType()),
        ]
    )

    def block(held: list, kind: pa.DataType) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        numbers, counts, sizes, lengths, m = [], [], [], [], []
        for _, found, length in held:
            numbers.extend(number.setdefault(t, len(number)) for t in found)
            counts.extend(found.values())
            sizes.append(len(found))
            lengths.append(length)
            m.append(norm(length, n_docs, n_total) if n_total else 25)
        which, tf = np.array(numbers, np.int64), np.array(counts, np.int64)
        doc = np.repeat(np.arange(len(held), dtype=np.int16), sizes)
        order = np.argsort(which, kind="stable")
        doc, tf = doc[order], tf[order]
        impact = (-(-share(tf, np.array(m, np.int64)[doc]) // STEP)).astype(np.uint8) if len(tf) else np.zeros(0, np.uint8)
        row = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays(
            [
                row(pa.array([h[0] for h in held], kind)),
                row(pa.array(lengths, pa.int64())),
                row(pa.array(list(number), pa.binary())),
                row(pa.array(np.bincount(which, minlength=len(number)).astype(np.int32))),
                *(pa.array([x], pa.binary()) for x in (packed(doc), packed(tf), impact.tobytes())),
            ],
            names=schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size, kind = 0, None
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms(text.as_buffer().to_pybytes())
                held.append((doc_id, Counter(words), len(words)))
                size += len(text.as_buffer())
                if len(held) >= block_docs or size >= block_bytes:
                    yield block(held, kind)
                    held, size = [], 0
        if held:
            yield block(held, kind)

    plain.mapInArrow(run, schema).write.options(**STORED).parquet(path)
    return Index(path, n_docs, n_total)


@dataclass(frozen=True)
class Asked:
    """A block of items: for each of their terms, the items that hold it and their repeats times the term's weight."""

    items: list
    number: dict[bytes, int]
    starts: np.ndarray
    item: np.ndarray
    weight: np.ndarray


def asked(rows: list, index: Index) -> Asked:
    """Pack rows of item_id, term, repeats and df."""
    items = list(dict.fromkeys(r["item_id"] for r in rows))
    nth = {x: i for i, x in enumerate(items)}
    number: dict[bytes, int] = {}
    rows = sorted(rows, key=lambda r: (number.setdefault(bytes(r["term"]), len(number)), nth[r["item_id"]]))
    which = np.array([number[bytes(r["term"])] for r in rows], np.int64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(number)))])
    weight = [r["repeats"] * math.floor(1_000 * math.log((2 * index.n_docs + 2) / (2 * r["df"] + 1))) for r in rows]
    return Asked(items, number, starts, np.array([nth[r["item_id"]] for r in rows], np.int64), np.array(weight, np.int64))


def _matches(block: dict, query: Asked, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some postings at a time: item times n plus document, weight, and position of the posting in the block."""
    dfs = block["dfs"]
    begins = np.cumsum(dfs) - dfs
    q = np.fromiter((query.number.get(t, -1) for t in block["terms"]), np.int64, len(dfs))
    local = np.flatnonzero(q >= 0)
    q = q[local]
    holders = query.starts[q + 1] - query.starts[q]
    size = np.cumsum(dfs[local] * holders)
    for some in np.split(np.arange(len(local)), np.unique(np.searchsorted(size, np.arange(ELEMENTS, int(size[-1]) if len(size) else 0, ELEMENTS), side="right"))):
        if not len(some):
            continue
        posting = _spans(begins[local[some]], dfs[local[some]])
        of = np.repeat(some, dfs[local[some]])
        often = holders[of]
        pair = _spans(query.starts[q[of]], often)
        at = np.repeat(posting, often)
        yield query.item[pair] * n + block["docs"][at], query.weight[pair], at


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            out = {}
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                value = column[i]
                if name in ("docs", "tfs", "impacts"):
                    out[name] = np.frombuffer(value.as_buffer(), np.uint8)
                else:
                    out[name] = value.values if name == "doc_ids" else value.values.to_pylist() if name == "terms" else value.values.to_numpy(zero_copy_only=False)
            yield out | {name: unpacked(out[name], len(out["impacts"])) for name in ("docs", "tfs") if name in out}


def _sums(block: dict, query: Asked, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item and document: the sum of weights times bytes, and the sum of weights. Both stay below 2**53."""
    cells = len(query.items) * n
    high, weights = np.zeros(cells), np.zeros(cells)
    for cell, weight, at in _matches(block, query, n):
        high += np.bincount(cell, weight * block["impacts"][at], cells)
        weights += np.bincount(cell, weight, cells)
    return high.astype(np.int64), weights.astype(np.int64)


def _lowest(blocks: DataFrame, query, k: int) -> dict[int, int]:
    """Each item's k-th largest lower bound; items with fewer documents have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for block in _blocks(batches):
            mine, n = query.value, len(block["lengths"])
            high, weights = _sums(block, mine, n)
            low = (STEP * (high - weights) + weights).reshape(len(mine.items), n)
            best = low if best is None else np.concatenate([best, low], axis=1)
            if best.shape[1] > k:
                best = np.partition(best, best.shape[1] - k, axis=1)[:, -k:]
        if best is not None:
            item, _ = np.nonzero(best > 0)
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(best[best > 0])], names=["item", "low"])

    lows = blocks.select("lengths", "terms", "dfs", "docs", "impacts").mapInArrow(run, "item int, low long")
    ranked = lows.withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))).where(F.col("nth") <= k)
    return {r["item"]: r["low"] for r in ranked.where(F.col("nth") == k).collect()}  # a row for each item of the block


def _rescored(blocks: DataFrame, query, floor: np.ndarray, k: int, index: Index) -> DataFrame:
    """Rows of item, doc_id and exact score: the k best of every block among the documents whose upper bound reaches the floor."""
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", blocks.schema["doc_ids"].dataType.elementType), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            mine, n = query.value, len(block["lengths"])
            high, _ = _sums(block, mine, n)
            reaches = STEP * high >= np.repeat(floor, n)
            m = np.array([norm(int(x), index.n_docs, index.n_total) for x in block["lengths"]], np.int64)
            score = np.zeros(len(reaches), np.int64)
            for cell, weight, at in _matches(block, mine, n):
                some = reaches[cell]
                cell, weight, at = cell[some], weight[some], at[some]
                np.add.at(score, cell, weight * share(block["tfs"][at], m[block["docs"][at]]))
            found = np.flatnonzero(score >= np.repeat(floor, n))
            item, doc = np.divmod(found, n)
            place = np.empty(n, np.int64)
            place[pc.sort_indices(block["doc_ids"]).to_numpy()] = np.arange(n)  # null ids last
            order = np.lexsort((place[doc], -score[found], item))
            found, item, doc = found[order], item[order], doc[order]
            first = np.searchsorted(item, item, side="left")
            keep = np.arange(len(item)) - first < k
            yield pa.RecordBatch.from_arrays([pa.array(item[keep].astype(np.int32)), block["doc_ids"].take(pa.array(doc[keep])), pa.array(score[found[keep]])], names=schema.names)

    return blocks.mapInArrow(run, schema)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows of item_id, term and repeats."""
    schema = T.StructType([T.StructField("item_id", items.schema[id_col].dataType), T.StructField("term", T.BinaryType()), T.StructField("repeats", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                found = Counter(terms(text.as_buffer().to_pybytes()))
                ids = batch.column(0).take(pa.array(np.full(len(found), i)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=schema.names)

    plain = items.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    return plain.mapInArrow(run, schema).groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats"))


def search(index: Index, items: DataFrame, k: int = 10, block_items: int = 1_024, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows of item_id, rank, doc_id and score: the k best documents of every item."""
    spark = items.sparkSession
    limit_batches(spark)
    blocks = spark.read.parquet(index.path)
    pairs = cut(item_terms(items, id_col, text_col))
    vocabulary = small(cut(pairs.select("term").distinct()))
    held = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    df = held.join(vocabulary, "term").groupBy("term").agg(F.sum("df").alias("df"))
    n_blocks = -(-pairs.select("item_id").distinct().count() // block_items)
    weighed = cut(pairs.join(df, "term").withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, n_blocks)))))
    found = None
    for nth in range(n_blocks):
        query = asked(weighed.where(F.col("block") == nth).collect(), index)  # about block_items items
        if not query.items:
            continue
        sent = spark.sparkContext.broadcast(query)
        low = _lowest(blocks, sent, k)
        floor = np.array([max(1, low.get(i, 1)) for i in range(len(query.items))], np.int64)
        names = spark.createDataFrame(list(enumerate(query.items)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", pairs.schema["item_id"].dataType)]))
        best = _rescored(blocks, sent, floor, k, index).withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
        part = cut(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = pairs.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(blocks.schema["doc_ids"].dataType.elementType).alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return found


#: Every document that shares a term with an item is scored in full.
ORACLE_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), totals AS (
  SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_total FROM d
), q AS MATERIALIZED (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), tf AS MATERIALIZED (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term
), part AS MATERIALIZED (
  SELECT tf.r, tf.term, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * len(d.terms) * n_docs) // n_total))) AS part FROM tf JOIN w USING (term) JOIN d USING (r), totals
), scored AS (
  SELECT q.item_id, p.r, CAST(sum(q.repeats * p.part) AS BIGINT) AS score FROM q JOIN part p USING (term) GROUP BY ALL HAVING sum(q.repeats * p.part) > 0
), ranked AS (
  SELECT s.item_id, row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, d.doc_id NULLS LAST) AS rank, d.doc_id, s.score FROM scored s JOIN d USING (r)
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
