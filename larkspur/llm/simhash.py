"""SimHash near-duplicate classes by bit-sliced comparison.

Fingerprints are made where the texts lie. Equal fingerprints are one class from then on, so copies cost nothing.
Two fingerprints within radius r agree on at least b - r of b equal bit ranges: every choice of b - r ranges is a
table of buckets, and any pair within the radius meets in one of them. Inside a bucket the fingerprints are stored
as 64 vertical bit planes; a fingerprint is compared with those after it in blocks of 64 lanes, by XOR and carry-save
counters, and a block is abandoned as soon as every lane exceeds the radius (:mod:`larkspur.llm.bitslice`). A bucket
returns the edges of a spanning forest, never its pairs. Components are found by alternating large-star and small-star
steps over the edges, with the edges kept in the shared folder between rounds.

For radius 2, a bucket above ``bucket_limit`` different fingerprints is not compared there: its members get, besides
their own, the keys with one bit flipped, and two of them share a key exactly if they are within the radius. That way is
linear in the bucket. For other radii such a bucket is dealt into parts that meet two by two. No link is lost either way.

Texts that are null or blank have fingerprint 0 and link like any other. Very long texts are read in whole, a chunk of
shingles at a time. Rows with the same id are separate rows; the class id is the smallest id of the class, ignoring null
ids. An empty table gives an empty result. Other columns, whatever their names, are ignored.

A radius of two bits of 64 connects texts that hardly differ. The pipeline's stage asks for a Jaccard similarity of
0.8 instead (:func:`larkspur.llm.near_text.keep_first`), compared by the same bit slices with exact radii.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.bitslice import Work, forest, hits, later, planes_of
from larkspur.llm.common import cut

BITS, CHUNK = 64, 1 << 15


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The 64-bit majority fingerprint of a UTF-8 text's word shingles, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(n, at + CHUNK) + width - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        hashes = np.fromiter((xxh64_intdigest(s, seed) for s in joined), np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of doc_id and fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(np.array(marks, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def bucket_edges(marks: np.ndarray, bounds: np.ndarray, radius: int, work: Work | None = None, rows: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs within the radius in each bucket; bucket i is marks[bounds[i]:bounds[i + 1]], of different fingerprints.

    Fingerprints meet only those after them, in blocks of 64 lanes. About ``rows`` blocks are compared at once.
    """
    n = len(marks)
    planes, label = planes_of(marks[:, None]), np.arange(n)
    last = np.repeat(bounds[1:], np.diff(bounds))
    lane = np.arange(n)
    count = np.where(lane + 1 < last, (last - 1) // 64 - (lane + 1) // 64 + 1, 0)
    ends = np.cumsum(count)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + rows, "right")))
        of = np.repeat(lane[at:upto], count[at:upto])
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count[at:upto]) - count[at:upto], count[at:upto])
        word = (of + 1) // 64 + nth
        block, bit = hits(planes, marks[of][:, None], word, later(word, of, last[of]), np.full(len(of), radius), work=work)
        label = forest(label, of[block], word[block] * 64 + bit)
        at = upto
    child = np.nonzero(label != lane)[0]
    return marks[child], marks[label[child]]


def _bucket_edges(radius: int):
    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            a, b = bucket_edges(np.concatenate(held), np.cumsum([0, *map(len, held)]), radius)
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_marks, held, n = None, [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column(0))
            marks = np.asarray(batch.column(1)).view(np.uint64)
            starts = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]])
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if keys[a] != open_key:
                    if open_marks:
                        held.append(np.concatenate(open_marks))
                        n += len(held[-1])
                    open_key, open_marks = keys[a], []
                open_marks.append(marks[a:b])
            if n > 50_000:
                yield from flush(held)
                held, n = [], 0
        if open_marks:
            held.append(np.concatenate(open_marks))
        yield from flush(held)

    return run


def split_crowded(rows: DataFrame, limit: int, by: str) -> DataFrame:
    """rows with a key and the bucket's size n: those of larger buckets are dealt into parts of about half the limit, and each two parts meet under a key of their own.

    Any two rows of a bucket still meet, and no bucket is much larger than the limit.
    """
    parts = F.ceil(F.col("n") * 2 / limit).cast("int")
    mine = F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")
    crowded = rows.where(F.col("n") > limit).withColumn("_parts", parts).withColumn("_other", F.explode(F.expr("sequence(0, _parts - 1)")))
    met = crowded.withColumn("key", F.xxhash64("key", F.least(mine, F.col("_other")), F.greatest(mine, F.col("_other")))).drop("_parts", "_other", "n")
    return rows.where(F.col("n") <= limit).drop("n").unionByName(met)


def links(marks: DataFrame, radius: int = 2, ranges: int | None = None, bucket_limit: int = 16_384) -> DataFrame:
    """Edges (u, v) between different fingerprints whose components are those of all pairs within the radius. marks: distinct fp."""
    ranges = radius + 2 if ranges is None else ranges
    width, keys = BITS // ranges, []
    for t, chosen in enumerate(combinations(range(ranges), ranges - radius)):
        kept = [F.shiftrightunsigned("fp", r * width).bitwiseAND(F.lit((1 << width) - 1)) for r in chosen]
        keys.append(F.xxhash64(F.lit(t), *kept))
    rows = marks.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(sizes, "key")
    if radius == 2:
        near = shared.where(F.col("n") <= bucket_limit).drop("n")
    else:
        near = split_crowded(shared, bucket_limit, "fp")
    sliced = near.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    edges = sliced.mapInArrow(_bucket_edges(radius), "u long, v long")
    if radius != 2:
        return edges
    crowded = shared.where(F.col("n") > bucket_limit).select("fp").distinct()
    flips = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    spread = crowded.select("fp", F.explode(flips).alias("key"))
    roots = spread.groupBy("key").agg(F.min("fp").alias("root"), F.count("*").alias("n")).where("n > 1").drop("n")
    far = spread.join(roots, "key").where("fp != root").select(F.col("fp").alias("u"), F.col("root").alias("v"))
    return edges.unionByName(far)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the smallest node of its component) of every node that has an edge."""
    edges = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        seen = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (seen["n"], seen["x"]) == state or not seen["n"]:
            break
        state = (seen["n"], seen["x"])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(roots, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(roots.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return nodes


def near_duplicates(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fp, fingerprint (hexadecimal) and component_id."""
    marked = cut(fingerprints(docs, id_col, text_col))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tied = components(links(classes.select("fp"), radius))
    rooted = classes.join(tied, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_mark = rooted.join(named, "root").select(F.col("fp").alias("of"), "component_id")
    out = marked.join(by_mark, F.col("fp") == F.col("of"))
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
