"""Classes of texts whose word shingles have a Jaccard similarity of at least a given share, without losing a link.

Two sets with a similarity of t share one of the first n - ceil(t n) + 1 shingles in any common order, so these prefixes
are the bucket keys, rarest shingles first. Buckets of one text are dropped where they lie. The texts of a bucket are compared
by bit slices: fingerprints are parities of the shingles in 512 cells, two sets differ in at least as many shingles as
bits, and the largest difference that the similarity allows is the radius, so that what is abandoned cannot be similar.

What is left is a graph of pairs that may be similar. In a first round each bucket proposes a spanning forest of it, nearest
pairs first, never all pairs of a group of copies; these pairs are compared in full, and the similar ones joined to classes. In a
second round the texts with further pairs meet again, in buckets that still hold different classes, and all pairs
across classes are compared. Before a pair is compared in full, parities with a cell for each shingle are.

The order of the prefixes comes from counts of the shingles of all texts, in cells of their hashes; any order gives the same
links. Texts without words are alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.bitslice import hits, later, lightest, planes_of
from larkspur.llm.common import cut, limit_batches, small
from larkspur.llm.simhash import components, split_crowded

CELLS = 512
#: Cells in which shingles are counted, 8 MB of counts.
LOADS = 1 << 21
BITMAP = tuple(f"b{i}" for i in range(CELLS // 64))


def shingles(text: bytes, width: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's word shingles; a text of fewer words is one shingle, a blank one has none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter((xxh64_intdigest(s, seed) for s in joined), np.uint64))


def parities(held: np.ndarray) -> np.ndarray:
    """Packed parities of the hashes by their low bits, with at least a cell for each hash; halves XORed are those of half the cells."""
    cells = max(CELLS, 1 << (len(held) - 1).bit_length() if len(held) else 0)
    odd = np.bincount((held & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """Rows of mark and held (the shingles) for rows of mark and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t or b"", width).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["mark", "held"])

    return texts.select("mark", "text").mapInArrow(run, "mark long, held array<long>")


def _loads(width: int, cells: int, piece: int):
    """A function of batches of texts that gives (piece, load): the shingles in each cell, a row for each piece of the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros(cells, np.uint32)  # counted in place: nothing else of this size is held
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                np.add.at(load, (shingles(text.as_py() or b"", width) & np.uint64(cells - 1)).astype(np.intp), np.uint32(1))
        for i, x in enumerate(load.reshape(-1, min(piece, cells))):
            if x.any():
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["piece", "load"])

    return run


def _cell_counts(texts: DataFrame, width: int, cells: int = LOADS, piece: int = 1 << 13) -> np.ndarray:
    """How many shingles of all the texts, copies included, fall into each cell of their low bits; sums are made piece by piece."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(x, np.uint32)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["piece", "load"])

    kind = "piece int, load binary"
    found = texts.select("text").mapInArrow(_loads(width, cells, piece), kind).repartition("piece").mapInArrow(add, kind).toArrow()
    load = np.zeros((cells // min(piece, cells), min(piece, cells)), np.uint32)
    for i, x in zip(found.column(0).to_pylist(), found.column(1), strict=True):
        load[i] = np.frombuffer(x.as_py(), np.uint32)
    return load.ravel()


def _marked(texts: DataFrame, width: int, share: Fraction) -> DataFrame:
    """doc_id, text_hash, mark (of the words), size (of the shingle set), b0 to b7 and parity, and keys (the prefix; none for a mark that the task has met)."""
    load = _cell_counts(texts, width)

    def row(text: bytes, seen: set) -> tuple:
        from xxhash import xxh64_intdigest

        held = shingles(text, width)
        n = len(held)
        mark = xxh64_intdigest(b" ".join(text.lower().split()), 7) if n else 0
        parity = parities(held)
        bits = folded(parity, CELLS // 64)
        if mark in seen:
            held, n_keys = held[:0], 0
        else:
            seen.add(mark)
            n_keys = n - math.ceil(share * n) + 1 if n else 0
            held = held[np.argsort(load[(held & np.uint64(len(load) - 1)).astype(np.int64)], kind="stable")]
        return mark, n, *bits.view(np.int64), parity.tobytes(), held[:n_keys].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            rows = [row(t or b"", seen) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            marks = pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64))
            numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 2 + len(BITMAP))]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), marks, *numbers, pa.array([r[-2] for r in rows], pa.binary()), pa.array([r[-1] for r in rows], pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "mark", "size", *BITMAP, "parity", "keys"],
            )

    kind = texts.select("doc_id").dtypes[0][1]
    return texts.select("doc_id", "text_hash", "text").mapInArrow(run, f"doc_id {kind}, text_hash long, mark long, size long, {', '.join(f'{b} long' for b in BITMAP)}, parity binary, keys array<long>")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, mark), sorted and put together by key, those whose key has more than one mark, each once."""
    key = mark = np.zeros(0, np.int64)  # the last row met
    given = False  # whether it was given out
    for batch in batches:
        if not batch.num_rows:
            continue
        key, mark = np.concatenate([key, np.asarray(batch.column(0))]), np.concatenate([mark, np.asarray(batch.column(1))])
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])])
        key, mark = key[new], mark[new]
        same = key[1:] == key[:-1]
        out = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        was, out[0] = out[0], out[0] and not given
        yield pa.record_batch([pa.array(key[out]), pa.array(mark[out])], names=["key", "mark"])
        given = bool(out[-1]) if len(key) > 1 else given or bool(was)
        key, mark = key[-1:], mark[-1:]


def _candidates(key: np.ndarray, size: np.ndarray, mark: np.ndarray, root: np.ndarray, bits: np.ndarray, share: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(u, v, differing bits) of rows, sorted by key and size, of one key and different roots, that sizes and bits allow; some blocks at a time."""
    n, d = share.numerator, share.denominator
    bucket = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    far = int(size.max()) * 2 + 2
    last = np.searchsorted(bucket * far + size, bucket * far + size * d // n, "right")
    lane, planes = np.arange(len(key)), planes_of(bits)
    count = np.where(lane + 1 < last, (last - 1) // 64 - (lane + 1) // 64 + 1, 0)
    ends, at = np.cumsum(count), 0
    while at < len(key):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 15), "right")))
        of = np.repeat(lane[at:upto], count[at:upto])
        word = (of + 1) // 64 + np.arange(len(of)) - np.repeat(np.cumsum(count[at:upto]) - count[at:upto], count[at:upto])
        block, bit = hits(planes, bits[of], word, later(word, of, last[of]), np.minimum(size[of] * (d - n) // n, CELLS), step=32)
        u, v = of[block], word[block] * 64 + bit
        apart = np.bitwise_count(bits[u] ^ bits[v]).sum(axis=1, dtype=np.int64)
        good = (root[u] != root[v]) & (mark[u] != mark[v]) & (apart * (d + n) <= (size[u] + size[v]) * (d - n))
        yield u[good], v[good], apart[good]
        at = upto


def _buckets(compare, held_rows: int = 50_000):
    """A function of sorted batches that calls ``compare`` with the columns of about so many rows, of whole buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.asarray(c) for c in batch.columns]
            if n_held > held_rows:
                borders = np.nonzero(rows[0] != held[-1][0][-1])[0]
                if len(borders):  # a bucket is bounded, so one comes soon
                    yield compare(*(np.concatenate(c) for c in zip(*held, [x[: borders[0]] for x in rows], strict=True)))
                    held, n_held, rows = [], 0, [c[borders[0] :] for c in rows]
            held.append(rows)
            n_held += len(rows[0])
        if held:
            yield compare(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _pairs_of(mark: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([np.maximum(mark[u], mark[v]), np.minimum(mark[u], mark[v])]), axis=1)


def _nearest(share: Fraction):
    """Of rows (key, size, mark, b0 to b7): the pairs (u, v) of each bucket's forest, and (key, u) of the rows with further pairs."""

    def compare(key: np.ndarray, size: np.ndarray, mark: np.ndarray, *bits: np.ndarray) -> pa.RecordBatch:
        a = b = w = np.zeros(0, np.int64)
        met = np.zeros(len(key), np.int64)
        for u, v, apart in _candidates(key, size, mark, mark, np.stack(bits, axis=1).view(np.uint64), share):
            met += np.bincount(u, minlength=len(key)) + np.bincount(v, minlength=len(key))
            a, b, w = np.concatenate([a, u]), np.concatenate([b, v]), np.concatenate([w, apart])
            kept = lightest(len(key), a, b, w)
            a, b, w = a[kept], b[kept], w[kept]
        pairs = _pairs_of(mark, a, b)
        more = met > np.bincount(a, minlength=len(key)) + np.bincount(b, minlength=len(key))
        k = len(pairs[0])
        keys = pa.array(np.concatenate([np.zeros(k, np.int64), key[more]]), mask=np.arange(k + more.sum()) < k)
        return pa.record_batch([keys, pa.array(np.concatenate([pairs[0], mark[more]])), pa.array(np.concatenate([pairs[1], mark[more]]))], names=["key", "u", "v"])

    return _buckets(compare)


def _across(share: Fraction):
    """Of rows (key, size, mark, root, b0 to b7): all pairs (u, v) of different roots that may be similar."""

    def compare(key: np.ndarray, size: np.ndarray, mark: np.ndarray, root: np.ndarray, *bits: np.ndarray) -> pa.RecordBatch:
        found = [_pairs_of(mark, u, v) for u, v, _ in _candidates(key, size, mark, root, np.stack(bits, axis=1).view(np.uint64), share)]
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    return _buckets(compare)


def _alike(pairs: DataFrame, marked: DataFrame, texts: DataFrame, width: int, share: Fraction) -> DataFrame:
    """The pairs (u, v) whose sets of shingles are similar: first by parities with a cell for each shingle, then in full."""
    n, d = share.numerator, share.denominator

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for size, a, b in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                words = min(len(a), len(b))
                keep.append(int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum()) * (d + n) <= size * (d - n))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])

    def needed(of: DataFrame, *columns: str) -> DataFrame:
        marks = small(cut(of.select(F.explode(F.array("u", "v")).alias("mark")).distinct()))
        return marked.join(marks, "mark", "left_semi").groupBy("mark").agg(*(F.min(c).alias(c) for c in columns))

    parity = cut(needed(pairs, "size", "parity"))
    side = lambda x: parity.select(F.col("mark").alias(x), F.col("size").alias(f"_{x}"), F.col("parity").alias(f"_p{x}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", F.col("_u") + F.col("_v"), "_pu", "_pv")
    pairs = cut(both.mapInArrow(close, "u long, v long"))
    named = cut(needed(pairs, "text_hash").withColumnRenamed("text_hash", "_hash"))
    asked = texts.join(small(named), F.col("text_hash") == F.col("_hash")).select("mark", "text")
    # Equal texts give equal sets; one of them is compared.
    sets = cut(_shingle_sets(asked, width).groupBy("mark").agg(F.first("held").alias("held")))
    left, right = sets.select(F.col("mark").alias("u"), F.col("held").alias("_a")), sets.select(F.col("mark").alias("v"), F.col("held").alias("_b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(left, "u").join(right, "v").where(shared * (n + d) >= n * (F.size("_a") + F.size("_b"))).select("u", "v")


def similar(texts: DataFrame, similarity: float = 0.8, width: int = 5, bucket_limit: int = 2_048) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash and mark of each row of texts (doc_id, text_hash, text), and node and root of every mark that has a similar one."""
    share = Fraction(str(similarity))
    limit_batches(texts.sparkSession)
    marked = cut(_marked(texts, width, share))
    keyed = marked.select(F.explode("keys").alias("key"), "mark").repartition("key").sortWithinPartitions("key", "mark")
    shared = cut(keyed.mapInArrow(_shared, "key long, mark long"))
    facts = marked.groupBy("mark").agg(*(F.min(c).alias(c) for c in ("size", *BITMAP)))

    sizes = shared.groupBy("key").agg(F.count("*").alias("n"))
    rows = split_crowded(shared.join(sizes, "key"), bucket_limit, "mark").join(facts, "mark").select("key", "size", "mark", *BITMAP)
    near = cut(rows.repartition("key").sortWithinPartitions("key", "size", "mark").mapInArrow(_nearest(share), "key long, u long, v long"))
    first = cut(near.where("key is null").select("u", "v").distinct())
    edges = cut(_alike(first, marked, texts, width, share))
    roots = cut(components(edges))

    further = near.where("key is not null").select("key", F.col("u").alias("mark"))
    placed = further.join(roots, F.col("mark") == F.col("node"), "left").select("key", "mark", F.coalesce("root", "mark").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    open_rows = placed.join(mixed, "key").join(facts, "mark").select("key", "size", "mark", "root", *BITMAP)
    dealt = open_rows.repartition("key").sortWithinPartitions("key", "size", "mark")
    second = cut(dealt.mapInArrow(_across(share), "u long, v long").distinct().join(first, ["u", "v"], "left_anti"))
    if second.isEmpty():
        return marked.select("doc_id", "text_hash", "mark"), roots
    edges = edges.unionByName(_alike(second, marked, texts, width, share))
    return marked.select("doc_id", "text_hash", "mark"), cut(components(edges))


def keep_first(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each class of similar texts: the one with the smallest id (null ids last), then text hash.

    A class is what pairs with a Jaccard similarity of at least ``similarity`` over shingles of ``width`` words connect.
    Rows are known by id and text, never by the id alone: null and repeated ids lose or stay each for its own text. Texts
    without words (null, empty, blank) are one class. An empty table stays empty; further columns, whatever their names,
    are kept as they are. Very long texts are compared in full.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_row"))
    text, doc = F.col("_row")[text_col].cast("string"), F.col("_row")[id_col]
    hashed = lambda: F.xxhash64(text)
    texts = whole.select(doc.alias("doc_id"), hashed().alias("text_hash"), text.alias("text"))
    marked, roots = similar(texts, similarity, width)
    placed = cut(marked.join(roots, F.col("mark") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("root", "mark").alias("root")))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = placed.groupBy("root").agg(F.min(rank).alias("first")).withColumnRenamed("root", "of")
    lost = placed.join(first, F.col("root") == F.col("of")).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))))
    losers = cut(lost.select(F.col("doc_id").alias("_lost"), F.col("text_hash").alias("_hash")).distinct())
    kept = whole.join(small(losers), (hashed() == F.col("_hash")) & doc.eqNullSafe(F.col("_lost")), "left_anti")
    twice = cut(placed.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).count().where("count > 1").select("_id", "_text"))
    if twice.isEmpty():
        return kept.select("_row.*")
    same = doc.eqNullSafe(F.col("_id")) & (hashed() == F.col("_text"))
    once = kept.join(twice, same, "left_semi").withColumns({"_id": doc, "_text": text}).dropDuplicates(["_id", "_text"])
    return kept.join(small(twice), same, "left_anti").unionByName(once.select("_row")).select("_row.*")
