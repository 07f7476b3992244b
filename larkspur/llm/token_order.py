"""Token shards in training order: a keyed permutation of the documents' token sequences, written with a fixed stride.

Every row is one token sequence and gets the index of its place in the table: rows are counted by partition, and prefix sums of the counts plus the place
in the partition give the index. A keyed Feistel network over the smallest even number of bits, with cycle-walking,
maps the indexes one to one onto the slots 0 to N - 1; nothing is sorted to shuffle them. Shard s holds the slots from
s * docs_per_shard on. Rows go straight to the partition of their shard and are sorted by slot; the task encodes
them once, in order, ends each with an end id, and packs the ids into records of ``record_tokens`` ids, little-endian.
All records have the same size, so record r of a shard starts at byte r * stride, and a reader resumes by seeking.
Only the last record of a shard is filled up, with end ids. Sequences are whole documents of any length, so the place of a
slot takes two steps: its index row names the shard and the first token in it, and the record that holds that token is found by the
stride (:func:`read_from`).

A shard is written under a name of its own attempt and then moved to its final name. A task that runs again after a loss writes the
same bytes, so where the final name is taken already, its own file is dropped. The table must be a stored one (or have been cut), as its
rows are numbered in the order in which they lie; :func:`manifest` checks that every shard holds the sequences that its slots ask for, and
:func:`sweep` removes what lost attempts left.

Null and empty texts are sequences of the end id alone. Repeated rows are sequences of their own. Very long texts are one sequence,
encoded in the task that reads them. An empty table gives no shard and an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, limit_batches
from larkspur.llm.tokens import encoder, end_id, vocabulary

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and xor-shift."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of indexes below n, a bijection of range(n) chosen by key."""
    half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))

    def encrypt(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        return (left << half) | right

    out = encrypt(index.astype(np.uint64))
    while (beyond := out >= n).any():  # walk on; the domain is below four times n
        out[beyond] = encrypt(out[beyond])
    return out.astype(np.int64)


def with_slots(docs: DataFrame, key: int, column: str) -> tuple[DataFrame, int]:
    """docs with a slot for each row, and the number of rows."""
    place = F.monotonically_increasing_id()
    counts = docs.select(F.shiftright(place, 33).alias("part")).groupBy("part").count().collect()  # one row for each partition of the input
    starts, n = {}, 0
    for r in sorted(counts, key=lambda r: r["part"]):
        starts[r["part"]] = n
        n += r["count"]
    known = np.array(sorted(starts), np.int64)
    offsets = np.array([starts[p] for p in sorted(starts)], np.int64)

    @F.pandas_udf("long")
    def slot(places: pd.Series) -> pd.Series:
        p = places.to_numpy(np.int64)
        index = offsets[np.searchsorted(known, p >> 33)] + (p & ((1 << 33) - 1))
        return pd.Series(permute(index, n, key))

    return docs.withColumn(column, place).withColumn(column, slot(F.col(column))), n


def materialise(
    docs: DataFrame,
    path: str,
    key: int = 2024,
    docs_per_shard: int = 8_192,
    record_tokens: int = 2_048,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the shards below path; one row for each sequence: doc_id, slot, shard, first_token (its place in the shard), n_tokens with the end id, tokens_crc32.

    The shards are written when the result is computed.
    """
    ranks = vocabulary(tokenizer)
    limit_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    placed, n = with_slots(narrow, key, "slot")
    n_shards = max(1, -(-n // docs_per_shard))
    kind = narrow.dtypes[0][1]
    names = ["doc_id", "slot", "shard", "first_token", "n_tokens", "tokens_crc32"]
    code = "H" if end_id(ranks) < 1 << 16 else "I"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encode, end = encoder(ranks).encode_ordinary, end_id(ranks)
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        shard, file, written, name = None, None, 0, ""

        def close() -> None:
            if written % record_tokens:
                file.write(array(code, [end] * (record_tokens - written % record_tokens)).tobytes())
            file.close()
            final = f"{folder}/shard-{shard:07d}.bin"
            if store.get_file_info(final).type == fs.FileType.NotFound:
                store.move(name, final)
            else:
                store.delete_file(name)

        for batch in batches:
            firsts, counts, sums = [], [], []
            slots = batch.column(1).to_pylist()
            for slot, text in zip(slots, batch.column(2).to_pylist(), strict=True):
                if shard != slot // docs_per_shard:
                    if file:
                        close()
                    shard, written, name = slot // docs_per_shard, 0, f"{folder}/.part-{uuid4().hex}"
                    file = store.open_output_stream(name)
                ids = encode(text or "")
                ids.append(end)
                held = array(code, ids).tobytes()
                file.write(held)
                firsts.append(written)
                counts.append(len(ids))
                sums.append(zlib.crc32(held))
                written += len(ids)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([s // docs_per_shard for s in slots], pa.int64()), pa.array(firsts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                names=names,
            )
        if file:
            close()

    ordered = placed.repartitionById(n_shards, F.expr(f"cast(slot div {docs_per_shard} as int)")).sortWithinPartitions("slot")
    return ordered.select("doc_id", "slot", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:]))


def manifest(index: DataFrame, docs_per_shard: int = 8_192, record_tokens: int = 2_048) -> DataFrame:
    """One row for each shard of a materialised index: shard, first_slot, n_docs, n_tokens, n_records. ValueError where slots are missing or double."""
    shards = index.groupBy("shard").agg(F.min("slot").alias("first_slot"), F.max("slot").alias("_last"), F.count("*").alias("n_docs"), F.countDistinct("slot").alias("_slots"), F.sum("n_tokens").alias("n_tokens"))
    shards = cut(shards)
    end = shards.agg(F.max("shard")).first()[0]
    wanted = F.when(F.col("shard") == end, F.col("_last") + 1 - F.col("first_slot")).otherwise(docs_per_shard)
    whole = (F.col("n_docs") == wanted) & (F.col("_slots") == wanted) & (F.col("first_slot") == F.col("shard") * docs_per_shard)
    if shards.where(~whole).count() or end is not None and shards.count() != end + 1:
        raise ValueError("slots are missing or double")
    return shards.drop("_last", "_slots").withColumn("n_records", F.expr(f"(n_tokens + {record_tokens - 1}) div {record_tokens}"))


def sweep(path: str) -> int:
    """Remove the files that lost attempts left; the number removed. Only for use when no task writes."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path)
    left = [f.path for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.base_name.startswith(".part-")]
    for name in left:
        store.delete_file(name)
    return len(left)


def read_records(path: str, shard: int, first: int = 0, record_tokens: int = 2_048, id_bytes: int = 2) -> Iterator[np.ndarray]:
    """The records of a shard from record ``first`` on, by one seek and sequential reads."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path)
    stride = record_tokens * id_bytes
    with store.open_input_file(f"{folder}/shard-{shard:07d}.bin") as file:
        file.seek(first * stride)
        while block := file.read(stride):
            yield np.frombuffer(block, f"<u{id_bytes}")


def read_from(path: str, shard: int, first_token: int, record_tokens: int = 2_048, id_bytes: int = 2) -> Iterator[np.ndarray]:
    """The tokens of a shard from the sequence on whose index row has shard and first_token, a record at a time."""
    skip = first_token % record_tokens
    for record in read_records(path, shard, first_token // record_tokens, record_tokens, id_bytes):
        yield record[skip:]
        skip = 0
