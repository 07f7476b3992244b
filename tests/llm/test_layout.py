"""Mixing, sharding, token shards and edited counts against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from larkspur.llm import mixing, sharding, token_counts, token_order
from larkspur.llm.tokens import encoder, end_id, vocabulary

ODD = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (3, "one two", None), (4, "Grüße " * 3_000, "b"), (None, "x y z", "a"), (5, "p q r s", "a"), (6, "u v", "c")]


@pytest.fixture()
def odd(spark):
    frame = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return frame.selectExpr("*", "'clash' as shard", "1 as slot", "2 as pass", "3 as total", "4 as n_tokens")


def test_shards_match_brute_force(spark, sf, odd):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for docs, n in ((table, 40), (odd, 3), (odd, 40)):
        rows = sorted((-1 if r.doc_id is None else r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16) for r in docs.collect())
        total, run, want, slots = sum(r[2] for r in rows), 0, [], defaultdict(int)
        for doc, crc, size in rows:
            run += size
            shard = min(n - 1, (2 * run - size) * n // (2 * total))
            want.append((doc, size, crc, shard, slots[shard]))
            slots[shard] += 1
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.assign_shards(docs, n).collect())
        assert got == sorted(want)
    assert sharding.assign_shards(odd.limit(0), 4).count() == 0


def test_written_shards_keep_all_columns_and_the_order(spark, odd, tmp_path):
    docs = odd.unionByName(spark.createDataFrame([(7, "same", "z")] * 30, "doc_id long, text string, source string").selectExpr("*", "'clash' as shard", "1 as slot", "2 as pass", "3 as total", "4 as n_tokens"))
    name = sharding.write_shards(docs, str(tmp_path / "out"), 5)
    assert name == "_shard"
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    sizes = {r[name]: r.n for r in back.groupBy(name).agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 16).alias("n")).collect()}
    placed = {r.shard: r.n for r in sharding.assign_shards(docs, 5).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert sizes == placed
    for shard in sizes:
        ids = []
        for file in sorted((tmp_path / f"out/{name}={shard}").glob("part-*")):
            ids += pq.read_table(file, columns=["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids, key=lambda d: -1 if d is None else d)


def brute_mix(rows, share, most, budget, block):
    """(id, source, pass, tokens, offset, quota, alpha, mix_pos) by trying every exponent and sorting every pass."""
    units = Counter((d, s, hashlib.md5((t or "").encode()).hexdigest(), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows)
    total = Counter()
    for (_, s, _, n), c in units.items():
        total[s] += n * c
    some = [x for x in total.values() if x]

    def measured(p):
        if not some:
            return 1.0, 1.0
        power = [x ** (p / 1000) for x in some]
        z = sum(power)
        entropy = -sum(x / z * math.log(x / z) for x in power)
        passes = (max(some) / min(some)) ** (1 - p / 1000) if budget is None else budget * min(some) ** (p / 1000 - 1) / z
        return entropy / math.log(len(some)) if len(some) > 1 else 1.0, passes

    even = [p for p in range(1001) if measured(p)[0] >= share]
    often = [p for p in range(1001) if measured(p)[1] > most]
    alpha = min(1000, max(max(even, default=0), max(often, default=-1) + 1))
    out = []
    for source, held in total.items():
        if not held:
            quota = 0
        elif budget is None:
            quota = math.floor(held * (max(some) / held) ** (1 - alpha / 1000) + 0.5)
        else:
            quota = math.floor(budget * held ** (alpha / 1000) / sum(x ** (alpha / 1000) for x in some))
        mine = [u for u in units if u[1] == source]
        for turn in range(1 if not held else -(-quota // held)):
            offset = turn * held
            key = lambda u: hashlib.md5(f"7:{turn}:{'' if u[0] is None else u[0]}:{u[2]}".encode()).hexdigest()  # noqa: B023, E731
            for u in sorted(mine, key=key):
                if offset < quota or turn < quota // max(held, 1) or not held:
                    for i in range(units[u]):
                        at = offset + i * u[3]
                        out.append((u[0], source, turn, u[3], at, quota, alpha, math.floor(at * 1e9 / max(quota, 1))))
                offset += u[3] * units[u]
    return Counter(out)


@pytest.mark.parametrize(("share", "most", "budget", "block"), [(0.95, 3.0, None, 2_048), (0.95, 3.0, 50_000, 16), (0.99, 1.5, None, 5), (0.5, 10.0, 200_000, 64)])
def test_mix_matches_brute_force(spark, sf, odd, share, most, budget, block):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").unionByName(odd.select("doc_id", "text", "source"))
    docs = docs.unionByName(spark.createDataFrame([(9, f"same id {i}", "b") for i in range(20)] + [(10, "same row", "b")] * 20, "doc_id long, text string, source string"))
    rows = [tuple(r) for r in docs.collect()]
    want = brute_mix(rows, share, most, budget, block)
    settings = {"entropy_share": share, "max_passes": most, "budget": budget, "block_docs": block, "group_blocks": 3}
    got = Counter(tuple(r) for r in mixing.mix(docs, **settings).select("doc_id", "source", "pass", "n_tokens", "token_offset", "quota", "alpha", "mix_pos").collect())
    assert got == want
    played = Counter(tuple(r) for r in mixing.replay(docs, **settings).collect())
    texts = {(d, s, hashlib.md5((t or "").encode()).hexdigest()) for d, t, s in rows}
    assert sum(played.values()) == sum(want.values()) and set(played) <= set(rows) and len(texts) > 30
    ids = Counter()
    for (d, _, s), n in played.items():
        ids[d, s] += n
    asked = Counter()
    for x, n in want.items():
        asked[x[0], x[1]] += n
    assert ids == asked


def test_mix_of_nothing_and_clashing_columns(odd):
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.replay(odd.limit(0)).count() == 0
    played = sorted(str(r.doc_id) for r in mixing.mix(odd).collect())
    out = mixing.replay(odd)
    assert out.columns == odd.columns and sorted(str(r.doc_id) for r in out.collect()) == played


def test_equal_ids_at_the_cut(spark):
    docs = spark.createDataFrame([(1, f"{'word ' * 20}{i}", "a") for i in range(6)] + [(2, "other words here", "b")], "doc_id long, text string, source string")
    settings = {"budget": 60, "entropy_share": 0.0, "max_passes": 50.0}
    listed = mixing.mix(docs, **settings).count()
    assert mixing.replay(docs, **settings).count() == listed


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation_is_one_to_one(n):
    assert sorted(token_order.permute(np.arange(n), n, 5)) == list(range(n))


def test_token_shards_read_back(spark, sf, odd, tmp_path):
    stored = str(tmp_path / "stored")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    docs.write.parquet(stored)
    docs = spark.read.parquet(stored)
    folder = f"file://{tmp_path}/shards"
    index = token_order.materialise(docs, folder, docs_per_shard=50, record_tokens=64).collect()
    encode, end = encoder(vocabulary()).encode_ordinary, end_id(vocabulary())
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append([*encode(r.text or ""), end])
    assert sorted(r.slot for r in index) == list(range(docs.count()))
    held = {s: np.concatenate(list(token_order.read_records(folder, s, record_tokens=64))) for s in {r.shard for r in index}}
    assert all(len(x) % 64 == 0 for x in held.values())
    for r in index:
        assert list(held[r.shard][r.first_token : r.first_token + r.n_tokens]) in texts[r.doc_id] and r.shard == r.slot // 50
    for r in index[::7]:  # resume at any slot
        rest = np.concatenate(list(token_order.read_from(folder, r.shard, r.first_token, record_tokens=64)))
        assert list(rest[: r.n_tokens]) in texts[r.doc_id]
    rows = spark.createDataFrame(index)
    shards = token_order.manifest(rows, 50, 64).collect()
    assert {r.shard: r.n_records * 64 for r in shards} == {s: len(x) for s, x in held.items()}
    for broken in (rows.where("slot != 60"), rows.unionByName(rows.where("slot = 60")), rows.where("shard != 1")):
        with pytest.raises(ValueError, match="slots"):
            token_order.manifest(broken, 50, 64)
    before = {f.name: f.read_bytes() for f in (tmp_path / "shards").glob("shard-*")}
    again = token_order.materialise(docs, folder, docs_per_shard=50, record_tokens=64).collect()  # as after a loss: the same bytes in the same place
    (tmp_path / "shards/.part-lost").write_bytes(b"x")
    assert token_order.sweep(folder) == 1 and sorted(map(str, again)) == sorted(map(str, index))
    assert {f.name: f.read_bytes() for f in (tmp_path / "shards").iterdir() if not f.name.endswith(".crc")} == before
    none = token_order.materialise(docs.limit(0), f"{folder}-none")
    assert none.count() == 0 and token_order.manifest(none).count() == 0


def edited(text, edits):
    for e in edits or ():
        if e is None or e["start"] is None or e["end"] is None:
            continue
        start = min(max(e["start"], 0), len(text))
        text = text[:start] + (e["text"] or "") + text[max(start, min(e["end"], len(text))) :]
    return text


def test_edited_counts_match_whole_encoding(spark, sf, odd, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    encode = encoder(vocabulary()).encode_ordinary
    token_counts.build_trees(docs, leaf_chars=64).write.parquet(str(tmp_path / "v0"))
    stored = spark.read.parquet(str(tmp_path / "v0"))
    want, texts = [], defaultdict(list)
    for r in docs.select("doc_id", "text", token_counts.sample_edits(F.col("text")).alias("e")).collect():
        text = r.text or ""
        after = edited(text, r.e)
        texts[str(r.doc_id)].append(after)
        want.append((str(r.doc_id), len(encode(text)), len(encode(after)), len(after)))
    once = token_counts.recount(stored, token_counts.edits_for(F.col("n_chars")), leaf_chars=64)
    once.write.parquet(str(tmp_path / "v1"))
    once = spark.read.parquet(str(tmp_path / "v1"))
    rows = once.collect()
    assert sorted((str(r.doc_id), r.n_tokens_before, r.n_tokens, r.n_chars) for r in rows) == sorted(want)
    assert all("".join(r.leaves) in texts[str(r.doc_id)] and r.version == 1 and [len(encode(x)) for x in r.leaves] == r.tokens for r in rows)
    # Only the regions of the three edits are encoded: their leaves, one more on each side, and what was put in.
    for r in rows:
        longest = max(map(len, r.leaves)) + 64
        assert r.n_chars_encoded <= 3 * (5 * longest + 25) and r.n_leaves_encoded <= 3 * 6
    assert sum(r.n_chars_encoded for r in rows if r.n_chars > 6_000) * 3 < sum(r.n_chars for r in rows if r.n_chars > 6_000)


def test_edits_of_a_table_and_odd_edits(spark, odd, tmp_path):
    encode = encoder(vocabulary()).encode_ordinary
    token_counts.build_trees(odd, leaf_chars=8).write.parquet(str(tmp_path / "v0"))
    trees = spark.read.parquet(str(tmp_path / "v0"))
    changes = [(4, 2, 5, 9, "abc"), (4, 1, 0, 0, "zz "), (3, 1, 2, 1, "in"), (5, 1, None, 3, "x"), (6, 1, 0, None, "x"), (1, 1, -5, 99, None), (None, 1, 0, 3, "y"), (77, 1, 0, 3, "y"), (4, 3, 10**6, 10**7, "end")]
    edits = spark.createDataFrame(changes, "doc_id long, nth int, start int, end int, text string").withColumn("leaves", F.lit("clash"))
    got = sorted((str(r.doc_id), "".join(r.leaves), r.n_tokens, r.n_chars_encoded > 0) for r in token_counts.recount_table(trees, edits, leaf_chars=8).collect())
    want = []
    for d, t, _ in ODD:
        mine = [dict(start=c[2], end=c[3], text=c[4]) for c in sorted(changes, key=lambda c: c[1]) if c[0] == d and d is not None]
        text = edited(t or "", mine)
        want.append((str(d), text, len(encode(text)), d in (3, 4)))
    assert got == sorted(want)
    none = F.expr("cast(null as array<struct<start:int,end:int,text:string>>)")
    holes = F.expr("array(null, named_struct('start', cast(null as int), 'end', 1, 'text', 'q'))")
    for e in (none, holes):
        assert all(r.n_tokens == r.n_tokens_before and not r.n_leaves_encoded for r in token_counts.recount(trees, e).collect())
    assert token_counts.recount(token_counts.build_trees(odd.limit(0)), none).count() == 0
