import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import bitslice, near_text, simhash


def brute_mark(text):
    words = [w for w in (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(marks, ids, radius=2):
    parent = list(range(len(marks)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(marks))]


def test_fingerprint_and_classes_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    marks = [brute_mark(r.text) for r in rows]
    want = dict(zip([r.doc_id for r in rows], zip(marks, brute_classes(marks, [r.doc_id for r in rows])), strict=True))
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def clusters(rng, sizes):
    marks = set()
    for n in sizes:
        mark = rng.getrandbits(64)
        for _ in range(n):
            mark ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))  # a drifting chain
            marks.add(mark)
    return sorted(marks)


@pytest.mark.parametrize("limit", [16_384, 5])
def test_links_reach_what_pairs_reach(spark, limit):
    marks = clusters(random.Random(3), [1] * 40 + [2, 3, 7, 9, 17, 33, 65, 150])
    signed = [int(np.array([m], np.uint64).view(np.int64)[0]) for m in marks]
    frame = spark.createDataFrame([(m,) for m in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, bucket_limit=limit)).collect()}
    want = brute_classes(marks, signed)
    assert [roots.get(m, m) for m in signed] == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6])
def test_bucket_forests_and_abandoned_blocks(radius):
    rng = random.Random(radius)
    held = [clusters(rng, [40, 20, 3, 1] + [1] * 150), clusters(rng, [5, 1]), clusters(rng, [2]), clusters(rng, [70, 30] + [1] * 300)]
    bounds, work = np.cumsum([0, *map(len, held)]), bitslice.Work()
    u, v = simhash.bucket_edges(np.array(sum(held, []), np.uint64), bounds, radius, work, rows=64)
    assert len(u) < sum(map(len, held))
    for marks in held:
        parent = {m: m for m in marks}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in zip(map(int, u), map(int, v), strict=True):
            if a in parent and b in parent:
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        assert [find(m) for m in marks] == brute_classes(marks, marks, radius)
    if radius:
        assert work.abandoned > work.begun * 0.8 and work.planes < work.begun * 40


@pytest.mark.parametrize("radius", [1, 3])
@pytest.mark.parametrize("limit", [16_384, 6])
def test_other_radii(spark, radius, limit):
    marks = clusters(random.Random(8), [1] * 20 + [3, 9, 40, 80])
    signed = [int(np.array([m], np.uint64).view(np.int64)[0]) for m in marks]
    frame = spark.createDataFrame([(m,) for m in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, radius, bucket_limit=limit)).collect()}
    assert [roots.get(m, m) for m in signed] == brute_classes(marks, signed, radius)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b c d " * 30_000), (6, "a b c d " * 30_000), (None, "one")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    out = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame).collect())
    assert len(out) == len(rows)
    assert [x[2] for x in out if x[1] == "0" * 16] == [1, 1, 1]
    assert {x[2] for x in out if x[0] in (0, 4, 5)} == {4}
    kept = near_text.keep_first(frame)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6] and kept.columns == frame.columns
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def brute_kept(rows, similarity=0.8):
    """Indices of (id, text) rows that stay, by comparing all pairs of sets of five-word shingles."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if find(i) not in first or d < rows[first[find(i)]][0]:
            first[find(i)] = i
    return set(first.values())


def test_keep_first_finds_all_pairs_of_similarity(spark):
    rng = random.Random(5)
    texts = []
    for n in (12, 30, 60, 200):
        for _ in range(6):
            base = [f"w{rng.randrange(5_000)}" for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(4):
                for _ in range(rng.randrange(1, 2 + n // 40)):
                    base = list(base)
                    base[rng.randrange(n)] = f"w{rng.randrange(5_000)}"
                texts.append(" ".join(base))
    line = "the same long line stands at the end of very many texts here"
    texts += [" ".join(f"x{rng.randrange(5_000)}" for _ in range(12)) + " " + line for _ in range(60)]
    hub = [f"h{i}" for i in range(60)]
    texts += [" ".join(hub[:i] + [f"new{i}"] + hub[i + 1 :]) for i in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    kept = {r.doc_id for r in near_text.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == brute_kept(rows)
    assert len(kept) < len(rows) - 60


def test_null_and_repeated_ids_lose_only_their_own_text(spark):
    near = " ".join(f"w{i}" for i in range(80))
    twin = near.replace("w40 ", "other ")
    clean, far = (" ".join(f"{c}{i}" for i in range(30)) for c in "cf")
    later = far.replace("f29", "last")
    rows = [(1, near), (None, twin), (None, clean), (2, far), (3, near), (3, later), (2, clean + " more words that differ"), (None, later + " x")]
    kept = near_text.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect())) == sorted([(1, near), (2, far), (2, clean + " more words that differ")])
    lone = spark.createDataFrame([(None, near), (None, twin), (None, clean), (5, far), (4, near + " z"), (5, near)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in near_text.keep_first(lone).collect()) == sorted([(0, clean), (4, near + " z"), (5, far)])
