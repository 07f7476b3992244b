"""Each stage of the pipeline against brute force on what the stage before kept, and on odd rows."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_decontaminate import brute as brute_contaminated
from test_layout import brute_mix
from test_quality import brute_base, many_held_out
from test_simhash import brute_kept

import corpus_pipeline
from larkspur.llm import near_text, quality
from larkspur.llm.bitslice import planes_of
from larkspur.llm.common import ARROW_BYTES, BATCH_BYTES, limit_batches

STAGES = dict(corpus_pipeline.STAGES)


def test_every_stage_matches_brute_force_on_the_table(spark, sf, tmp_path):
    docs, inputs = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        inputs[name] = ([(r.doc_id, r.text, r.source) for r in docs.collect()] if "text" in docs.columns else None, docs.columns)
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "token_shards":
            assert docs.columns == inputs[name][1]
    rows = {name: [(r.doc_id, r.text, r.source) for r in spark.read.parquet(str(tmp_path / name)).collect()] for name in list(STAGES)[:-1]}
    before = lambda name: inputs[name][0]
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(table, labels)
    means = {r.doc_id: (r.n_grams, r.score) for r in quality.judge(table, labels).collect()}
    fine = {d for d, t, _ in before("quality_rules") if not brute_base(t)[5] and (model.threshold is None or means[d][1] >= model.threshold * means[d][0])}
    assert {d for d, _, _ in rows["quality_rules"]} == fine
    given = sorted(before("simhash_near_duplicates"))
    assert {r[0] for r in rows["simhash_near_duplicates"]} == {given[i][0] for i in brute_kept([r[:2] for r in given])}
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    given = before("benchmark_decontamination")
    bad = {d for d, _ in brute_contaminated([r[:2] for r in given], bench)}
    assert {r[0] for r in rows["benchmark_decontamination"]} == {d for d, _, _ in given} - bad
    given = before("source_mixing")
    want = Counter()
    for (doc, source, *_), n in brute_mix(given, 0.95, 3.0, None, 2_048).items():
        want[doc, source] += n
    assert Counter((d, s) for d, _, s in rows["source_mixing"]) == want
    slots = spark.read.parquet(str(tmp_path / "token_shards")).collect()
    assert sorted(r.slot for r in slots) == list(range(len(rows["source_mixing"]))) and Counter(r.doc_id for r in slots) == Counter(d for d, _, _ in rows["source_mixing"])


WORDS = [f"word{i}" for i in range(400)]
GOOD = " ".join(WORDS[:120])
NEAR = " ".join([*WORDS[:60], "other", *WORDS[61:120]])
FAR = " ".join(WORDS[200:320])
ODD = [(1, GOOD, "a"), (None, NEAR, "a"), (None, FAR, None), (2, None, "b"), (3, "", "b"), (4, " \t\n", None), (5, "few words", "b"), (6, "long " * 60_000, "a"), (2, FAR + " end", "b"), (7, "x y z w v u t s r q p", "c"), (7, "x y z w v u t s r q p", "c")]


@pytest.fixture()
def odd(spark, tmp_path):
    frame = spark.createDataFrame(ODD, "doc_id long, text string, source string").selectExpr("*", "'en' as lang", "length(text) as n_chars", "'clash' as slot", "1 as kept", "2 as _row", "3 as hash", "4 as pass")
    frame.write.parquet(str(tmp_path / "odd"))
    return spark.read.parquet(str(tmp_path / "odd"))


def pairs(frame):
    return Counter((r.doc_id, r.text) for r in frame.collect())


def test_odd_rows(spark, sf, odd):
    given = Counter((d, t) for d, t, _ in ODD)
    kept = STAGES["quality_rules"](spark, odd, sf)
    assert kept.columns == odd.columns
    assert {(d, t) for d, t in pairs(kept)} <= {(d, t) for d, t, _ in ODD if not brute_base(t)[5]}
    first = STAGES["simhash_near_duplicates"](spark, odd, sf)
    # One of the near copies, of the blank texts and of the equal rows stays; ids that are null or used twice lose only their own text.
    assert first.columns == odd.columns
    assert pairs(first) == Counter([(1, GOOD), (2, FAR + " end"), (2, None), (5, "few words"), (6, "long " * 60_000), (7, "x y z w v u t s r q p")])
    clean = STAGES["benchmark_decontamination"](spark, odd, sf)
    assert clean.columns == odd.columns and pairs(clean) == given
    played = STAGES["source_mixing"](spark, odd, sf)
    assert played.columns == odd.columns and set(pairs(played)) == set(given) and all(n >= given[k] for k, n in pairs(played).items())
    shards = STAGES["token_shards"](spark, odd, sf).collect()
    assert sorted(r.slot for r in shards) == list(range(len(ODD))) and Counter(r.doc_id for r in shards) == Counter(d for d, _, _ in ODD)


def test_empty_tables(spark, sf, odd, tmp_path):
    odd.limit(0).write.parquet(str(tmp_path / "none"))
    none = spark.read.parquet(str(tmp_path / "none"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf)
        assert out.count() == 0 and (name == "token_shards" or out.columns == odd.columns)


def test_quality_stage_uses_every_held_out_document(spark, tmp_path):
    docs, labels, of = many_held_out(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = STAGES["quality_rules"](spark, docs, str(tmp_path)).where("text != 'an id with two texts'")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in of.where("kind != 'bad'").collect()}


def test_prefixes_are_ordered_by_counts_of_every_text(spark):
    rows = [(None,), ("",), ("one two",)] + [(f"a b c d e f{i % 3} " + f"g{i} " * (i % 9),) for i in range(500)]
    texts = spark.createDataFrame(rows, "text string").repartition(5)
    for cells in (1 << 21, 1 << 6):
        want = Counter(int(h) % cells for (t,) in rows for h in near_text.shingles((t or "").encode()))
        got = near_text._cell_counts(texts, 5, cells)
        assert len(got) == cells and {i: int(got[i]) for i in got.nonzero()[0]} == want
    assert not near_text._cell_counts(texts.limit(0), 5).any()


def test_texts_go_to_python_in_batches_of_bounded_bytes(spark, sf, tmp_path):
    texts = spark.range(0, 4_000, 1, 1).selectExpr("id as doc_id", "concat_ws(' ', sequence(id, id + 999)) as text", "'a' as source")
    texts.write.parquet(str(tmp_path / "long"))
    docs = spark.read.parquet(str(tmp_path / "long")).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["n"])

    before = spark.conf.get(ARROW_BYTES)
    try:
        for name in ("simhash_near_duplicates", "token_shards"):
            spark.conf.set(ARROW_BYTES, before)
            STAGES[name](spark, docs.limit(40), sf).count()
            assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= BATCH_BYTES + (1 << 18)
        for given, kept in (("64kb", "64kb"), ("2M", "2M"), ("8m", str(BATCH_BYTES)), ("1gb", str(BATCH_BYTES))):
            spark.conf.set(ARROW_BYTES, given)
            limit_batches(spark)
            assert spark.conf.get(ARROW_BYTES) == kept
    finally:
        spark.conf.set(ARROW_BYTES, before)


def peak(work):
    """Bytes that a call takes besides what was held before, at most."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_workers_hold_counts_and_planes_but_no_copies_of_them():
    cells, batch = 1 << 21, pa.record_batch([pa.array([" ".join(str(i) for i in range(at, at + 2_000)) for at in range(0, 800_000, 2_000)])], names=["text"])
    assert peak(lambda: [len(b) for b in near_text._loads(5, cells, 1 << 13)(iter([batch]))]) < 4 * cells + (4 << 20)
    marks = np.random.default_rng(3).integers(0, 1 << 63, (50_001, 8), dtype=np.uint64)
    assert peak(lambda: planes_of(marks)) < 3 * marks.nbytes
    planes = planes_of(marks)
    assert planes.shape == (512, 782)
    for lane, bit in ((0, 0), (4_095, 64), (4_096, 511), (50_000, 130)):
        assert planes[bit, lane // 64] >> np.uint64(lane % 64) & np.uint64(1) == marks[lane, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)
