"""Streams with state against their batch forms, with a restart in between; nested documents under a budget; links."""

import json
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import graph
from larkspur.sources import files, sections
from larkspur.streaming import stateful


def fed(spark, frame, folder, n):
    """frame in n files, in the order of ts."""
    rows = frame.orderBy("ts").toPandas()
    size = -(-len(rows) // n)
    for i in range(n):
        part = rows.iloc[i * size : (i + 1) * size]
        spark.createDataFrame(part, frame.schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")


def test_sessions_of_a_stream_equal_their_table(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    calls = events.select(F.concat(F.lit("s"), F.col("user_id") % 7).alias("session"), F.col("event_type").alias("tool"), F.col("ts").cast("timestamp").alias("ts"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    fed(spark, calls, source, 4)
    keep = lambda batch, nth: batch.write.mode("overwrite").parquet(f"{out}/{nth:03d}")

    def run(parts):
        stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/{parts}")
        query = stateful.tracked_sessions(stream, "20 minutes").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()

    run("00[01]")
    run("00[0-3]")  # a restart from the checkpoint: state and timers go on
    changes = spark.read.parquet(f"{out}/*")
    assert changes.where("evicted").count() > 3
    key = lambda df: sorted(map(str, df.select("session", "started", "last", "n_calls", "tools").collect()))
    want = stateful.sessions_of(calls, "20 minutes")
    assert key(stateful.latest(changes)) == key(want) and want.count() > 10


def test_debounced_batches_of_a_stream(spark, tmp_path):
    rng, at, rows = random.Random(2), 1_700_000_000.0, []
    for _ in range(120):
        at += rng.choice([0.2, 0.5, 1.4, 1.6, 4.0])
        rows.append((rng.choice("ab"), rng.choice(["app/models/x.rb", "config/routes.rb", "README"]), at))
    frame = spark.createDataFrame(rows, "root string, path string, t double").select("root", "path", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"))
    fed(spark, frame, str(tmp_path / "in"), 3)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    found = stateful.debounced(stream, late="0 seconds").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at"))
    found.trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = stateful.debounced(frame)
    last = frame.agg(F.max("ts")).first()[0]
    closed = want.where(F.col("ended") + F.expr("interval 1500 milliseconds") < F.lit(last))
    assert got == sorted(map(str, closed.collect())) and len(got) > 10
    # The rule itself: a batch ends where the next change of its root comes 1.5 s later or more.
    plain = []
    for root in "ab":
        times = [r[2] for r in rows if r[0] == root]
        plain.append(1 + sum(b - a >= 1.5 for a, b in zip(times, times[1:], strict=False)))
    assert sum(plain) == want.count()


def size(v):
    return len(json.dumps(v, separators=(",", ":"), ensure_ascii=False))


def brute_fit(v, budget):
    """The leaves in order, one more at a time, while the rebuilt document fits."""
    leaves = []

    def walk(v, path):
        if isinstance(v, dict | list) and v:
            items = sorted(v.items(), key=lambda kv: (isinstance(kv[1], dict | list), kv[0])) if isinstance(v, dict) else enumerate(v)
            for k, x in items:
                walk(x, [*path, k])
        else:
            leaves.append((path, v))

    def built(n):
        root = [] if isinstance(v, list) else {}
        for path, leaf in leaves[:n]:
            here, source = root, v
            for k, nxt in zip(path[:-1], path[1:], strict=True):
                source = source[k]
                if isinstance(here, list):
                    if len(here) == k:
                        here.append([] if isinstance(source, list) else {})
                    here = here[k]
                else:
                    here = here.setdefault(k, [] if isinstance(source, list) else {})
            if isinstance(here, list):
                here.append(leaf)
            else:
                here[path[-1]] = leaf
        return root

    walk(v, [])
    n = len(leaves)
    while n and size(built(n)) > budget:
        n -= 1
    name = lambda path: "$" + "".join(f"[{k}]" if isinstance(k, int) else f".{k}" for k in path)
    return built(n), sorted(name(p) for p, _ in leaves[n:])


def nested(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([1, 23, True, None, "x", 'q"é', "", {}, []])
    if rng.random() < 0.4:
        return [nested(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {k: nested(rng, depth - 1) for k in rng.sample(["a", "bb", "c c", "é", "z"], rng.randint(0, 4))}


@pytest.mark.parametrize("budget", [12, 40, 10_000])
def test_documents_under_a_budget_match_brute_force(spark, budget):
    rng = random.Random(budget)
    docs = [(i, nested(rng, 4)) for i in range(150)]
    frame = spark.createDataFrame([(i, json.dumps(v)) for i, v in docs] + [(-1, None), (-2, "{oops")], "id int, doc string")
    got = {r.id: (r.doc, r.cut) for r in sections.fit_documents(frame, "id", "doc", budget).collect()}
    assert got.pop(-1) == (None, []) and got.pop(-2) == (None, []) and len(got) == 150
    for i, v in docs:
        if isinstance(v, dict | list) and v:
            want, lost = brute_fit(v, budget)
            assert json.loads(got[i][0]) == want and sorted(got[i][1]) == lost and len(got[i][0]) <= max(2, budget), (v, got[i])
    assert sections.fit_documents(frame.limit(0), "id", "doc", budget).count() == 0


def test_links_lead_out_in_circles_and_back(spark, tmp_path):
    (tmp_path / "app/real/deep").mkdir(parents=True)
    (tmp_path / "etc").mkdir()
    made = {"app/l": "real/deep", "app/out": str(tmp_path / "etc"), "app/one": "two", "app/two": "one", "app/up": "../app/real", "app/l2": "l", "app/real/deep/back": "../../l2"}
    for link, target in made.items():
        (tmp_path / link).symlink_to(target)
    for name in ("app/a.rb", "app/real/b.rb", "app/real/deep/c.rb", "app/real/deep/.env", "etc/p"):
        (tmp_path / name).write_text("x")
    tried = ["app/a.rb", "app/l/c.rb", "app/out/p", "app/one/z", "app/l/../b.rb", "app/./up/b.rb", "app/l2/.env", "app/l2/back/c.rb", "etc/p", "app", "app/up/../../etc/p"]
    paths = spark.createDataFrame([(f"{tmp_path}/{t}",) for t in tried], "path string")
    links = spark.createDataFrame([(f"{tmp_path}/{k}", v) for k, v in made.items()], "link string, target string")
    real = {r.path: r.real for r in files.resolved_paths(paths, links).collect()}
    for t in tried:
        if t == "app/one/z":
            assert real[f"{tmp_path}/{t}"] is None
        else:
            assert real[f"{tmp_path}/{t}"] == str((tmp_path / t).resolve()), t
    inside = {r.path.removeprefix(f"{tmp_path}/") for r in files.contained(paths, links, f"{tmp_path}/app").collect()}
    assert inside == {"app/a.rb", "app/l/c.rb", "app/l/../b.rb", "app/./up/b.rb", "app/l2/back/c.rb", "app"}
    assert files.resolved_paths(paths.limit(0), links).count() == 0


def test_members_of_three_levels(spark):
    parents = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None), ("x", "y"), ("y", "x")], "node string, parent string")
    members = spark.createDataFrame([("a", "index"), ("a", "show"), ("b", "show"), ("c", "show"), ("c", "new"), ("b", "new"), ("y", "z"), ("c", "new")], "owner string, name string")
    seen = {(r.node, r.name): (r.origin, r.distance) for r in graph.visible_members(parents, members).collect()}
    assert seen == {("a", "index"): ("a", 0), ("a", "show"): ("a", 0), ("b", "index"): ("a", 1), ("b", "show"): ("b", 0), ("b", "new"): ("b", 0), ("c", "index"): ("a", 2), ("c", "show"): ("c", 0), ("c", "new"): ("c", 0), ("x", "z"): ("y", 1), ("y", "z"): ("y", 0)}
    assert {(r.owner, r.name) for r in graph.own_members(parents, members).collect()} == {("a", "index"), ("a", "show"), ("b", "new"), ("y", "z")}


def test_contents_are_computed_once(spark, tmp_path):
    from larkspur.streaming.content_cache import ContentCache

    asked = []

    def compute(lacking):
        asked.append(sorted(r.text for r in lacking.collect()))
        return lacking.select("digest", F.upper("text").alias("value"))

    cache = ContentCache(spark, str(tmp_path / "cache"), compute, most=4)
    frame = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = lambda df: sorted((r.id, r.value, r.hit) for r in df.collect())
    assert rows(cache.get(frame("a", "b", "a", None), "text")) == [(0, "A", False), (1, "B", False), (2, "A", False), (3, None, None)]
    assert rows(cache.get(frame("b", "c"), "text")) == [(0, "B", True), (1, "C", False)]
    assert rows(cache.get(frame("d", "e", "b"), "text")) == [(0, "D", False), (1, "E", False), (2, "B", True)]  # five entries: the oldest, a, and one more go
    assert cache.held.count() == 3 and cache.held.where("used < 3").count() == 0
    assert rows(cache.get(frame("a", "b"), "text")) == [(0, "A", False), (1, "B", True)]
    assert asked == [["a", "b"], ["c"], ["d", "e"], ["a"]]
