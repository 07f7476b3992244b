import random
import re
from collections import defaultdict

import regex
from pyspark.sql import functions as F

from larkspur.llm import decontaminate

ITEM = "A train leaves the old station and travels 120 km in 3 hours before it meets Anna, Bertold near the river bank. How fast does it go?"
TWIN = ITEM.replace("120", "450").replace("3 hours", "5 days").replace("Bertold", "Cecile")
OTHER = "Nobody in the village had ever seen such a strange light over the hills at night, and few believed the story."


def test_verdicts_and_odd_rows(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "too short"), (4, "")], "item_id long, text string").withColumn("hash", F.lit("clash"))
    pad = "filler words that say nothing at all " * 3_000
    rows = [(10, f"Intro. {ITEM} End."), (11, f"Intro. {TWIN} End."), (12, OTHER), (13, None), (14, ""), (15, pad + ITEM + " " + pad), (None, ITEM), (10, OTHER), (10, f"Intro. {ITEM} End."), (16, ITEM[:40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("at", F.lit(0))
    for most in (500_000, 0):  # by broadcast, and by shuffle
        got = {(r.doc_id, r.item_id): r.verdict for r in decontaminate.contaminated(docs, bench, broadcast_windows=most).collect()}
        assert got == {(10, 1): "exact", (11, 1): "reparameterised", (15, 1): "exact", (None, 1): "exact"}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == [(10, OTHER), (12, OTHER), (16, ITEM[:40])]
    assert kept.count() == 5
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_contradicting_slots_are_no_match(spark):
    bench = spark.createDataFrame([(1, "add 1 and 2 then take 1 from 2 but keep 2 over 1")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "add 3 and 4 then take 5 from 6 but keep 7 over 8"), (2, "add 4 and 7 then take 4 from 7 but keep 7 over 4")], "doc_id long, text string")
    assert [(r.doc_id, r.verdict) for r in decontaminate.contaminated(docs, bench).collect()] == [(2, "reparameterised")]


def test_each_occurrence_is_judged_by_itself(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "Define osmosis 7 briefly"), (3, "sum 1 2 3 4 5 6 7 8 9 10 11 12 13 14")], "item_id long, text string")
    far = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    again = ITEM.replace("120", "77").replace("3 hours", "9 weeks").replace("Bertold", "Dorian")
    stray = "Somebody travels 999 km in 8 seconds before lunch."
    rows = [(1, f"{TWIN} {far} {stray}"), (2, f"{TWIN} {again}"), (3, f"{TWIN} {far} {again}"), (4, f"{far} Define osmosis 7 briefly {far}"), (5, "they define osmosis 9 briefly"), (6, f"{far} osmosis"), (7, f"{far} sum 1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (8, stray)]
    got = {(r.doc_id, r.item_id): r.verdict for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1): "reparameterised", (2, 1): "reparameterised", (3, 1): "reparameterised", (4, 2): "exact", (5, 2): "reparameterised", (7, 3): "exact"}


def brute_tokens(text):
    text = re.sub("[#@~]", " ", text or "")
    text = re.sub(r"[0-9]++(?:[.,:/][0-9]++)*+", lambda m: "#" + m[0], text)
    units = "|".join(sorted(decontaminate.UNITS, key=len, reverse=True))
    text = regex.sub(rf"(?<=#[0-9.,:/]{{1,24}}\x20?)(?:{units})(?![\p{{L}}\p{{M}}])", lambda m: "~" + m[0], text)
    text = regex.sub(r"(?<![\p{L}\p{M}])\p{Lu}[\p{Ll}\p{M}]++(?![\p{L}\p{M}])", lambda m: "@" + m[0], text)
    return regex.findall(r"[#@~]?[\p{L}\p{M}]++|#[0-9]++(?:[.,:/][0-9]++)*+", text.lower())


def brute(docs, items, width=5, coverage=0.5):
    """Every document against every item, by the definitions."""
    slot = lambda t: t[0] in "#@~"
    shape = lambda ts: tuple(t[0] if slot(t) else t for t in ts)
    own = {}
    for item, text in items:
        ts = brute_tokens(text)
        if len(ts) >= width:
            bare = all(map(slot, ts))
            wins = [(i, width, tuple(ts[i : i + width])) for i in range(len(ts) - width + 1) if bare or not all(map(slot, ts[i : i + width]))]
            own[item] = (len(ts), bare, False, wins)
        elif ts and not all(map(slot, ts)):
            own[item] = (len(ts), False, True, [(0, len(ts), tuple(x)) for x in (ts, brute_tokens(text[:1].lower() + text[1:]))])
    out = {}
    for doc, text in docs:
        ts = brute_tokens(text)
        at = defaultdict(list)
        for w in {w for _, _, _, wins in own.values() for _, w, _ in wins}:
            for i in range(len(ts) - w + 1):
                at[shape(ts[i : i + w])].append((i, tuple(ts[i : i + w])))
        for item, (n, bare, short, wins) in own.items():
            total = len({i for i, _, _ in wins})
            found = {(i, j, tuple((a, b) for a, b in zip(x, y, strict=True) if slot(a))) for j, _, x in wins for i, y in at[shape(x)]
                     if not (bare and x != y) and not (short and x[0].startswith("@") and x[0] != y[0])}
            if not found:
                continue
            runs, run, last = {}, 0, None
            for i in sorted({f[0] for f in found}):
                run += last is not None and i - last > n
                runs[i] = run
                last = i
            best = None
            for way, place in (("0", lambda f: 0), ("1", lambda f: runs[f[0]]), ("2", lambda f: f[0] - f[1])):
                groups = defaultdict(set)
                for f in found:
                    groups[place(f)].add(f)
                for where, fs in groups.items():
                    hit = len({f[1] for f in fs})
                    same = len({f[1] for f in fs if all(a == b for a, b in f[2])})
                    pairs = {p for f in fs for p in f[2]}
                    one = len(pairs) == len({a for a, _ in pairs})
                    if hit < coverage * total:
                        continue
                    verdict = "exact" if same == hit else "reparameterised" if one and pairs else "exact" if same >= coverage * total else None
                    if verdict:
                        best = min(filter(None, (best, (way != "0", -hit, verdict, way, where))))
            if best:
                out[doc, item] = (total, -best[1], best[2])
    return out


def test_whole_tables_match_brute_force(spark, sf):
    names = ["Anna", "Bertold", "Cecile", "Dorian"]
    rng = random.Random(4)
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    shared = "read the text below and answer the question that follows it in full"
    made = [(1000, ITEM), (1001, "12 34 56 78 90 21 43 65 87 sum"), (1002, "12 34 56 78 90 21 43"), (1003, "Define osmosis 7 briefly"), (1004, "5 7"), (1005, None), (1006, "osmosis")]
    made += [(1010 + i, f"{shared}: why do {i} of {names[i % 4]}, {names[(i + 1) % 4]} take {i * 7} kg of salt") for i in range(12)]
    texts = [ITEM, TWIN, shared, "so 12 34 56 78 90 21 43 65 87 sum", "a 12 34 56 78 90 21 43 b", "a 12 34 56 78 90 21 44 b", "they define osmosis 9 briefly", "5 7", None, "", "Osmosis is slow"]
    texts += [f"{shared}: why do {rng.randrange(99)} of {rng.choice(names)}, {rng.choice(names)} take {rng.randrange(99)} kg of salt" for _ in range(12)]
    words = " ".join(t for _, t in bench[:5] + made if t).split()
    texts += [" ".join(rng.choice(words) for _ in range(60)) for _ in range(20)]
    texts += [t.replace(" the ", " a ", 1) for _, t in bench[:10]] + [t[len(t) // 2 :] for _, t in bench[10:20]]
    rows = docs + [(10_000 + i, t) for i, t in enumerate(texts)]
    items = bench + made
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.n_windows, r.n_found, r.verdict) for r in got.collect()} == brute(rows, items)


def test_windows_that_many_items_share_make_no_pairs(spark):
    """Items and documents open alike; only the documents that hold an item's own words meet its windows."""
    shared = " ".join(f"open{chr(97 + i)}" for i in range(8))
    own = lambda i: " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + k)}" for k in range(12))
    items = spark.createDataFrame([(i, f"{shared} {own(i)}") for i in range(60)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{shared} {own(i) if i < 5 else 'and nothing else that is known here'}") for i in range(80)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.verdict) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(i, i, "exact") for i in range(5)}


def reparameterised(text, rng):
    """text with other numbers, names and units, each value by one other."""
    new = {}

    def other(m):
        word = m[0]
        if word[0].isdigit():
            return new.setdefault(word, str(rng.randrange(1, 10_000)))
        if word in decontaminate.UNITS:
            return new.setdefault(word, rng.choice(decontaminate.UNITS))
        return new.setdefault(word, "".join(rng.choice("aeiouklmnrst") for _ in range(rng.randint(3, 8))).capitalize())

    return regex.sub(r"[0-9]++|(?<![\p{L}\p{M}])\p{Lu}[\p{Ll}\p{M}]++(?![\p{L}\p{M}])|(?<=[0-9] )(?:" + "|".join(decontaminate.UNITS) + r")\b", other, text)


def test_recall_of_reparameterised_items(spark, sf):
    rng = random.Random(9)
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    bench += [(1_000 + i, f"{n} buys {12 + i} kg of salt in the old shop near the river. {n} sells {5 + i} kg of it to {m} before noon. How much salt is left?") for i, (n, m) in enumerate([("Anna", "Bertold"), ("Maria", "Jonas"), ("Cecile", "Dorian")])]
    far = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    docs = [(i, f"{far}. {reparameterised(t, rng)} {far}") for i, t in bench]
    docs += [(2_000, f"{far}. Jonas buys 90 kg of salt in the old shop near the river. Jonas sells 90 kg of it to Rita before noon. How much salt is left?"), (2_001, f"{far}. {OTHER}")]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert sum((i, i) in got for i, _ in bench) >= 0.95 * len(bench) and all((i, i) in got for i, _ in bench[-3:])
    assert (2_000, 1_001) in got and not any(d == 2_001 for d, _ in got)  # two numbers that became one
    alike = {1_000, 1_001, 1_002}  # items of one template are found in each other's texts too
    assert got - {(i, i) for i, _ in bench} == {(d, i) for d in alike | {2_000} for i in alike if d != i}
