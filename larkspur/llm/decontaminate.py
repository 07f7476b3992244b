"""Benchmark decontamination by template canonicalisation.

Numbers, names and units are replaced with typed placeholders: a number is a run of digits with inner separators, a
unit is a listed word right after a number, a name is a capitalised word of two letters or more, wherever it stands: what begins a
sentence may be a name as well, and a template must not depend on what comes before it. All other words are lower-cased and lose
their punctuation.
Every window of ``width`` tokens of the benchmark is hashed; a document's windows are hash-joined with them.

For each pair of document and item, the share of the item's windows found is its coverage. Slots of the matched
windows are then compared, over the whole text and for each occurrence in it (one alignment of text and item, or a run
of matches without a gap of the item's length): each value of the item must have one value in the document, for each placeholder
type; two of its values may have the same one. A pair is reported with a coverage of at least ``coverage``: ``exact`` if all slots
agree, ``reparameterised`` if they map so; with slots that contradict each other, only windows whose slots agree count towards the
coverage.

A document's windows are first reduced to those of the benchmark, each once, however many items share them: the different
hashes are counted, and broadcast up to ``broadcast_windows`` of them; beyond it, both sides are shuffled by hash. A pair with the
coverage asked for holds one of the item's n - ceil(coverage n) + 1 windows that the fewest items share, so pairs are proposed by
these alone, and only proposed pairs meet all windows of their item: a window that many items and many documents share makes no pairs.

Null texts have no tokens. Windows of slots alone are not compared and not counted, but for items of slots alone with at least
``width`` tokens, whose windows must be equal in their values. Items with fewer than ``width`` tokens are one window of their own
width; such items of slots alone are never reported. Repeated documents (equal id and text) are one document here and share the
verdict; repeated items count as separate items only with separate ids. Very long texts are read in whole, by windows. Empty
tables give empty results. Other columns, whatever their names, are ignored, and kept by :func:`drop_contaminated`.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut, once, small

# Units recognised after a number.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "ton", "tons", "ounce", "ounces", "pound", "pounds", "lb", "lbs",
    "ml", "cl", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "cup", "cups",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degree", "degrees", "mph", "kmh",
)

_WORD = r"[\p{L}\p{M}]"
_NAME = rf"(?<!{_WORD})\p{{Lu}}[\p{{Ll}}\p{{M}}]++(?!{_WORD})"
_NUMBER = r"[0-9]++(?:[.,:/][0-9]++)*+"
_TOKEN = rf"[#@~]?{_WORD}++|#[0-9]++(?:[.,:/][0-9]++)*+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens; slots carry the value after their type: # number, @ name, ~ unit."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), "[#@~]", " ")
    numbered = F.regexp_replace(clean, _NUMBER, "#$0")
    unit = rf"(?<=#[0-9.,:/]{{1,24}}\x20?)(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?!{_WORD})"
    marked = F.when(numbered.contains("#"), F.regexp_replace(numbered, unit, "~$0")).otherwise(numbered)
    return F.regexp_extract_all(F.lower(F.regexp_replace(marked, _NAME, "@$0")), F.lit(_TOKEN), F.lit(0))


def template(found: Column) -> Column:
    """Tokens with slot values dropped."""
    return F.transform(found, lambda t: F.when(F.ascii(t).isin(35, 64, 126), F.left(t, F.lit(1))).otherwise(t))


def _is_slot(t: Column) -> Column:
    return F.ascii(t).isin(35, 64, 126)


def _bare(w: int) -> Column:
    """Whether the w tokens from ``at`` on are slots. No lambda: after an explode, one would copy all tokens for each window."""
    return reduce(and_, (_is_slot(F.get("_t", F.col("at") + k)) for k in range(w)))


def _read(rows: DataFrame) -> DataFrame:
    """rows with their tokens _raw and templates _t instead of the text."""
    return once(once(rows, "_raw", tokens(F.col("text"))).drop("text"), "_t", template(F.col("_raw")))


def windows(rows: DataFrame, widths: list[int], slots_alone: bool) -> DataFrame:
    """Rows of _read by window: at (its first token), hash and slots (its tokens), for windows that hold a word, of each width.

    With slots_alone also those of the first width that hold none, hashed with their values.
    """
    hashed = lambda name, w, tag: F.xxhash64(F.lit(tag), *(F.get(name, F.col("at") + k) for k in range(w)))
    raw = lambda w: F.slice("_raw", F.col("at") + 1, F.lit(w))
    placed = rows.where(F.size("_t") >= min(widths)).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("_t") - min(widths))))
    if widths == widths[:1] and not slots_alone:
        return placed.withColumn("hash", hashed("_t", widths[0], widths[0])).withColumn("slots", raw(widths[0]))
    forms = [F.when(F.col("at") + w <= F.size("_t"), F.struct(F.when(~_bare(w), hashed("_t", w, w)).alias("hash"), raw(w).alias("slots"))) for w in widths]
    if slots_alone:
        w = widths[0]
        forms.append(F.when((F.col("at") + w <= F.size("_t")) & _bare(w), F.struct(hashed("_raw", w, -w).alias("hash"), raw(w).alias("slots"))))
    spread = placed.withColumn("_w", F.explode(F.array(*forms))).where("_w.hash is not null")
    return spread.withColumns({"hash": F.col("_w.hash"), "slots": F.col("_w.slots")}).drop("_w")


def _item_windows(benchmark: DataFrame, width: int) -> tuple[DataFrame, list[int], bool]:
    """item_id, n (tokens), short, item_at, hash and item_slots of the windows that are compared; their widths; whether items of slots alone are among them."""
    items = _read(benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).select("*", F.col("text").alias("_text")))
    items = cut(items.select("*", F.size("_t").alias("n"), F.exists("_t", lambda t: ~_is_slot(t)).alias("plain")))
    keep = ["item_id", "n", "short", F.col("at").alias("item_at"), "hash", F.col("slots").alias("item_slots")]
    long = items.where(f"n >= {width}").withColumn("short", F.lit(False))
    own = windows(long.where("plain"), [width], False).where(~_bare(width)).select(keep)
    alone = not long.where("not plain").isEmpty()
    if alone:
        own = own.unionByName(windows(long.where("not plain"), [width], True).select(keep))
    widths = [r["n"] for r in items.where(f"n between 1 and {width - 1} and plain").select("n").distinct().orderBy("n").collect()]  # at most width - 1 rows
    if widths:  # inside a sentence their first word may be a small one
        small_first = F.concat(F.lower(F.left("_text", F.lit(1))), F.substring("_text", 2, 1_000_000_000))
        few = items.where(f"n between 1 and {width - 1} and plain").select("item_id", "n", F.explode(F.array("_text", small_first)).alias("text"), F.lit(True).alias("short"))
        for w in widths:
            own = own.unionByName(windows(_read(few.where(F.col("n") == w)), [w], False).where("at = 0").select(keep))
    return cut(own), [width, *widths], alone


def matches(docs: DataFrame, own: DataFrame, widths: list[int], slots_alone: bool, broadcast_windows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, at, hash and doc_slots of the documents' windows that some item has, each once."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    # A shuffled window carries its own tokens, never those of its whole text.
    spread = windows(_read(rows), widths, slots_alone).select("doc_id", "text_hash", "at", "hash", F.col("slots").alias("doc_slots"))
    wanted = own.select(F.col("hash").alias("_hash")).distinct()
    wanted = F.broadcast(wanted) if own.count() <= broadcast_windows else wanted
    return spread.join(wanted, F.col("hash") == F.col("_hash"), "left_semi").distinct()


def _judged(places: DataFrame, by: list[str], coverage: float) -> DataFrame:
    """places (with n_windows, item_at, b and same) grouped by ``by``: n_windows, n_found and a verdict, null for none."""
    counts = places.groupBy(*by, "n_windows").agg(F.countDistinct("item_at").alias("n_found"), F.countDistinct(F.when(F.col("same"), F.col("item_at"))).alias("n_same"))
    slots = places.select(*by, F.explode("b").alias("b")).select(*by, F.col("b.i").alias("i"), F.col("b.d").alias("d"))
    mapped = slots.groupBy(*by).agg(F.countDistinct("i", "d").alias("n_pairs"), F.countDistinct("i").alias("n_i"))
    mapped = mapped.select(*(F.col(c).alias(f"_{c}") for c in by), F.expr("n_pairs = n_i").alias("mapped"))
    on = [counts[c].eqNullSafe(F.col(f"_{c}")) for c in by]
    likely = counts.where(F.col("n_found") >= coverage * F.col("n_windows"))
    return likely.join(mapped, on, "left").withColumn(
        "verdict",
        F.when(F.col("n_same") == F.col("n_found"), "exact")
        .when(F.col("mapped"), "reparameterised")
        .when(F.col("n_same") >= coverage * F.col("n_windows"), "exact"),
    ).where("verdict is not null")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = 5, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", broadcast_windows: int = 500_000
) -> DataFrame:
    """Pairs reported: doc_id, text_hash, item_id, n_windows of the item, n_found, verdict."""
    own, widths, alone = _item_windows(benchmark, width)
    found = cut(matches(docs, own, widths, alone, broadcast_windows, id_col, text_col))
    totals = own.groupBy("item_id").agg(F.countDistinct("item_at").alias("n_windows"), F.max("n").alias("n"))
    spread_over = own.groupBy(F.col("hash").alias("_hash")).agg(F.countDistinct("item_id").alias("_items"))
    placed = own.join(spread_over, F.col("hash") == F.col("_hash")).drop("_hash").join(totals.withColumnRenamed("item_id", "_of").drop("n"), F.col("item_id").eqNullSafe(F.col("_of"))).drop("_of")
    rank = F.dense_rank().over(Window.partitionBy("item_id").orderBy("_items", "item_at"))
    rare = placed.withColumn("_rank", rank).where(F.col("_rank") <= F.col("n_windows") - F.ceil(coverage * F.col("n_windows")) + 1)
    pair = ["doc_id", "text_hash", "item_id"]
    likely = found.join(rare.select("item_id", "hash").distinct(), "hash").select(*pair).distinct()
    whole = cut(placed.select(F.col("item_id").alias("_item"), "n", "n_windows", "short", "item_at", "hash", "item_slots"))
    asked = likely.join(small(whole), F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")
    here = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"), "at", F.col("hash").alias("_hash"), "doc_slots")
    met = asked.join(here, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_text")) & (F.col("hash") == F.col("_hash")))
    opens = ~F.get("item_slots", F.lit(0)).startswith("@") | (F.get("item_slots", F.lit(0)) == F.get("doc_slots", F.lit(0)))
    bindings = F.filter(F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d")), lambda x: _is_slot(x["i"]))
    bound = met.where(~F.col("short") | opens).select(*pair, "n", "n_windows", "at", "item_at", bindings.alias("b"), F.forall(bindings, lambda x: x["i"] == x["d"]).alias("same"))
    places = cut(bound.distinct())
    # An occurrence is an alignment, or, where words were added or left out, a run of matches without a gap of the item's length.
    order = Window.partitionBy(*pair).orderBy("at")
    gaps = places.withColumn("_gap", (F.col("at") - F.lag("at").over(order) > F.col("n")).cast("int"))
    gaps = gaps.withColumn("run", F.coalesce(F.sum("_gap").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)))
    ways = [("whole", F.lit(0)), ("run", F.col("run")), ("line", F.col("at") - F.col("item_at"))]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("way"), v.cast("long").alias("place")) for k, (_, v) in enumerate(ways)))).alias("w")
    judged = _judged(gaps.select("*", each).select(*places.columns, "w.way", "w.place"), [*pair, "way", "place"], coverage)
    # The verdict over the whole text stands where there is one; else that of the occurrence with most windows.
    best = F.min_by(F.struct("n_windows", "n_found", "verdict"), F.struct(F.col("way") != 0, -F.col("n_found"), "verdict", "way", "place"))
    return judged.groupBy(*pair).agg(best.alias("r")).select(*pair, "r.n_windows", "r.n_found", "r.verdict")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents that no item of the benchmark is reported for."""
    found = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **settings)
    bad = cut(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    whole = docs.select(F.struct(*docs.columns).alias("_row"))
    same = F.col("_row")[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("_row")[text_col]) == F.col("_hash"))
    return whole.join(small(bad), same, "left_anti").select("_row.*")
