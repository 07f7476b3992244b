"""Section states, resources by address, and text budgets of answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.graph import cut

STATUS = "section string, state string, reason string"


def load_sections(spark: SparkSession, builders: dict[str, Callable[[SparkSession], DataFrame]]) -> DataFrame:
    """Register a view for each section that can be built; a section that fails is marked, never shown as empty."""
    rows = []
    for name, build in builders.items():
        try:
            frame = build(spark)
            if frame is None:
                rows.append((name, "unavailable", "not captured"))
                continue
            frame.createOrReplaceTempView(name)
            rows.append((name, "usable", None))
        except Exception as e:
            rows.append((name, "error", str(e).splitlines()[0][:200]))
    return spark.createDataFrame(rows, STATUS)


def section(spark: SparkSession, status: DataFrame, name: str) -> DataFrame:
    """A usable section's view; raises with the reason otherwise."""
    row = status.where(F.col("section") == name).first()
    if row is None:
        raise LookupError(f"section {name} is unknown")
    if row["state"] != "usable":
        raise LookupError(f"section {name} is {row['state']}: {row['reason']}")
    return spark.table(name)


class Resources:
    """Queries by address; ``{name}`` in a pattern becomes an argument."""

    def __init__(self):
        self.routes: list[tuple[re.Pattern, Callable[..., DataFrame]]] = []

    def route(self, pattern: str):
        parts = re.split(r"\{(\w+)\}", pattern)
        form = re.compile("".join(f"(?P<{p}>[^/]+)" if i % 2 else re.escape(p) for i, p in enumerate(parts)))

        def register(f):
            self.routes.append((form, f))
            return f

        return register

    def read(self, spark: SparkSession, address: str) -> DataFrame:
        for form, f in self.routes:
            if m := form.fullmatch(address):
                return f(spark, **m.groupdict())
        raise LookupError(f"no resource {address}")


def cap_text(text: str, most: int = 200_000, suffix: str = "") -> str:
    """At most ``most`` characters; a note of the cut and the suffix survive it."""
    if len(text) + len(suffix) <= most:
        return text + suffix
    note = f"\n\n[Truncated: {len(text)} characters]"
    return text[: max(0, most - len(note) - len(suffix))] + note + suffix


def capped(text: Column, most: int = 200_000, suffix: str = "") -> Column:
    """:func:`cap_text` of a column."""
    note = F.concat(F.lit("\n\n[Truncated: "), F.length(text).cast("string"), F.lit(" characters]"))
    kept = F.left(text, F.greatest(F.lit(0), F.lit(most - len(suffix)) - F.length(note)))
    return F.when(F.length(text) + len(suffix) <= most, F.concat(text, F.lit(suffix))).otherwise(F.concat(kept, note, F.lit(suffix)))


def fit_json(value, budget: int) -> tuple[object, list[str]]:
    """value with only as many whole list elements and keys as fit into a budget of compact JSON, and the paths that were cut. Scalars come first."""
    size = lambda v: len(json.dumps(v, separators=(",", ":"), ensure_ascii=False))
    cut: list[str] = []

    def fit(v, room: int, path: str):
        if size(v) <= room or not isinstance(v, dict | list):
            return v
        out, used = ({} if isinstance(v, dict) else []), 2
        items = sorted(v.items(), key=lambda kv: isinstance(kv[1], dict | list)) if isinstance(v, dict) else list(enumerate(v))
        for k, inner in items:
            head = size(k) + 2 if isinstance(v, dict) else 1
            where = f"{path}.{k}" if isinstance(v, dict) else f"{path}[{k}]"
            left = room - used - head
            got = inner if size(inner) <= left else fit(inner, left, where) if isinstance(v, dict) and isinstance(inner, dict | list) and left > 2 else None
            if got is None and inner is not None or size(got) > left:
                cut.append(where)
                if isinstance(v, list):
                    break
                continue
            used += head + size(got)
            if isinstance(v, dict):
                out[k] = got
            else:
                out.append(got)
        return {k: out[k] for k in v if k in out} if isinstance(v, dict) else out

    return fit(value, budget, "$"), cut


def fit_documents(rows: DataFrame, key: str, document: str, budget: int) -> DataFrame:
    """key, document (compact JSON) and cut (paths of leaves that are left out, sorted) of nested JSON documents cut to a budget of characters, each key a document.

    A document is taken apart into leaves, in the order of its keys (single values before nested ones) and of its lists. Running sums of what each
    leaf adds to the text, with the brackets and names it opens, tell how many leaves fit; the rest is put together again from the inside. All documents go
    through a level at once; one with a single value that does not fit keeps its outer brackets. Null and broken documents have none (null).
    """
    spark = rows.sparkSession
    step = lambda nested, name, at: F.struct(nested.alias("nested"), name.alias("name"), at.alias("at"))
    kind = lambda v: F.substring_index(F.schema_of_variant(v), "<", 1)
    whole = rows.select(F.col(key).alias("key"), F.try_parse_json(document).alias("v"))
    level = whole.where("v IS NOT NULL").select("key", F.array().cast("array<struct<nested:boolean,name:string,at:int>>").alias("path"), F.array().cast("array<string>").alias("kinds"), "v")
    leaves = None
    while True:
        text, is_nested = F.to_json("v"), kind(F.col("v")).isin("OBJECT", "ARRAY") & ~F.to_json("v").isin("{}", "[]")
        level = level.withColumns({"text": text, "kind": kind(F.col("v")), "inner": is_nested})
        flat = cut(level.select("key", "path", "kinds", "text", "kind", "inner"))
        ended = flat.where("NOT inner").select("key", "path", "kinds", "text")
        leaves = ended if leaves is None else leaves.unionByName(ended)
        deeper = flat.where("inner").select("key", "path", "kinds", "kind", F.parse_json("text").alias("v"))
        if deeper.isEmpty():
            break
        below = deeper.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos").alias("p"), F.col("key").alias("k"), F.col("value").alias("w")))
        in_object = F.col("kind") == "OBJECT"
        placed = step(in_object & kind(F.col("w")).isin("OBJECT", "ARRAY"), F.when(in_object, F.col("k")), F.col("p"))
        level = below.select("key", F.concat("path", F.array(placed)).alias("path"), F.concat("kinds", F.array("kind")).alias("kinds"), F.col("w").alias("v"))
    # A name takes its JSON text and a colon, a nested value its brackets, and all but the first inside a bracket a comma.
    named = lambda s: F.coalesce(F.length(F.to_json(s["name"].cast("variant"))) + 1, F.lit(0))
    order = Window.partitionBy("key").orderBy("path")
    before = F.lag("path").over(order)
    shared = F.coalesce(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("path"), F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get("path", i - 1) == F.get(before, i - 1)), i).otherwise(n)), F.lit(0))
    opened = F.slice("path", shared + 1, F.size("path"))
    adds = F.length("text") + F.aggregate(opened, F.lit(0), lambda n, s: n + named(s)) + 2 * (F.size(opened) - 1) + F.when(before.isNull(), 2).otherwise(1)
    told = leaves.withColumn("adds", F.when(F.size("path") == 0, F.length("text")).otherwise(adds))
    summed = cut(told.withColumn("upto", F.sum("adds").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    where = F.concat(F.lit("$"), F.array_join(F.transform("path", lambda s: F.coalesce(F.concat(F.lit("."), s["name"]), F.concat(F.lit("["), s["at"].cast("string"), F.lit("]")))), ""))
    lost = summed.where(F.col("upto") > budget).groupBy("key").agg(F.sort_array(F.collect_list(where)).alias("cut"))
    built = summed.where(F.col("upto") <= budget).select("key", "path", "kinds", "text")
    depth = built.agg(F.max(F.size("path"))).first()[0] or 0
    while depth > 0:
        last = F.element_at("path", depth)
        part = F.concat(F.coalesce(F.concat(F.to_json(last["name"].cast("variant")), F.lit(":")), F.lit("")), F.col("text"))
        deep = built.where(F.size("path") == depth).select("key", F.slice("path", 1, depth - 1).alias("path"), F.col("kinds"), F.struct(last.alias("s"), part.alias("t")).alias("x"))
        joined = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), ",")
        kinds = F.first("kinds")
        is_object = F.element_at(kinds, depth) == "OBJECT"
        closed = deep.groupBy("key", "path").agg(F.slice(kinds, 1, depth - 1).alias("kinds"), F.when(is_object, F.concat(F.lit("{"), joined, F.lit("}"))).otherwise(F.concat(F.lit("["), joined, F.lit("]"))).alias("text"))
        built = cut(built.where(F.size("path") < depth).unionByName(closed))
        depth -= 1
    empty = F.when(kind(F.col("v")) == "ARRAY", "[]").otherwise("{}")
    out = whole.join(built.select("key", "text"), "key", "left").join(lost, "key", "left")
    return out.select(F.col("key").alias(key), F.when(F.col("v").isNotNull(), F.coalesce("text", empty)).alias(document), F.coalesce("cut", F.array().cast("array<string>")).alias("cut"))
