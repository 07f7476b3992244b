"""Lookups, outer comparisons and anti-joins over metadata relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_details(parents: DataFrame, children: DataFrame, key: str, detail: str, into: str) -> DataFrame:
    """Parents with the sorted set of their children's values; no child gives an empty array."""
    grouped = children.groupBy(key).agg(F.sort_array(F.collect_set(detail)).alias(into))
    return parents.join(grouped, key, "left").withColumn(into, F.coalesce(into, F.array().cast(f"array<{dict(children.dtypes)[detail]}>")))


def hinted(models: DataFrame, columns: DataFrame, key: str) -> DataFrame:
    """Models with their columns' facts and how sure they are: VERIFIED where the table is known, else INFERRED."""
    known = columns.withColumn("_known", F.lit(True))
    return models.join(known, key, "left").withColumn("confidence", F.when(F.col("_known"), "[VERIFIED]").otherwise("[INFERRED]")).drop("_known")


def missing(left: DataFrame, right: DataFrame, on: list[tuple[Column, Column]]) -> DataFrame:
    """Rows of left without a partner in right; each pair of expressions must be equal."""
    condition = F.lit(True)
    for a, b in on:
        condition = condition & (a == b)
    return left.join(right, condition, "left_anti")


def unindexed(columns: DataFrame, indexes: DataFrame, leading_only: bool = False) -> DataFrame:
    """Key-shaped columns (table, name) that no index (table, columns) covers.

    A column with a partner ``<base>_type`` is polymorphic: both must be in one index. leading_only asks for the
    column to lead an index.
    """
    keys = columns.where(F.col("name").endswith("_id")).select("table", "name", F.regexp_replace("name", "_id$", "_type").alias("kind"))
    types = columns.select(F.col("table").alias("_t"), F.col("name").alias("_n"))
    marked = keys.join(types, (F.col("table") == F.col("_t")) & (F.col("kind") == F.col("_n")), "left").withColumn("polymorphic", F.col("_n").isNotNull()).drop("_t", "_n")
    covered = indexes.select(F.col("table").alias("_t"), F.col("columns").alias("_c"))
    inside = F.get("_c", F.lit(0)) == F.col("name") if leading_only else F.array_contains("_c", F.col("name"))
    both = ~F.col("polymorphic") | F.array_contains("_c", F.col("kind"))
    return marked.join(covered, (F.col("table") == F.col("_t")) & inside & both, "left_anti")


def counter_gaps(columns: DataFrame, declared: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Counter columns ``<name>_count`` (table, name) that neither side declares a cache for: not the table's association (table, name), and
    none of the children that say they belong to it and are counted (child, the table of <name>, and parent)."""
    counters = columns.where(F.col("name").endswith("_count")).select("table", "name", F.regexp_replace("name", "_count$", "").alias("of"))
    held = declared.select("table", F.col("name").alias("of"))
    if parents is not None:
        held = held.unionByName(parents.select(F.col("parent").alias("table"), F.col("child").alias("of")))
    return counters.join(held.distinct(), ["table", "of"], "left_anti")


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, token: str = r"\.([A-Za-z_][A-Za-z0-9_]*)", fold: bool = False) -> DataFrame:
    """Keys of texts joined to the names they mention as a token, each once; fold: tokens are lower-cased.

    Tokens are taken out of the text and joined by equality, which holds at any size; the text itself goes nowhere.
    """
    found = F.regexp_extract_all(text, F.lit(token), F.lit(1))
    spread = texts.select(key, F.explode(F.array_distinct(F.transform(found, F.lower) if fold else found)).alias("_token"))
    return spread.join(names, spread["_token"] == names[name]).drop("_token").dropDuplicates()


def repeated_loads(chains: DataFrame, associations: DataFrame, views: DataFrame) -> DataFrame:
    """Controller chains (controller, action, model) that load a model whose association (model, name) their view (controller, action, mention) mentions.

    One row for each controller, action, model and association. Mentions are joined by equality, so no pair of chain and view is
    tried that shares neither.
    """
    loaded = chains.join(associations, "model")
    seen = views.select("controller", "action", F.col("mention").alias("name"))
    return loaded.join(seen, ["controller", "action", "name"], "left_semi").select("controller", "action", "model", "name").distinct()


def unknown_members(named: DataFrame, known: list[DataFrame], keys: list[str], exempt: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """Different rows of named, by keys, that no relation of known has; the first key is the owner.

    exempt: owners about which nothing follows. within: owners that are known at all. Null keys are never unknown.
    """
    every = reduce(DataFrame.unionByName, (k.select(keys) for k in known)).distinct()
    left = named.select(keys).dropna().distinct()
    left = left if within is None else left.join(within.select(keys[0]).distinct(), keys[0], "left_semi")
    left = left if exempt is None else left.join(exempt.select(keys[0]).distinct(), keys[0], "left_anti")
    return left.join(every, keys, "left_anti")


def declared_unindexed(foreign_keys: DataFrame, belongs_to: DataFrame, indexes: DataFrame) -> DataFrame:
    """Declared keys (table, name), from foreign keys and from associations, that lead no index (table, columns)."""
    leading = indexes.select("table", F.get("columns", F.lit(0)).alias("name"))
    return foreign_keys.select("table", "name").unionByName(belongs_to.select("table", "name")).dropna().distinct().join(leading, ["table", "name"], "left_anti")


def changed_without_test(changed: DataFrame, path: str = "path") -> DataFrame:
    """Changed controllers without a changed test under any of its names: a controller or a request test of either framework."""
    base = F.regexp_extract(path, r"^app/controllers/(.*)_controller\.rb$", 1)
    controllers = changed.select(path, base.alias("_base")).where("_base != ''")
    forms = ("spec/controllers/{}_controller_spec.rb", "spec/requests/{}_spec.rb", "test/controllers/{}_controller_test.rb", "test/integration/{}_test.rb")
    wanted = F.array(*(F.concat(F.lit(f.split("{}")[0]), F.col("_base"), F.lit(f.split("{}")[1])) for f in forms))
    tried = controllers.select(path, F.explode(wanted).alias("_test")).join(changed.select(F.col(path).alias("_test")).distinct(), "_test", "left_semi")
    return controllers.select(path).distinct().join(tried.select(path).distinct(), path, "left_anti")


def pending_versions(files: DataFrame, applied: DataFrame, version: str = "version") -> DataFrame:
    """Versions of files that were not applied, compared as numbers: leading zeros and blanks make no difference; what is no number is left out."""
    number = F.expr(f"try_cast(trim({version}) as decimal(38, 0))")
    have = applied.select(number.alias("_v")).where("_v is not null").distinct()
    return files.withColumn("_v", number).where("_v is not null").join(have, "_v", "left_anti").drop("_v")


def head(stream: Column) -> Column:
    """A stream's name up to its first placeholder, a leading @ dropped."""
    return F.substring_index(F.regexp_replace(stream, "^@", ""), "{", 1)


def unmatched_both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Streams of either side without a partner on the other, with the side they are on."""
    return unmatched(left, right, key).select(key, F.lit("left").alias("side")).unionByName(unmatched(right, left, key).select(key, F.lit("right").alias("side")))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Streams of left with no stream of right that is equal or begins alike up to its placeholder."""
    heads = right.select(head(F.col(key)).alias("_head")).distinct()
    return left.join(heads, head(F.col(key)) == F.col("_head"), "left_anti")


def side_by_side(left: DataFrame, right: DataFrame, key: str, value: str, names: tuple[str, str]) -> DataFrame:
    """Sorted values of both sides for each key, with where the key occurs: both, or one side's name."""
    a = left.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(names[0]))
    b = right.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(names[1]))
    place = F.when(F.col(names[0]).isNull(), f"{names[1]} only").when(F.col(names[1]).isNull(), f"{names[0]} only").otherwise("both")
    return a.join(b, key, "full_outer").withColumn("found_in", place)


def resolve(refs: DataFrame, ref: str, targets: DataFrame, target: str, rules: list[tuple[Column, Column]]) -> DataFrame:
    """The first target for each reference under rules tried in order; a rule is a pair of equal expressions of ref and target."""
    parts = []
    for i, (a, b) in enumerate(rules):
        parts.append(refs.select(ref, a.alias("_a")).join(targets.select(target, b.alias("_b")), F.col("_a") == F.col("_b")).select(ref, target, F.lit(i + 1).alias("rule")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = found.groupBy(ref).agg(F.min(F.struct("rule", target)).alias("b"))
    return refs.join(best, ref, "left").select(ref, F.col("b.rule").alias("rule"), F.col(f"b.{target}").alias(target))


def interfaces(polymorphic: DataFrame, owned: DataFrame) -> DataFrame:
    """Polymorphic names joined to the models whose foreign key names them (``<name>_id``)."""
    keyed = owned.withColumn("_as", F.regexp_replace("foreign_key", "_id$", ""))
    return polymorphic.join(keyed, F.col("name") == F.col("_as")).drop("_as")


def first_few(left: DataFrame, right: DataFrame, key: str, value: str, n: int, into: str) -> DataFrame:
    """left with the n smallest different values of its partners."""
    ranked = right.select(key, value).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(value))).where(F.col("_r") <= n)
    few = ranked.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(into))
    return left.join(few, key, "left")


def untested(names: DataFrame, name: str, tests: DataFrame, path: str, truncated: bool = False) -> DataFrame:
    """Names that no test path names; refused when the list of tests was cut short, as nothing follows from it then."""
    if truncated:
        raise ValueError("the list of tests is incomplete")
    parts = tests.select(F.explode(F.regexp_extract_all(F.lower(path), F.lit("[a-z0-9]+"), F.lit(0))).alias("_part")).distinct()
    return names.join(parts, F.lower(F.col(name)) == F.col("_part"), "left_anti")


def listing(columns: DataFrame, models: DataFrame, encrypted: DataFrame, indexes: DataFrame) -> DataFrame:
    """Columns (table, name) of a catalogue with what is known of each: the models (model, table) of its table, sorted, whether one of them keeps it
    encrypted (model, name), and whether an index (table, columns, unique) holds it, leads with it, or makes it unique alone."""
    named = models.groupBy("table").agg(F.sort_array(F.collect_set("model")).alias("models"))
    hidden = encrypted.join(models, "model").select("table", "name").distinct().withColumn("_e", F.lit(True))
    held = indexes.select("table", F.posexplode("columns").alias("_at", "name"), (F.col("unique") & (F.size("columns") == 1)).alias("_u"))
    flags = held.groupBy("table", "name").agg(F.lit(True).alias("_i"), F.bool_or(F.col("_at") == 0).alias("_l"), F.bool_or("_u").alias("_u"))
    whole = columns.join(named, "table", "left").join(hidden, ["table", "name"], "left").join(flags, ["table", "name"], "left")
    flag = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    return whole.select("table", "name", F.coalesce("models", F.array().cast("array<string>")).alias("models"), flag(F.col("_e"), "encrypted"), flag(F.col("_i"), "indexed"), flag(F.col("_l"), "leading"), flag(F.col("_u"), "unique"))
