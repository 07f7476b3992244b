"""Schema state from ordered change events, by joins and windows.

Events have db, file, location, action, table, column, type and new_name, and may have columns (of an index), to_table, options (a map
of texts: null, default, unique, name, column, primary_key, id, to) and part: what belongs to a part that only runs downwards (part
``down`` or ``revert``) is left out.

A name means one thing from the event that gives it until the next one that takes it away: a *binding*. A rename ends the binding of
the old name and starts one of the new name whose parent is the old; pointer doubling leads every binding to the event that made the
table or column. A rename of a name that means nothing does nothing, so what holds of later renames can hang on earlier ones: they are
judged again until no verdict changes, which settles at least the next one each time. Then each event is about the binding that covers
it, and the last event about a table or column tells its state. No database, however long its history, is read as one group in Python.

Creating a table that is there does nothing; neither do events about unknown tables and columns. A column that is added again replaces
the old one and moves to the end; a table or column that is renamed to a name in use replaces what had it. A created table has its key
column, unless its options say ``id`` false or name several columns. Null names mean nothing. Events at one place of a file follow each
other by action, table and column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import singularize
from larkspur.operators.graph import cut

STATE = (
    "db string, kind string, table string, position int, name string, type string, nullable boolean, default string, columns array<string>, unique boolean, to_table string, primary_key string"
)
#: Acts that leave a name with a meaning.
_STARTS = ("add", "create", "to")


def _bindings(marks: DataFrame, scope: list[str]) -> DataFrame:
    """The marks (scope, name, at, act, move) that change what a name means, with until (of a start) and, of a rename's two marks, move.

    act is create (nothing where the name is in use), add (replaces), from and to (the halves of the rename move), or drop.
    """
    marks = cut(marks.where("name IS NOT NULL"))
    w = Window.partitionBy(*scope, "name").orderBy("at")
    live = F.coalesce(F.lag("act").over(w).isin(*_STARTS), F.lit(False))
    void = marks.where("act = 'to'").select("db", "move").limit(0)
    judged = marks.withColumn("live", live)
    seen = (0, None)
    if not marks.where("act = 'to'").isEmpty():
        while True:
            halves = marks.where("move IS NOT NULL")
            moved = halves.groupBy("db", "move").agg(F.count("*").alias("_n")).where("_n < 2").select("db", "move")  # renames to or of nothing
            counted = marks.join(void.withColumn("void", F.lit(True)), ["db", "move"], "left").where("NOT (act = 'to' AND coalesce(void, false))").drop("void")
            judged = cut(counted.withColumn("live", live))
            void = judged.where("act = 'from' AND NOT live").select("db", "move").unionByName(moved).distinct()
            now = void.agg(F.count("*"), F.sum(F.xxhash64("db", "move").cast("decimal(38,0)"))).first()
            if seen == tuple(now):
                break
            seen = tuple(now)
    judged = judged.join(void.withColumn("void", F.lit(True)), ["db", "move"], "left").where("void IS NULL AND NOT (act = 'create' AND live)").drop("void", "live")
    return cut(judged.withColumns({"until": F.lead("at").over(w), "before": F.lag("at").over(w)}))


def _roots(bound: DataFrame) -> DataFrame:
    """db, at (of a start) and root: the start that it goes back to through renames."""
    parent = bound.where("act = 'from'").select("db", "move", F.col("before").alias("up"))
    starts = bound.where(F.col("act").isin(*_STARTS)).select("db", "at", "move")
    links = cut(starts.join(parent, ["db", "move"], "left").select("db", "at", F.coalesce("up", "at").alias("root")))
    left = links.where("at <> root").count()
    while left:
        further = cut(links.alias("a").join(links.select("db", F.col("at").alias("root"), F.col("root").alias("next")).alias("b"), ["db", "root"]).select("db", "at", F.col("next").alias("root")))
        changed = further.join(links, ["db", "at", "root"], "left_anti").isEmpty()
        links = further
        if changed:
            break
    return links


def _about(uses: DataFrame, bound: DataFrame, scope: list[str]) -> DataFrame:
    """uses (scope, name, at, and what they like) with start, the binding of their name that covers them; others are dropped."""
    marks = bound.select(*scope, "name", "at", F.struct(F.col("act").isin(*_STARTS).alias("live"), F.col("at").alias("start")).alias("mark"))
    told = uses.unionByName(marks, allowMissingColumns=True)
    last = F.last("mark", ignorenulls=True).over(Window.partitionBy(*scope, "name").orderBy("at", F.col("mark").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    covered = told.withColumn("last", last).where("mark IS NULL AND last.live").withColumn("start", F.col("last.start"))
    return covered.drop("mark", "last")


def _marks(events: DataFrame, scope: list[str], name: Column, acts: Column) -> DataFrame:
    """One mark for each act (an array of structs of name, act and sub) of an event; renames carry their event's number."""
    rows = events.select(*scope, "seq", F.explode(acts).alias("m"))
    return rows.select(*scope, F.col("m.name").alias("name"), (4 * F.col("seq") + F.col("m.sub")).alias("at"), F.col("m.act").alias("act"), F.when(F.col("m.act").isin("from", "to"), F.col("seq")).alias("move"))


def _act(name: Column, act: str, sub: int = 0) -> Column:
    return F.struct(name.cast("string").alias("name"), F.lit(act).alias("act"), F.lit(sub).alias("sub"))


def replay_schema(events: DataFrame, pk_type: str = "bigint") -> DataFrame:
    """What remains after all events: a row for each column, index and foreign key (kind), with nulls where a field does not apply.

    A table's own key column has primary_key ``true``; a foreign key tells there which column it points to.
    """
    wanted = {"columns": "array<string>", "to_table": "string", "options": "map<string,string>", "part": "string"}
    whole = events.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in wanted.items() if c not in events.columns))
    whole = whole.where("coalesce(part, '') NOT IN ('down', 'revert') AND table <> ''").withColumn("options", F.coalesce("options", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    seq = F.row_number().over(Window.partitionBy("db").orderBy("file", "location", "action", "table", "column")).cast("long")
    whole = cut(whole.select("db", seq.alias("seq"), "action", "table", "column", "type", "new_name", "columns", "to_table", "options"))
    action, option = F.col("action"), lambda key: F.get(F.transform(F.array(F.lit(key)), lambda k: F.try_element_at("options", k)), F.lit(0))

    # Tables: what their names mean, and which table each event is about.
    none = F.array().cast("array<struct<name:string,act:string,sub:int>>")
    renamed = F.array(_act(F.col("table"), "from"), _act(F.col("new_name"), "to", 1))
    table_acts = (
        F.when(action == "create_table", F.array(_act(F.col("table"), "create")))
        .when(action == "drop_table", F.array(_act(F.col("table"), "drop")))
        .when((action == "rename_table") & (F.col("new_name") != F.col("table")), renamed)
        .otherwise(none)
    )
    tables = _bindings(_marks(whole, ["db"], F.col("table"), table_acts), ["db"])
    roots = _roots(tables)
    owner = roots.select("db", F.col("at").alias("start"), F.col("root").alias("of"))
    uses = whole.where(~action.isin("create_table", "drop_table", "rename_table")).select("db", F.col("table").alias("name"), (4 * F.col("seq")).alias("at"), "seq", "action", "column", "type", "new_name", "columns", "to_table", "options")
    inside = _about(uses, tables, ["db"]).join(owner, ["db", "start"]).drop("start", "name", "at")
    made = tables.where("act = 'create'").select("db", F.col("at").alias("of")).join(whole.where(action == "create_table").withColumn("of", 4 * F.col("seq")), ["db", "of"])
    keyed = made.where(~(F.coalesce(option("id"), F.lit("")) == "false") & ~F.coalesce(option("primary_key"), F.lit("")).contains(","))
    own_key = keyed.select(
        "db", "of", "seq", F.lit("own_key").alias("action"), F.coalesce(option("primary_key"), F.lit("id")).alias("column"),
        F.when(option("id").isNull() | (option("id") == "true"), F.lit(pk_type)).otherwise(option("id")).alias("type"), "new_name", "columns", "to_table", "options",
    )
    inside = cut(inside.unionByName(own_key))

    # Columns of a table, in the same way.
    name = F.col("column")
    reference = F.concat(name, F.lit("_id"))
    column_acts = (
        F.when(action.isin("add_column", "own_key"), F.array(_act(name, "add")))
        .when(action.isin("add_reference", "add_belongs_to"), F.array(_act(reference, "add")))
        .when(action == "add_timestamps", F.array(_act(F.lit("created_at"), "add"), _act(F.lit("updated_at"), "add", 1)))
        .when(action == "remove_column", F.array(_act(name, "drop")))
        .when(action == "remove_reference", F.array(_act(reference, "drop")))
        .when((action == "rename_column") & (F.col("new_name") != name), F.array(_act(name, "from"), _act(F.col("new_name"), "to", 1)))
        .otherwise(none)
    )
    scope = ["db", "of"]
    bound = _bindings(_marks(inside, scope, name, column_acts), scope)
    column_roots = _roots(bound)
    first = inside.select("db", "seq", "type", "options", "action").withColumns(
        {"type": F.when(action == "add_timestamps", "datetime").when(action.isin("add_reference", "add_belongs_to"), F.coalesce("type", F.lit(pk_type))).otherwise(F.col("type")), "nullable": (action != "own_key") & ~(F.coalesce(option("null"), F.lit("")) == "false"), "default": option("default"), "own": action == "own_key"}
    )
    changes = inside.where(action.isin("change_column", "change_column_default", "change_column_null")).select("db", "of", name.alias("name"), (4 * F.col("seq")).alias("at"), "action", "type", "options")
    changed = _about(changes, bound, scope).join(column_roots.select("db", F.col("at").alias("start"), "root"), ["db", "start"])
    newest = lambda value, held: F.max_by(F.struct(value.alias("v")), F.when(held, F.col("at")))
    news = changed.groupBy("db", "root").agg(
        newest(F.col("type"), (action == "change_column") & F.col("type").isNotNull()).alias("type_"),
        newest(option("to"), (action == "change_column_default") & F.map_contains_key("options", "to")).alias("default_"),
        newest(option("null") != "false", (action == "change_column_null") & option("null").isNotNull()).alias("null_"),
    )
    final = tables.where(F.col("act").isin(*_STARTS) & F.col("until").isNull()).join(roots, ["db", "at"]).select("db", F.col("root").alias("of"), F.col("name").alias("table"))
    ends = bound.where(F.col("act").isin(*_STARTS) & F.col("until").isNull()).join(column_roots, ["db", "at"]).select("db", "of", "name", "root")
    state = ends.join(final, ["db", "of"]).withColumn("seq", F.expr("root div 4")).join(first.drop("action", "options"), ["db", "seq"]).join(news, ["db", "root"], "left")
    latest = lambda new, old: F.when(F.col(new).isNotNull(), F.col(f"{new}.v")).otherwise(F.col(old)).alias(old)
    place = lambda by: (F.row_number().over(Window.partitionBy("db", "of").orderBy(by)) - 1).alias("position")
    empty = lambda c, kind: F.lit(None).cast(kind).alias(c)
    columns = state.select(
        "db", F.lit("column").alias("kind"), "table", place("root"), "name", latest("type_", "type"), latest("null_", "nullable"), latest("default_", "default"), empty("columns", "array<string>"), empty("unique", "boolean"), empty("to_table", "string"), F.when(F.col("own"), "true").alias("primary_key")
    )
    held = inside.join(final, ["db", "of"])
    indexes = held.where((action == "add_index") & (F.size("columns") > 0)).select(
        "db", F.lit("index").alias("kind"), "table", place("seq"), option("name").alias("name"), empty("type", "string"), empty("nullable", "boolean"), empty("default", "string"), "columns", F.coalesce(option("unique") == "true", F.lit(False)).alias("unique"), empty("to_table", "string"), empty("primary_key", "string")
    )
    keys = held.where(action == "add_foreign_key").select(
        "db", F.lit("foreign_key").alias("kind"), "table", place("seq"), F.coalesce(option("column"), F.concat(singularize(F.col("to_table")), F.lit("_id"))).alias("name"), empty("type", "string"), empty("nullable", "boolean"), empty("default", "string"), empty("columns", "array<string>"), empty("unique", "boolean"), "to_table",
        F.coalesce(option("primary_key"), F.lit("id")).alias("primary_key"),
    )
    return columns.unionByName(indexes).unionByName(keys)


def replay(events: DataFrame, pk_type: str = "bigint") -> DataFrame:
    """The columns that remain after all events: db, table, position, column and type."""
    return replay_schema(events, pk_type).where("kind = 'column'").select("db", "table", "position", F.col("name").alias("column"), "type")


def last_state(events: DataFrame, key: list[str], order: list[str], alive: Column) -> DataFrame:
    """The last event of each key, where it leaves the key alive; enough where nothing is renamed."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").where(alive).drop("_n")
