"""SQL dumps as relations: tables, columns, keys, indexes and dialects out of the text of dump files of three dialects.

A dump is cut into tokens: comments, quoted texts and names, brackets, commas, semicolons and what lies between. One pass over
the tokens numbers the statements and gives the depth of brackets, so commas inside brackets, quotes and comments separate
nothing, at a cost linear in the text; a statement on one line reads like any other. Quotes are doubled to stand for themselves.
A dump is read where its row lies, and :func:`larkspur.sources.files.files` bounds its size; no token is shuffled, and dumps run in parallel.

Tables of the migration machinery are left out, so are keys and indexes of tables that the dump does not make. Null texts have none.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Comments, quoted texts and names, brackets, commas, semicolons, and what lies between.
_TOKEN = r"""--[^\n]*|(?s:/\*.*?\*/)|'[^']*'|"[^"]*"|`[^`]*`|[(),;]|[^-/'"`(),;]+|[-/'"`]"""
_OPENS = r"(CREATE (TEMPORARY |UNLOGGED )?TABLE|CREATE (UNIQUE )?INDEX|ALTER TABLE)\b"
_NAME = r"(?:[\"`]?\w+[\"`]?\.)*[\"`]?(\w+)[\"`]?"
_TABLE = rf"(?i)^CREATE (?:TEMPORARY |UNLOGGED )?TABLE (?:IF NOT EXISTS )?{_NAME}$"
_INDEX = rf"(?i)^CREATE (UNIQUE )?INDEX (?:CONCURRENTLY )?(?:IF NOT EXISTS )?[\"`]?(\w+)[\"`]? ON (?:ONLY )?{_NAME}(?: USING \w+)?$"

#: Session setting that ends a batch of rows to plain Python functions, and the dumps of a batch: 8 MB of text, as files() bounds them, where Spark's 100 would be 100 MB.
BATCH_ROWS, DUMPS = "spark.sql.execution.python.udf.maxRecordsPerBatch", 8

# SQL type names of dumps by the name they are given, first match first; prefixes of tables that tell nothing about an application.
TYPE_RULES = (
    (r"^tinyint\(1\)", "boolean"), (r"^(int|integer|int4|tinyint|mediumint)\b", "integer"), (r"^(bigint|int8)\b", "bigint"), (r"^(smallint|int2)\b", "smallint"),
    (r"^(character varying|varchar|nvarchar|char)", "string"), (r"^bool", "boolean"), (r"^timestamp|^datetime", "datetime"), (r"^date\b", "date"), (r"^time\b", "time"),
    (r"^(numeric|decimal)", "decimal"), (r"^(real|float|double)", "float"), (r"^jsonb?", "json"), (r"^(bytea|blob|longblob|mediumblob|binary|varbinary)", "binary"), (r"^(text|tinytext|mediumtext|longtext|clob)", "text"), (r"^uuid", "uuid"),
)
INTERNAL = ("ar_internal_metadata", "schema_migrations")


def normal_type(raw: Column) -> Column:
    """The plain name of a dump's column type; an unknown one stays, lower-cased."""
    low = F.lower(F.trim(raw))
    out = None
    for pattern, name in TYPE_RULES:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise(low)


def dialect(text: Column) -> Column:
    """mysql, postgresql, sqlite or unknown, by the marks that only these dump tools leave."""
    return (
        F.when(text.rlike(r"(?i)\)\s*ENGINE=|CREATE TABLE\s+`"), "mysql")
        .when(text.rlike(r"SET search_path|CREATE EXTENSION|ALTER TABLE ONLY|::\w+"), "postgresql")
        .when(text.rlike(r'sqlite_sequence|AUTOINCREMENT|CREATE TABLE\s+(?:IF NOT EXISTS\s+)?"'), "sqlite")
        .otherwise("unknown")
    )


def _reader(pattern: str = _TOKEN, opening: str = _OPENS) -> Callable[[str | None], list]:
    """The reader of one dump: statement, head (its part 0) and its parts by number. Made here, so that it travels whole to workers that cannot import this module."""
    token, opens, gap = re.compile(pattern), re.compile(opening), re.compile(r"\s+", re.ASCII)

    def plain(statement, parts):
        texts = [(k, gap.sub(" ", "".join(toks)).strip(" ")) for k, toks in parts.items() if toks]
        return statement, texts[0][1], texts

    def read(text):
        out, statement, parts = [], 0, None
        for found in token.finditer(text or ""):
            tok = found.group()
            if tok.startswith(("--", "/*")):
                continue
            if tok == ";":
                if parts:
                    out.append(plain(statement, parts))
                statement, parts = statement + 1, None
            elif parts is None:
                if tok.strip(" \t\r\n"):
                    first = gap.sub(" ", tok).strip(" ").upper()
                    parts = {0: [tok]} if opens.match(first) else {}
                    alters, into, depth, bodies, last = first.startswith("ALTER"), parts.get(0), 0, 0, 1
            elif parts and (alters or tok not in ("(", ")", ",")):
                if into is not None:
                    into.append(tok)
            elif parts:
                depth += (tok == "(") - (tok == ")")
                if tok == "(" and depth == 1:
                    bodies += 1
                    into = parts.setdefault(1, []) if bodies == 1 else None
                elif tok == "," and depth == bodies == 1:
                    last += 1
                    into = parts[last] = []
                elif tok == ")" and depth == 0 and bodies:
                    into = None
                elif into is not None:
                    into.append(tok)
        if parts:
            out.append(plain(statement, parts))
        return out

    return read


def statements(dumps: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """key, statement (its number), part, text and made of every statement that makes tables, indexes or constraints.

    Part 0 is what comes before the first bracket, parts from 1 what its commas separate; statements that alter a table have part 0 alone.
    made is what part 0 says the statement makes: kind (table or index), table, and name and unique of an index; null for any other.
    """
    conf = dumps.sparkSession.conf
    if int(conf.get(BATCH_ROWS, "100")) > DUMPS:
        conf.set(BATCH_ROWS, str(DUMPS))
    read = F.udf(_reader(), "array<struct<statement: bigint, head: string, parts: array<struct<part: bigint, text: string>>>>", useArrow=False)
    found = dumps.select(F.col(key).alias("key"), F.explode(read(text)).alias("s")).select("key", "s.*")
    none, head = F.lit(None), F.col("head")
    fields = lambda kind, table, name, unique: F.struct(F.lit(kind).alias("kind"), table.alias("table"), name.cast("string").alias("name"), unique.cast("boolean").alias("unique"))
    told = lambda i: F.regexp_extract(head, _INDEX, i)
    made = F.when(head.rlike(_TABLE), fields("table", F.regexp_extract(head, _TABLE, 1), none, none)).when(head.rlike(_INDEX), fields("index", told(3), told(2), told(1) != ""))
    parts = found.select("key", "statement", made.alias("made"), F.explode("parts").alias("p"))
    return parts.select(F.col("key").alias(key), "statement", "p.part", "p.text", "made")


def _items(parts: DataFrame, key: str) -> DataFrame:
    """What lies in the brackets of the statements that make an index or a table that counts, with what they make."""
    inside = parts.where(F.col("made").isNotNull() & F.col(key).isNotNull() & (F.col("part") > 0) & (F.col("text") != "")).select(key, "statement", "part", "text", "made.*")
    skipped = F.lit(False)
    for prefix in INTERNAL:
        skipped = skipped | F.col("table").startswith(prefix)
    return inside.where((F.col("kind") == "index") | ~skipped)


def dump_tables(parts: DataFrame, key: str = "path") -> DataFrame:
    """key, table, part and text of every definition of every CREATE TABLE, from :func:`statements`."""
    return _items(parts, key).where("kind = 'table'").select(key, "table", "part", "text")


_CONSTRAINT = r"(?i)^(?:PRIMARY|CONSTRAINT|CHECK|UNIQUE|EXCLUDE|FOREIGN)\b|^(?:UNIQUE )?(?:KEY|INDEX) [`\"]"
_STOPS = r"(?i) (?:NOT NULL|NULL|DEFAULT|PRIMARY|UNIQUE|CONSTRAINT|CHECK|AUTO_INCREMENT|AUTOINCREMENT|CHARACTER SET|COLLATE|COMMENT|GENERATED|REFERENCES)\b"


def dump_columns(tables: DataFrame, key: str = "path") -> DataFrame:
    """position, name, type, nullable and default of every column of :func:`dump_tables`; positions have gaps where constraints lie."""
    kept = tables.where(~F.col("text").rlike(_CONSTRAINT) & F.col("text").rlike(r"^[`\"]?\w+[`\"]? \S"))
    name, rest = F.regexp_extract("text", r"^[`\"]?(\w+)", 1), F.regexp_extract("text", r"^[`\"]?\w+[`\"]?( .+)$", 1)
    kind = F.trim(F.get(F.split(rest, _STOPS, 2), F.lit(0)))
    default = F.regexp_extract(rest, r"(?i) DEFAULT ('(?:[^']|'')*+'|\w+\(.*?\)(?= |$)|[^ ]+)", 1)
    bare = F.regexp_replace(rest, r"'[^']*+'", "''")  # what a comment or default says is no constraint
    return kept.where(kind != "").select(
        key, "table", (F.col("part") - 1).alias("position"), name.alias("name"), normal_type(kind).alias("type"), (~bare.rlike(r"(?i)\bNOT NULL\b|\bPRIMARY KEY\b")).alias("nullable"), F.nullif(default, F.lit("")).alias("default")
    )


def _names(listed: Column) -> Column:
    return F.transform(F.split(listed, ","), lambda c: F.regexp_replace(F.trim(c), '["`]', ""))


def dump_keys(parts: DataFrame, key: str = "path") -> DataFrame:
    """table, kind (primary or foreign), columns, to_table and to_columns of every key, in a table's body or added to it later."""
    tables = dump_tables(parts, key)
    altered = rf"(?i)^ALTER TABLE (?:IF EXISTS )?(?:ONLY )?{_NAME} ADD (.*)$"
    later = parts.where((F.col("part") == 0) & F.col("text").rlike(altered)).select(key, F.regexp_extract("text", altered, 1).alias("table"), F.regexp_extract("text", altered, 2).alias("text"))
    # Both sides grow with the dumps, while Spark guesses their sizes from the files read: they are dealt by key, neither is sent whole.
    later = later.join(tables.select(key, "table").distinct().hint("merge"), [key, "table"], "left_semi")
    named = r"^(?:CONSTRAINT [`\"]?\w+[`\"]? )?"
    primary, foreign = rf"(?i){named}PRIMARY KEY ?\(([^)]*)\)", rf"(?i){named}FOREIGN KEY ?\(([^)]*)\) ?REFERENCES {_NAME} ?\(([^)]*)\)"
    inline = rf"(?i)^[`\"]?(\w+)[`\"]? (?!KEY ).*\bPRIMARY KEY\b"
    both = tables.select(key, "table", "text").unionByName(later)
    is_inline = ~F.col("text").rlike(_CONSTRAINT) & F.col("text").rlike(inline)
    none = F.lit(None)
    first = both.where(F.col("text").rlike(primary) | is_inline).select(
        key, "table", F.lit("primary").alias("kind"), _names(F.when(F.col("text").rlike(primary), F.regexp_extract("text", primary, 1)).otherwise(F.regexp_extract("text", inline, 1))).alias("columns"),
        none.cast("string").alias("to_table"), none.cast("array<string>").alias("to_columns"),
    )
    part = lambda i: F.regexp_extract("text", foreign, i)
    other = both.where(F.col("text").rlike(foreign)).select(key, "table", F.lit("foreign").alias("kind"), _names(part(1)).alias("columns"), part(2).alias("to_table"), _names(part(3)).alias("to_columns"))
    return first.unionByName(other)


def dump_indexes(parts: DataFrame, key: str = "path") -> DataFrame:
    """table, name, columns and unique of every index, in a table's body or made later; a column may be an expression.

    The dumps are read once, and what tells of a table and its indexes is dealt by key and table: no join, so no side of one is sent whole.
    """
    body = r"(?i)^(UNIQUE )?(?:KEY|INDEX) [`\"](\w+)[`\"] ?\((.*)\)"
    told = F.when((F.col("kind") == "index") | F.col("text").rlike(body), F.struct("part", "text"))  # a table's other definitions only say that it is made
    dealt = _items(parts, key).select(key, "table", "statement", "kind", "name", "unique", told.alias("told")).repartition(key, "table")
    texts = F.transform(F.sort_array(F.collect_list("told")), lambda x: x["text"])
    known = F.max(F.col("kind") == "table").over(Window.partitionBy(key, "table"))
    made = dealt.groupBy(key, "table", "statement", "kind", "name", "unique").agg(texts.alias("texts")).withColumn("known", known).where("known")
    column = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?i)(?: (?:ASC|DESC|NULLS (?:FIRST|LAST)|\w+_ops))+$", ""), '["`]', "")
    later = F.struct("name", F.transform("texts", column).alias("columns"), "unique")
    part = lambda text, i: F.regexp_extract(text, body, i)
    within = lambda text: F.struct(part(text, 2).alias("name"), F.transform(_names(part(text, 3)), lambda c: F.regexp_extract(c, r"^\w+", 0)).alias("columns"), (part(text, 1) != "").alias("unique"))
    indexes = F.when(F.col("kind") == "index", F.array(later)).otherwise(F.transform("texts", within))
    return made.select(key, "table", F.explode(indexes).alias("x")).select(key, "table", "x.name", "x.columns", "x.unique")


def chosen_dumps(found: DataFrame, path: str = "path", n_tables: str = "n_tables") -> DataFrame:
    """found with database, for the dump that counts of each secondary database: files named after it end in _schema.rb or _structure.sql;
    the former wins over the latter, and a dump without tables does not count. The main dump has no such ending and is not among them."""
    file = F.substring_index(path, "/", -1)
    form = F.when(file.rlike(r"._schema\.rb$"), 0).when(file.rlike(r"._structure\.sql$"), 1)
    named = found.withColumns({"database": F.regexp_replace(file, r"_(?:schema\.rb|structure\.sql)$", ""), "_form": form}).where(F.col("_form").isNotNull() & (F.col(n_tables) > 0))
    folder = F.expr(f"left({path}, length({path}) - length(substring_index({path}, '/', -1)))")
    first = Window.partitionBy(folder, "database").orderBy("_form", path)
    return named.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth", "_form")
