"""The dump reader against a plain reader of characters, and on dumps that are hard to cut."""

import random
import time

from pyspark.sql import functions as F

from larkspur.sources import dumps


def plain_parts(text):
    """Statements and their parts, a character at a time."""
    out, statement, part, depth, bodies, words, i = {}, 0, 0, 0, 0, "", 0
    while i < len(text):
        if text.startswith("--", i):
            i = (text + "\n").index("\n", i)
            continue
        if text.startswith("/*", i) and "*/" in text[i + 2 :]:
            i = text.index("*/", i + 2) + 2
            continue
        c = text[i]
        if c in "'\"`" and c in text[i + 1 :]:
            end = text.index(c, i + 1) + 1
        else:
            end = i + 1
        piece, i = text[i:end], end
        if piece == ";":
            statement, part, depth, bodies = statement + 1, 0, 0, 0
            continue
        depth += (piece == "(") - (piece == ")")
        if piece == "(" and depth == 1:
            bodies += 1
            part = 1 if bodies == 1 else None
        elif piece == "," and depth == 1 and bodies == 1:
            part += 1
        elif piece == ")" and depth == 0:
            part = None
        elif part is not None:
            out[statement, part] = out.get((statement, part), "") + piece
    return {k: " ".join(v.split()) for k, v in out.items() if " ".join(v.split())}


def test_parts_match_a_plain_reader(spark):
    rng = random.Random(4)
    bits = ["a", " b ", "(", ")", ",", "'x,(;'", '"q)"', "`k,`", "\n", "-- c ( '\n", "/* ; ' */", "1", "'it''s'", "numeric(10,2)", "-", "/"]
    rows = []
    for i in range(200):
        made = []
        for j in range(rng.randint(1, 4)):
            body, depth = [], 0
            for _ in range(rng.randint(0, 14)):
                bit = rng.choice(bits)
                if bit == ")" and not depth:
                    continue
                depth += (bit == "(") - (bit == ")")
                body.append(bit)
            made.append(f"CREATE TABLE t{j} ({''.join(body)}{')' * depth}) tail (x, y)")
        rows.append((str(i), ";\n".join(made)))
    found = {}
    for r in dumps.statements(spark.createDataFrame(rows, "path string, content string")).collect():
        if r.text:
            found.setdefault(r.path, {})[r.statement, r.part] = r.text
    for path, text in rows:
        assert found.get(path, {}) == plain_parts(text), text


def test_other_statements_and_odd_dumps(spark):
    rows = [("null", None), ("empty", ""), ("data", "INSERT INTO t VALUES (1, 'a;b');\nCREATE TABLE t (id int);\nCOPY t FROM stdin;"), ("open", "CREATE TABLE u (a int, b text"), ("quote", "CREATE TABLE v (a text DEFAULT 'never closed);")]
    parts = dumps.statements(spark.createDataFrame(rows, "path string, content string"))
    tables = dumps.dump_tables(parts)
    assert {(r.path, r.table) for r in tables.collect()} == {("data", "t"), ("open", "u"), ("quote", "v")}
    assert {(r.table, r.name, r.type) for r in dumps.dump_columns(tables.where("path <> 'quote'")).collect()} == {("t", "id", "integer"), ("u", "a", "integer"), ("u", "b", "text")}


def test_keys_columns_and_indexes_of_each_form(spark):
    text = """CREATE TABLE a (key text, "index" int, x int CHECK (x > 0) DEFAULT 3, FOREIGN KEY (x, key) REFERENCES "s"."b" ("p", "q"), UNIQUE (x));
CREATE TABLE ar_internal_metadata (k text);
ALTER TABLE a ADD CONSTRAINT pk PRIMARY KEY (key);
ALTER TABLE ONLY a ADD CONSTRAINT fk FOREIGN KEY (x) REFERENCES c(id) DEFERRABLE;
ALTER TABLE a ADD COLUMN y int;
CREATE INDEX CONCURRENTLY IF NOT EXISTS i1 ON ONLY s.a USING gin (key gin_trgm_ops, (x + 1) ASC);
CREATE INDEX i2 ON elsewhere (z);"""
    parts = dumps.statements(spark.createDataFrame([("d", text)], "path string, content string"))
    tables = dumps.dump_tables(parts)
    assert [(r.name, r.type, r.nullable, r.default) for r in dumps.dump_columns(tables).orderBy("position").collect()] == [("key", "text", True, None), ("index", "integer", True, None), ("x", "integer", True, "3")]
    keys = {(r.kind, tuple(r.columns), r.to_table, tuple(r.to_columns or ())) for r in dumps.dump_keys(parts).collect()}
    assert keys == {("foreign", ("x", "key"), "b", ("p", "q")), ("primary", ("key",), None, ()), ("foreign", ("x",), "c", ("id",))}
    assert [(r.name, r.columns, r.unique) for r in dumps.dump_indexes(parts).collect()] == [("i1", ["key", "(x + 1)"], False)]


def test_no_side_of_dumps_is_sent_whole(spark):
    text = """CREATE TABLE a (x int, y int, KEY `k` (`x`(3),`y`), UNIQUE KEY `u` (`y`), UNIQUE INDEX "u" ("x"));
CREATE TABLE b (x int PRIMARY KEY);
CREATE TABLE schema_migrations (v int, KEY `none` (`v`));
CREATE UNIQUE INDEX i ON s.b (lower(x), y DESC);
CREATE INDEX i ON a (x);
CREATE INDEX lost ON schema_migrations (v);
CREATE INDEX lost ON other (v);
ALTER TABLE a ADD CONSTRAINT p PRIMARY KEY (x, y);"""
    few = spark.range(3).select(F.col("id").cast("string").alias("path"), F.concat(F.lit(text), F.when(F.col("id") == 2, "CREATE TABLE other (v int)").otherwise("")).alias("content"))
    parts = dumps.statements(few)
    indexes, keys = dumps.dump_indexes(parts), dumps.dump_keys(parts)
    each = [("a", "i", "x", False), ("a", "k", "x|y", False), ("a", "u", "x", True), ("a", "u", "y", True), ("b", "i", "lower(x)|y", True)]
    assert sorted((r.path, r.table, r.name, "|".join(r.columns), r.unique) for r in indexes.collect()) == sorted([(str(i), *x) for i in range(3) for x in each] + [("2", "other", "lost", "v", False)])
    assert sorted((r.path, r.table, "|".join(r.columns)) for r in keys.collect()) == sorted((str(i), *x) for i in range(3) for x in (("a", "x|y"), ("b", "x")))
    for frame in (indexes, keys):  # Spark takes the dumps for small: their texts and tokens are made as it reads
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
    assert indexes._jdf.queryExecution().optimizedPlan().toString().count("BatchEvalPython") == 1
    assert int(spark.conf.get(dumps.BATCH_ROWS)) <= dumps.DUMPS


def test_time_is_linear_in_the_dump(spark):
    def seconds(n):
        text = "CREATE TABLE t (\n" + ",\n".join(f"c{i} numeric(10,2) DEFAULT 'a,(b' NOT NULL" for i in range(n)) + "\n);"
        frame = spark.createDataFrame([("d", text)], "path string, content string")
        began = time.perf_counter()
        assert dumps.dump_columns(dumps.dump_tables(dumps.statements(frame))).where(F.col("type") == "decimal").count() == n
        return time.perf_counter() - began

    seconds(500)
    few, many = seconds(5_000), seconds(40_000)
    assert many < 8 * few + 20


def test_dialects_and_secondary_databases(spark):
    texts = {"mysql": "CREATE TABLE `a` (x int) ENGINE=InnoDB;", "postgresql": "ALTER TABLE ONLY a ADD x;", "sqlite": 'CREATE TABLE "a" (x);', "unknown": "CREATE TABLE a (x int);"}
    frame = spark.createDataFrame(list(texts.items()), "name string, content string")
    assert all(r.name == r.d for r in frame.withColumn("d", dumps.dialect(F.col("content"))).collect())
    listed = [("db/schema.rb", 3), ("db/queue_schema.rb", 2), ("db/queue_structure.sql", 9), ("db/cache_schema.rb", 0), ("db/cache_structure.sql", 1), ("db/none_schema.rb", 0), ("other/queue_structure.sql", 4), ("db/_schema.rb", 1)]
    got = dumps.chosen_dumps(spark.createDataFrame(listed, "path string, n_tables int")).collect()
    assert {(r.path, r.database) for r in got} == {("db/queue_schema.rb", "queue"), ("db/cache_structure.sql", "cache"), ("other/queue_structure.sql", "queue")}
