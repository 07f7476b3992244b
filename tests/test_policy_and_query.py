import pytest

from larkspur.plans import policy, query
from larkspur.plans.policy import Policy
from larkspur.plans.query import Refused, answer, guarded
from larkspur.session import register_views


@pytest.fixture(autouse=True)
def views(spark, sf):
    register_views(spark, sf, ("orders", "customer", "lineitem"))


@pytest.mark.parametrize("word", ["INSERT INTO t VALUES (1)", "UPDATE t SET a = 1", "DELETE FROM t", "DROP TABLE t", "ALTER TABLE t ADD c int", "TRUNCATE TABLE t", "CREATE TABLE t (a int)", "GRANT x TO y", "REVOKE x", "SET a = 1", "COPY t", "MERGE INTO t", "REPLACE INTO t"])
def test_write_statements_are_refused(spark, word):
    assert policy.check_text(word) is not None
    assert policy.check_text(word, Policy(strict_text=True)) is not None


@pytest.mark.parametrize(
    "sql",
    ["SELECT 1; DROP TABLE x", "SELECT * FROM a FOR NO KEY UPDATE", "SHOW PROCESSLIST", "SELECT load_file('x')", "SELECT /*!50000 load_file('x') */ 1", "SELECT secret FROM t", "SELECT substring(api_key, 1, 2) FROM t", "SELECT reflect('a', 'b')", "  ", None],
)
def test_text_policy(sql):
    assert policy.check_text(sql)


def test_order_of_rules_and_exemptions():
    assert "more than one statement" in policy.check_text("SELECT 1; INSERT INTO t VALUES (1)", Policy(strict_text=True))
    assert policy.check_text("SELECT secret FROM t", Policy(allowed=("secret",))) is None
    assert policy.check_text("SELECT salary FROM t", Policy(redacted=("salary",)))
    assert policy.check_text("SELECT 1 UNION SELECT 2") is None
    assert policy.check_text("SELECT 1 UNION ALL SELECT 2", Policy(strict_text=True))


@pytest.mark.parametrize("sql", ["CACHE TABLE orders", "ADD JAR 'x'", "SELECT TRANSFORM(o_orderkey) USING 'cat' FROM orders", "INSERT INTO orders VALUES (1)", "SET spark.x = 1", "BEGIN SELECT 1; END",
    "SELECT `java_method`('java.lang.System', 'getProperty', 'user.name')", "SELECT 1 WHERE `reflect`('a', 'b') = 'c'", "SELECT * FROM orders WHERE o_orderkey IN (SELECT try_reflect('a', 'b'))", "SELECT system.builtin.java_method('a', 'b')",
    "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM orders JOIN parquet.`/x` USING (o_orderkey)", "SELECT * FROM `csv`.`/x`", "SELECT * FROM a.b.c", "SELECT my_udf(1)", "SELECT IDENTIFIER('java_method')('a', 'b')", "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')",
    "SELECT sum(java_method('a', 'b')) OVER (ORDER BY 1) FROM orders", "SELECT transform(array(1), x -> reflect('a', 'b'))", "WITH t AS (SELECT input_file_name() AS f FROM orders) SELECT * FROM t", "SELECT * FROM read_files('/x')"])
def test_plan_policy_refuses(spark, sql):
    assert policy.check_plan(spark, sql)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT o_orderstatus, rank() OVER (ORDER BY count(*)) FROM orders GROUP BY ROLLUP (o_orderstatus) HAVING count(*) > 1",
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r",
        "SELECT * FROM orders o JOIN LATERAL (SELECT count(*) AS n FROM customer WHERE c_custkey = o.o_custkey) LIMIT 3",
        "SELECT explode(array(1, 2))", "SELECT * FROM VALUES (1), (2) AS t(a)", "SELECT 1 EXCEPT SELECT 2", "SELECT * FROM orders TABLESAMPLE (10 ROWS)", "SHOW TABLES", "DESCRIBE orders", "EXPLAIN SELECT 1",
    ],
)
def test_plan_policy_accepts_reading(spark, sql):
    assert policy.check_plan(spark, sql) is None
    assert guarded(spark, sql, 5).count() >= 0


def test_files_stay_closed_whatever_the_session_says(spark):
    spark.conf.set("spark.sql.runSQLOnFiles", "true")
    try:
        for sql in ("SELECT * FROM text.`/etc/hostname`", "SELECT (SELECT max(value) FROM text.`/etc/hostname`)", "SELECT EXISTS (SELECT 1 FROM text.`/etc/hostname`)"):
            assert answer(spark, sql).state == "refused"
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", "false")


def test_named_functions_and_databases(spark):
    spark.udf.register("double_it", lambda x: x * 2, "int")
    assert policy.check_plan(spark, "SELECT double_it(1)") and policy.check_plan(spark, "SELECT double_it(1)", Policy(functions=("double_it",))) is None
    assert policy.check_plan(spark, "SELECT * FROM default.t") is None and policy.check_plan(spark, "SELECT builtin.upper('a')") is None


def test_redaction_is_the_default(spark):
    assert "[FILTERED]" in answer(spark, "SELECT o_custkey FROM orders", 1).text
    assert guarded(spark, "SELECT o_totalprice FROM orders", 1, Policy(encrypted=("o_custkey",))).first()[0] != "[FILTERED]"
    assert answer(spark, "SELECT o_totalprice FROM orders", 1, policy=Policy(encrypted=("o_totalprice",))).state == "refused"
    assert set(guarded(spark, "SELECT * FROM orders", 5, Policy(encrypted=("o_totalprice",))).select("o_totalprice").distinct().collect()) == {("[FILTERED]",)}


def test_cap_cannot_be_avoided(spark):
    sql = "SELECT o_orderkey FROM (SELECT * FROM orders LIMIT 900) -- tail"
    assert guarded(spark, sql, 7).count() == 7
    assert guarded(spark, "SELECT * FROM orders", 5000).count() == min(1000, spark.table("orders").count())
    assert guarded(spark, "SELECT * FROM orders").count() == 100
    assert guarded(spark, "SELECT * FROM orders", 0).count() == 1


def test_answers(spark):
    assert answer(spark, "SELECT 1 AS a, 'x|y' AS b, NULL AS c").text == "| a | b    | c      |\n| - | ---- | ------ |\n| 1 | x\\|y | _NULL_ |\n\n_1 row._"
    assert answer(spark, "SELECT 'a,b' AS x, 'q\"' AS y", form="csv").text == 'x,y\n"a,b","q"""'
    assert answer(spark, "SELECT 1 WHERE false").text == "_No rows._"
    assert answer(spark, "SELECT * FROM nowhere").state == "missing"
    assert answer(spark, "SELECT nothing FROM orders").state == "error"
    assert answer(spark, "DROP TABLE orders").state == "refused"
    assert answer(spark, "SELECT 1", policy=Policy(enabled=False)).state == "refused"
    assert "[FILTERED]" in answer(spark, "SELECT o_custkey FROM orders", 1, policy=Policy(redact=True)).text
    assert "[FILTERED]" not in answer(spark, "SELECT o_custkey FROM orders", 1, policy=Policy(redact=True, allowed=("o_custkey",))).text


def test_timeout_leaves_the_session_usable(spark):
    slow = "SELECT count(*) FROM range(4000000) a JOIN range(4000000) b ON a.id % 100 = b.id % 100"
    assert answer(spark, slow, policy=Policy(timeout_s=1.0)).state == "timeout"
    assert answer(spark, "SELECT 1").state == "ok"


def test_explain(spark):
    shown = answer(spark, "SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey", explain=True)
    assert shown.state == "ok" and any("full scan" in w for w in shown.warnings) and any("Exchange" in w for w in shown.warnings)
    assert answer(spark, "SHOW TABLES", explain=True).state == "refused"
    with pytest.raises(Refused):
        query.explained(spark, "SHOW TABLES")


def test_explain_with_counts(spark):
    shown = query.explained(spark, "SELECT o_orderkey FROM orders WHERE o_totalprice > 0", analyze=True)
    assert shown.warnings == []
    shown = query.explained(spark, "SELECT l_orderkey FROM lineitem", analyze=True)
    assert shown.warnings == [f"FileSourceScan lineitem: full scan ({spark.table('lineitem').count()} rows)"]


def test_plan_nodes_form_a_tree(spark):
    from larkspur.plans import physical

    df = spark.sql("SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) GROUP BY c_mktsegment")
    assert all(n.rows is None for n in physical.nodes(df, ran=False))
    physical.run(df)
    found = {n.id: n for n in physical.nodes(df)}
    assert sum(n.parent is None for n in found.values()) == 1 and all(n.parent is None or found[n.parent].depth == n.depth - 1 for n in found.values())
    assert {"orders", "customer"} <= {n.table for n in found.values()} and any(n.kind == "Subquery" for n in found.values())
    assert physical.node_table(df).count() == len(found)


LINEAGE = [
    ("SELECT c_custkey AS u, c_name FROM customer", [{"c_custkey"}, {"c_name"}]),
    ("SELECT struct(*) AS s, to_json(struct(c_name, c_nationkey)) AS j FROM customer", [{"c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"}, {"c_name", "c_nationkey"}]),
    ("SELECT c_name AS x FROM customer UNION ALL SELECT cast(c_custkey AS string) FROM customer", [{"c_name", "c_custkey"}]),
    ("SELECT c_name FROM customer EXCEPT SELECT c_mktsegment FROM customer", [{"c_name", "c_mktsegment"}]),
    ("SELECT (SELECT max(c_custkey) FROM customer) AS m, 1 AS one", [{"c_custkey"}, set()]),
    ("WITH t AS (SELECT c_custkey AS a, c_name AS b FROM customer) SELECT x.b, y.a + 1 AS z FROM t x JOIN t y ON x.b = y.b", [{"c_name"}, {"c_custkey"}]),
    ("SELECT count(c_custkey) AS n, max(c_name) AS m, c_mktsegment FROM customer GROUP BY ROLLUP (c_mktsegment)", [set(), {"c_name"}, {"c_mktsegment"}]),
    ("SELECT e.v, c_acctbal FROM (SELECT array(c_name, c_mktsegment) AS m, c_acctbal FROM customer) LATERAL VIEW explode(m) e AS v", [{"c_name", "c_mktsegment"}, {"c_acctbal"}]),
    ("SELECT * FROM (SELECT c_name, c_custkey, c_nationkey FROM customer) UNPIVOT (val FOR col IN (c_custkey, c_nationkey))", [{"c_name"}, set(), {"c_custkey", "c_nationkey"}]),
    ("WITH RECURSIVE r(n, d) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey = 1 UNION ALL SELECT n + 1, d + 1 FROM r WHERE d < 3) SELECT * FROM r", [{"c_custkey"}, set()]),
    ("WITH RECURSIVE r(a, b, d) AS (SELECT c_custkey, 'x', 0 FROM customer UNION ALL SELECT 1L, string(a), d + 1 FROM r WHERE d < 3) SELECT b FROM r", [{"c_custkey"}]),
    ("SELECT o_totalprice, l.t FROM orders o, LATERAL (SELECT max(c_name) AS t FROM customer WHERE c_custkey = o.o_custkey) l", [{"o_totalprice"}, {"c_name"}]),
    ("SELECT transform(array(1), x -> x + c_custkey) AS a, sum(c_acctbal) OVER (PARTITION BY c_mktsegment) AS b FROM customer", [{"c_custkey"}, {"c_acctbal", "c_mktsegment"}]),
    ("SELECT c_custkey IS NULL AS gone, coalesce(c_name, c_mktsegment) AS s FROM customer", [set(), {"c_name", "c_mktsegment"}]),
    ("FROM customer |> SELECT c_name AS q, c_custkey AS w |> WHERE w > 1", [{"c_name"}, {"c_custkey"}]),
    ("SELECT any_value(struct(o_custkey, o_orderkey)).o_custkey AS z FROM orders", [{"o_custkey", "o_orderkey"}]),
]


@pytest.mark.parametrize(("sql", "want"), LINEAGE)
def test_lineage(spark, sql, want):
    from larkspur.plans.lineage import sources

    base = {f.name for t in ("customer", "orders") for f in spark.table(t).schema}
    got = [{c for t, c in s if t in ("customer", "orders")} & base for s in sources(spark.sql(sql))]
    assert got == want


def test_redaction_follows_values(spark):
    spark.sql("SELECT c_custkey AS number, c_name AS who, c_acctbal FROM customer").createOrReplaceTempView("people")
    hidden = {("[FILTERED]",)}
    for sql in ("SELECT number FROM people", "SELECT struct(*) AS s FROM people", "SELECT to_json(struct(*)) AS s FROM people", "SELECT s.number AS s FROM (SELECT struct(*) AS s FROM people)", "SELECT 1L AS s UNION SELECT number FROM people"):
        assert set(guarded(spark, sql).distinct().collect()) == hidden, sql
    assert guarded(spark, "SELECT who, who FROM people", 1).columns == ["who", "who"]
    assert guarded(spark, "SELECT number FROM people", policy=Policy(allowed=("c_custkey",))).first()[0] != "[FILTERED]"
    encrypted = spark.createDataFrame([("Customer", "C_ACCTBAL"), ("orders", "who"), (None, None)], "table string, column string")
    row = guarded(spark, "SELECT c_acctbal / 2 AS half, who FROM people", 1, encrypted=encrypted).first()
    assert row.half == "[FILTERED]" and row.who != "[FILTERED]"  # who is encrypted in another table only


def test_bodies_of_commands_are_checked(spark):
    spark.conf.set("spark.sql.runSQLOnFiles", "true")
    try:
        for sql in ("EXPLAIN SELECT reflect('a', 'b')", "DESCRIBE QUERY SELECT * FROM text.`/etc/hostname`", "EXPLAIN SELECT * FROM text.`/etc/hostname`", "EXPLAIN INSERT INTO orders SELECT 1", "DESCRIBE text.`/etc/hostname`"):
            assert answer(spark, sql).state == "refused", sql
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", "false")
    assert answer(spark, "DESCRIBE QUERY SELECT o_orderkey FROM orders").state == "ok"
    assert answer(spark, "SELECT c_name FROM customer WHERE c_name = 'password_digest'").state == "ok"
    assert answer(spark, 'SELECT "password_digest" AS x').state == "refused"


def test_audit_of_a_log(spark):
    log = spark.createDataFrame([(1, "SELECT 1"), (2, "DROP TABLE t"), (3, None), (4, "")], "id int, statement string")
    assert {r.id: r.refused is None for r in policy.refusals(log).collect()} == {1: True, 2: False, 3: False, 4: False}
