"""Queries that join, compare, count and walk relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import aggregates, graph, joins, predicates
from larkspur.plans.catalog import query
from larkspur.session import table


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def orphan_anti(spark, sf_dir):
    """Rows without a partner."""
    return joins.missing(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'"), [(F.col("c_custkey"), F.col("o_custkey"))]).select("c_custkey", "c_name")


@query("SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE replace(lower(c_name), 'customer#', '') = replace(lower(s_name), 'supplier#', '') AND c_nationkey = s_nationkey)")
def normalised_anti(spark, sf_dir):
    """An anti-join on normalised names and a second key."""
    plain = lambda c, p: F.replace(F.lower(c), F.lit(p), F.lit(""))
    on = [(plain("s_name", "supplier#"), plain("c_name", "customer#")), (F.col("s_nationkey"), F.col("c_nationkey"))]
    return joins.missing(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer"), on).select("s_suppkey")


@query("""
SELECT page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT split_part(regexp_replace(url || '{x}', '^@', ''), '{', 1) AS h FROM pages WHERE html LIKE '%&amp;%') q WHERE q.h = split_part(regexp_replace(p.url || '{y}', '^@', ''), '{', 1))
""")
def fuzzy_anti(spark, sf_dir):
    """Streams without a partner that begins alike up to its placeholder."""
    pages = table(spark, sf_dir, "pages")
    left = pages.select("page_id", F.concat("url", F.lit("{y}")).alias("stream"))
    right = pages.where(F.col("html").contains("&amp;")).select(F.concat("url", F.lit("{x}")).alias("stream"))
    return joins.unmatched(left, right, "stream").select("page_id")


@query("""
SELECT n_nationkey, CASE WHEN c.k IS NULL THEN 'suppliers only' WHEN s.k IS NULL THEN 'customers only' ELSE 'both' END AS found_in, c.customers, s.suppliers FROM
(SELECT c_nationkey AS k, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS customers FROM customer WHERE c_nationkey > 3 GROUP BY 1) c
FULL OUTER JOIN (SELECT s_nationkey AS k, string_agg(DISTINCT CAST(floor(s_acctbal / 5000) AS VARCHAR), '|' ORDER BY CAST(floor(s_acctbal / 5000) AS VARCHAR)) AS suppliers FROM supplier WHERE s_nationkey < 20 GROUP BY 1) s ON c.k = s.k
JOIN nation ON n_nationkey = coalesce(c.k, s.k)
""".replace("CAST(floor(s_acctbal / 5000) AS VARCHAR)", "CAST(CAST(floor(s_acctbal / 5000) AS BIGINT) AS VARCHAR)"))
def full_outer_label(spark, sf_dir):
    """Both sides of a key, and where it occurs."""
    left = table(spark, sf_dir, "customer").where("c_nationkey > 3").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("v"))
    right = table(spark, sf_dir, "supplier").where("s_nationkey < 20").select(F.col("s_nationkey").alias("n_nationkey"), F.floor(F.col("s_acctbal") / 5000).cast("string").alias("v"))
    both = joins.side_by_side(left, right, "n_nationkey", "v", ("customers", "suppliers"))
    return both.select("n_nationkey", "found_in", F.array_join("customers", "|").alias("customers"), F.array_join("suppliers", "|").alias("suppliers"))


@query("SELECT d.doc_id, quality, CASE WHEN l.doc_id IS NULL THEN '[INFERRED]' ELSE '[VERIFIED]' END AS confidence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_hint(spark, sf_dir):
    """A left join that says how sure it is."""
    return joins.hinted(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "confidence")


@query("SELECT n_nationkey, n_name, coalesce((SELECT string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey), '') AS segments FROM nation")
def with_details(spark, sf_dir):
    """Parents with the set of their children's values."""
    children = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    out = joins.with_details(table(spark, sf_dir, "nation"), children, "n_nationkey", "c_mktsegment", "segments")
    return out.select("n_nationkey", "n_name", F.array_join("segments", "|").alias("segments"))


#: Columns and indexes of a table for each brand, out of its parts.
_SCHEMA = """WITH columns AS (
  SELECT DISTINCT lower(p_brand) AS "table", lower(p_type) || CASE WHEN p_size % 5 = 0 THEN '_type' WHEN p_size % 3 = 0 THEN '_count' ELSE '_id' END AS name FROM part
), indexes AS (
  SELECT lower(p_brand) AS "table", CASE p_partkey % 3 WHEN 0 THEN [lower(p_type) || '_id'] WHEN 1 THEN ['created_at', lower(p_type) || '_id'] ELSE [lower(p_type) || '_id', lower(p_type) || '_type'] END AS columns FROM part WHERE p_size % 7 = 0
), keys AS (
  SELECT k."table", k.name, t.name AS kind FROM columns k LEFT JOIN columns t ON t."table" = k."table" AND t.name = replace(k.name, '_id', '_type') WHERE k.name LIKE '%\\_id' ESCAPE '\\'
)"""


def _relations(spark, sf_dir):
    part, low = table(spark, sf_dir, "part"), F.lower("p_type")
    end = F.when(F.col("p_size") % 5 == 0, "_type").when(F.col("p_size") % 3 == 0, "_count").otherwise("_id")
    columns = part.select(F.lower("p_brand").alias("table"), F.concat(low, end).alias("name")).distinct()
    key, kind, three = F.concat(low, F.lit("_id")), F.concat(low, F.lit("_type")), F.col("p_partkey") % 3
    listed = F.when(three == 0, F.array(key)).when(three == 1, F.array(F.lit("created_at"), key)).otherwise(F.array(key, kind))
    return columns, part.where("p_size % 7 = 0").select(F.lower("p_brand").alias("table"), listed.alias("columns"))


@query(f"""
{_SCHEMA}
SELECT k."table", k.name, k.kind IS NOT NULL AS polymorphic FROM keys k
WHERE NOT EXISTS (SELECT 1 FROM indexes i WHERE i."table" = k."table" AND list_contains(i.columns, k.name) AND (k.kind IS NULL OR list_contains(i.columns, k.kind)))
""")
def unindexed_keys(spark, sf_dir):
    """Key-shaped columns in no index; a polymorphic pair needs both in one."""
    return joins.unindexed(*_relations(spark, sf_dir)).select("table", "name", "polymorphic")


@query(f"""
{_SCHEMA}
SELECT k."table", k.name FROM keys k WHERE NOT EXISTS (SELECT 1 FROM indexes i WHERE i."table" = k."table" AND i.columns[1] = k.name AND (k.kind IS NULL OR list_contains(i.columns, k.kind)))
""")
def unindexed_leading(spark, sf_dir):
    """Key-shaped columns that lead no index."""
    return joins.unindexed(*_relations(spark, sf_dir), leading_only=True).select("table", "name")


@query(f"""
{_SCHEMA}, declared AS (SELECT DISTINCT lower(p_brand) AS "table", lower(p_type) AS name FROM part WHERE p_partkey % 31 = 0), parents AS (SELECT DISTINCT lower(p_type) AS child, lower(p_brand) AS parent FROM part WHERE p_partkey % 37 = 0)
SELECT c."table", c.name FROM columns c WHERE c.name LIKE '%\\_count' ESCAPE '\\' AND NOT EXISTS (SELECT 1 FROM declared d WHERE d."table" = c."table" AND d.name || '_count' = c.name)
  AND NOT EXISTS (SELECT 1 FROM parents p WHERE p.parent = c."table" AND p.child || '_count' = c.name)
""")
def counter_gaps(spark, sf_dir):
    """Counter columns that neither side of an association declares."""
    part = table(spark, sf_dir, "part")
    declared = part.where("p_partkey % 31 = 0").select(F.lower("p_brand").alias("table"), F.lower("p_type").alias("name"))
    parents = part.where("p_partkey % 37 = 0").select(F.lower("p_type").alias("child"), F.lower("p_brand").alias("parent"))
    return joins.counter_gaps(_relations(spark, sf_dir)[0], declared, parents).select("table", "name")


@query("SELECT DISTINCT doc_id, word FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '([A-Za-z]+)', 1))) AS word FROM documents) WHERE word IN (SELECT DISTINCT unnest(string_split(p_name, ' ')) FROM part) OR word IN ('the', 'und', 'que')")
def mention_join(spark, sf_dir):
    """Texts joined to the names they mention, by token instead of by pattern."""
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).unionByName(spark.createDataFrame([("the",), ("und",), ("que",)], "word string")).distinct()
    return joins.mentions(table(spark, sf_dir, "documents"), "doc_id", "text", names, "word", "([A-Za-z]+)", fold=True).select("doc_id", "word")


@query("""
SELECT p_partkey, CASE WHEN b.k IS NOT NULL THEN 1 WHEN t.k IS NOT NULL THEN 2 END AS rule, coalesce(b.s, t.s) AS s_suppkey FROM part
LEFT JOIN (SELECT s_suppkey AS k, s_suppkey AS s FROM supplier) b ON b.k = p_partkey LEFT JOIN (SELECT s_suppkey * 3 AS k, min(s_suppkey) AS s FROM supplier GROUP BY 1) t ON t.k = p_partkey
""")
def priority_lookup(spark, sf_dir):
    """The first rule that finds a target wins."""
    rules = [(F.col("p_partkey"), F.col("s_suppkey")), (F.col("p_partkey"), F.col("s_suppkey") * 3)]
    return joins.resolve(table(spark, sf_dir, "part"), "p_partkey", table(spark, sf_dir, "supplier"), "s_suppkey", rules)


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#99') GROUP BY p_brand")
def notable_lookup(spark, sf_dir):
    """A catalogue of known names met in a table."""
    known = spark.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#99",)], "p_brand string")
    return aggregates.tally(table(spark, sf_dir, "part").join(F.broadcast(known), "p_brand"), "p_brand")


@query("SELECT n_name AS name, c_custkey FROM nation JOIN customer ON lower(n_name) = 'nation_' || c_nationkey")
def interface_join(spark, sf_dir):
    """Names joined to the foreign keys that carry them."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), F.lower("n_name").alias("name"))
    owned = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("nation_"), "c_nationkey", F.lit("_id")).alias("foreign_key"))
    return joins.interfaces(names, owned).select(F.col("title").alias("name"), "c_custkey")


@query("SELECT c_custkey, (SELECT string_agg(k, '|' ORDER BY k) FROM (SELECT DISTINCT o_orderpriority AS k FROM orders WHERE o_custkey = c_custkey ORDER BY k LIMIT 2)) AS first_two FROM customer")
def first_callers(spark, sf_dir):
    """The first two partners of each row."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    out = joins.first_few(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_orderpriority", 2, "first_two")
    return out.select("c_custkey", F.array_join("first_two", "|").alias("first_two"))


@query("SELECT DISTINCT p_type FROM part WHERE lower(p_type) NOT IN (SELECT unnest(string_split(p_name, ' ')) FROM part)")
def test_gaps(spark, sf_dir):
    """Names that no path names."""
    part = table(spark, sf_dir, "part")
    return joins.untested(part.select("p_type").distinct(), "p_type", part, "p_name")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def tally(spark, sf_dir):
    """Counts by one or two keys."""
    return aggregates.tally(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def tally_and_mode(spark, sf_dir):
    """A3, A4: the commonest type of each user; ties go to the smaller name."""
    return aggregates.most_frequent(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT year(o_orderdate) AS year, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY 1")
def year_histogram(spark, sf_dir):
    """A5: rows by year with conditional counts."""
    status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"), status("F").alias("finished"), status("O").alias("open"))


@query("SELECT event_type, count(*) AS n, (SELECT string_agg(CAST(u AS VARCHAR), '|' ORDER BY CAST(u AS VARCHAR)) FROM (SELECT DISTINCT user_id AS u FROM events i WHERE i.event_type = e.event_type ORDER BY u LIMIT 3)) AS sample FROM events e GROUP BY event_type")
def sample_groups(spark, sf_dir):
    """Groups with a sample of their members."""
    return aggregates.sample_of(table(spark, sf_dir, "events").select("event_type", "user_id"), "event_type", "user_id").select("event_type", "n", "sample")


@query("""
SELECT CASE WHEN grouping(l_returnflag) = 1 THEN NULL ELSE l_returnflag END AS l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN NULL ELSE l_linestatus END AS l_linestatus, count(*) AS n
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))
""")
def warning_sets(spark, sf_dir):
    """Counts by two keys apart."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf_dir, "lineitem").groupingSets([[flag], [status]], flag, status).agg(F.count("*").alias("n"))


@query("""
SELECT count(*) FILTER (risk = 'high') AS high, count(*) FILTER (risk = 'medium') AS medium, count(*) FILTER (risk = 'low') AS low FROM (
  SELECT CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' ELSE 'low' END AS risk FROM documents JOIN labels USING (doc_id))
""")
def risk_histogram(spark, sf_dir):
    """Risk levels in one row."""
    risk = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("low")
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    return aggregates.histogram(joined, risk, ["high", "medium", "low"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark, sf_dir):
    """A10: totals at every level."""
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
WITH ref AS (SELECT DISTINCT o_orderpriority AS k FROM orders UNION SELECT 'x'), have AS (SELECT DISTINCT o_orderstatus AS g, o_orderpriority AS k FROM orders UNION SELECT 'O', 'y')
SELECT g AS o_orderstatus, count(ref.k) AS present, count(*) FILTER (ref.k IS NULL) AS extra, (SELECT count(*) FROM ref) - count(ref.k) AS missing, round(100.0 * count(ref.k) / (SELECT count(*) FROM ref), 1) AS pct
FROM have LEFT JOIN ref ON have.k = ref.k GROUP BY g
""")
def coverage_pct(spark, sf_dir):
    """Keys each group has, lacks and adds."""
    orders = table(spark, sf_dir, "orders")
    ref = orders.select(F.col("o_orderpriority").alias("k")).distinct().unionByName(spark.createDataFrame([("x",)], "k string"))
    have = orders.select("o_orderstatus", F.col("o_orderpriority").alias("k")).unionByName(spark.createDataFrame([("O", "y")], "o_orderstatus string, k string"))
    return aggregates.coverage(ref, have, "o_orderstatus", "k")


@query("SELECT l_linestatus, CASE WHEN sum(l_quantity) > 0 THEN round(100.0 * sum(l_discount * l_quantity) / sum(l_quantity), 1) END AS pct FROM lineitem GROUP BY 1")
def utilization(spark, sf_dir):
    """Guarded division of totals."""
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(aggregates.percent(F.sum(F.col("l_discount") * F.col("l_quantity")), F.sum("l_quantity")).alias("pct"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def array_usage(spark, sf_dir):
    """Members of arrays, counted."""
    return aggregates.tally(table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")), "word")


@query("SELECT signature, count(*) AS n, min(l_orderkey) AS first_member, string_agg(l_orderkey, '|' ORDER BY l_orderkey) AS members FROM (SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS signature FROM lineitem GROUP BY l_orderkey) GROUP BY signature HAVING count(*) >= 3")
def group_signature(spark, sf_dir):
    """Orders of equal structure, three or more, with their members."""
    shape = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat("l_returnflag", "l_linestatus"))), ",").alias("s"))
    rows = aggregates.signature_members(shape, "l_orderkey", F.col("s"))
    members = F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list("members"))), lambda m: m.cast("string")), "|")
    return rows.groupBy("signature").agg(F.max("n").alias("n"), F.min(F.get("members", F.lit(0))).alias("first_member"), members.alias("members"))


@query("SELECT l_orderkey, l_suppkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS joined FROM lineitem GROUP BY ALL")
def merge_pairs(spark, sf_dir):
    """Values of a pair merged into one row."""
    return aggregates.joined_set(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"], "l_returnflag")


@query("""
WITH r AS (SELECT 'n' || c_nationkey AS path, CASE WHEN c_custkey % 4 < 3 THEN 'update' ELSE 'show' END AS action, CASE c_custkey % 4 WHEN 0 THEN 'PUT' WHEN 1 THEN CASE WHEN c_acctbal > 9000 THEN 'PATCH' ELSE 'PUT' END WHEN 2 THEN 'POST' ELSE 'GET' END AS verb FROM customer)
SELECT path, action, string_agg(DISTINCT verb, '|' ORDER BY verb) AS verb FROM r GROUP BY path, action, verb IN ('PUT', 'PATCH'), CASE WHEN verb NOT IN ('PUT', 'PATCH') THEN verb END
""")
def merge_verbs(spark, sf_dir):
    """Two verbs of one action."""
    four = F.col("c_custkey") % 4
    verb = F.when(four == 0, "PUT").when((four == 1) & (F.col("c_acctbal") > 9000), "PATCH").when(four == 1, "PUT").when(four == 2, "POST").otherwise("GET")
    return aggregates.merged_verbs(table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("path"), F.when(four < 3, "update").otherwise("show").alias("action"), verb.alias("verb")))


@query("SELECT max(CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT)) AS newest, count(*) AS n FROM customer")
def newest_version(spark, sf_dir):
    """The largest version, compared as a number."""
    return table(spark, sf_dir, "customer").agg(F.max(F.regexp_extract("c_name", "([0-9]+)", 1).cast("long")).alias("newest"), F.count("*").alias("n"))


@query("SELECT count(*) FILTER (starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#2')) AS framework, count(*) FILTER (NOT (starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#2'))) AS app FROM part")
def prefix_totals(spark, sf_dir):
    """Totals on both sides of a list of prefixes."""
    hit = predicates.starts_with_any(F.col("p_brand"), ["Brand#1", "Brand#2"])
    return table(spark, sf_dir, "part").agg(F.count_if(hit).alias("framework"), F.count_if(~hit).alias("app"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, 'T'))) AS added, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, 'A'))) AS removed FROM documents")
def diff_lines(spark, sf_dir):
    """Lines that begin with a mark."""
    lines = F.split("text", "\n", -1)
    starts = lambda m: F.size(F.filter(lines, lambda x: x.startswith(m))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", starts("T").alias("added"), starts("A").alias("removed"))


@query("SELECT n_nationkey AS k, 'both' AS side FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT c_nationkey, 'left' FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT s_nationkey, 'right' FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)")
def set_ops(spark, sf_dir):
    """Intersection and both differences, put together."""
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    side = lambda df, s: df.withColumn("side", F.lit(s))
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "left")).unionByName(side(b.subtract(a), "right"))


_MEMBERS = """
WITH m AS (
  SELECT DISTINCT 'c' || o_custkey AS owner, o_orderpriority AS name FROM orders
  UNION SELECT 'n' || c_nationkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 490000
  UNION SELECT 'r' || n_regionkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT 'r' || r_regionkey, '5-LOW' FROM region
), a AS (
  SELECT 'c' || c_custkey AS node, unnest(['c' || c_custkey, 'n' || c_nationkey, 'r' || n_regionkey]) AS ancestor, unnest([0, 1, 2]) AS distance FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'n' || n_nationkey, unnest(['n' || n_nationkey, 'r' || n_regionkey]), unnest([0, 1]) FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region
)"""


def _levels(spark, sf_dir):
    """Parents of customers, nations and regions, and the names that each of them has."""
    t = lambda name: table(spark, sf_dir, name)
    node = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    parents = t("customer").select(node("c", "c_custkey").alias("node"), node("n", "c_nationkey").alias("parent"))
    parents = parents.unionByName(t("nation").select(node("n", "n_nationkey").alias("node"), node("r", "n_regionkey").alias("parent")))
    parents = parents.unionByName(t("region").select(node("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent")))
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    whole = orders.join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    owned = [
        t("orders").select(node("c", "o_custkey").alias("owner"), F.col("o_orderpriority").alias("name")),
        orders.where("o_totalprice > 490000").select(node("n", "c_nationkey").alias("owner"), F.col("o_orderpriority").alias("name")),
        whole.select(node("r", "n_regionkey").alias("owner"), F.col("o_orderstatus").alias("name")),
        t("region").select(node("r", "r_regionkey").alias("owner"), F.lit("5-LOW").alias("name")),
    ]
    return parents, reduce(DataFrame.unionByName, owned).distinct()


@query(f"{_MEMBERS} SELECT owner, name FROM m WHERE NOT EXISTS (SELECT 1 FROM a JOIN m AS i ON i.owner = a.ancestor WHERE a.node = m.owner AND a.distance > 0 AND i.name = m.name)")
def inherited_methods(spark, sf_dir):
    """U4: members of three levels without those that are inherited."""
    return graph.own_members(*_levels(spark, sf_dir))


@query(f"{_MEMBERS} SELECT node, name, arg_min(ancestor, distance) AS origin, CAST(min(distance) AS INTEGER) AS distance FROM a JOIN m ON m.owner = a.ancestor GROUP BY node, name")
def visible_members(spark, sf_dir):
    """Members of three levels, inherited ones too; the nearest owner of a name wins."""
    return graph.visible_members(*_levels(spark, sf_dir))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority IN ('1-URGENT', '2-HIGH') WHEN o_orderstatus = 'O' THEN o_orderpriority <> '5-LOW' ELSE true END AS applies FROM orders")
def applicability(spark, sf_dir):
    """P5: only, except and neither."""
    empty = F.array().cast("array<string>")
    only = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).otherwise(empty)
    skipped = F.when(F.col("o_orderstatus") == "O", F.array(F.lit("5-LOW"))).otherwise(empty)
    return table(spark, sf_dir, "orders").select("o_orderkey", predicates.applies(only, skipped, F.col("o_orderpriority")).alias("applies"))


@query("SELECT c_nationkey, string_agg(m, '|' ORDER BY m) AS found FROM (SELECT DISTINCT c_nationkey, CASE WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'heavy' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'light' END AS m FROM customer) WHERE m IS NOT NULL GROUP BY 1")
def pattern_sets(spark, sf_dir):
    """Which patterns a group's members show."""
    found = predicates.patterns_found(F.collect_set("c_mktsegment"), {"heavy": ["MACHINERY", "FURNITURE"], "light": ["HOUSEHOLD"]})
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(found, "|").alias("found")).where("found <> ''")


@query("SELECT p_partkey, replace(initcap_, ' ', '') AS model, tbl FROM (SELECT p_partkey, upper(left(w, 1)) || substr(w, 2) || CASE WHEN p_size % 2 = 0 THEN 's' ELSE '' END AS initcap_, w || CASE WHEN p_size % 3 = 0 THEN '' ELSE 's' END AS tbl, w FROM (SELECT *, split_part(p_name, ' ', 2) AS w FROM part)) WHERE w = 'widget'")
def model_filter(spark, sf_dir):
    """Models by their name or table, plural or singular."""
    w = F.substring_index("p_name", " ", -1)
    model = F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 100), F.when(F.col("p_size") % 2 == 0, "s").otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", model.alias("model"), F.concat(w, F.when(F.col("p_size") % 3 == 0, "").otherwise("s")).alias("tbl"))
    return rows.where(predicates.model_matches(F.col("model"), F.col("tbl"), "Widgets"))


@query("SELECT name FROM (SELECT DISTINCT upper(left(a, 1)) || substr(a, 2) || upper(left(b, 1)) || substr(b, 2) AS name, a, b FROM (SELECT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)) WHERE a = 'red' AND b = 'widget'")
def fuzzy_key(spark, sf_dir):
    """P10: a name by its table's name."""
    names = table(spark, sf_dir, "part").select(F.array_join(F.transform(F.split("p_name", " "), F.initcap), "").alias("name")).distinct()
    return predicates.fuzzy_key(names, "name", "red_widgets").select("name")


def _edges(spark, sf_dir):
    """Customers to the states of their orders, every other one through the order's priority."""
    through = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("p"), "o_orderpriority"))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "o_orderstatus").alias("dst"), F.lit("has_many").alias("type"), through.alias("through"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
h0 AS (SELECT 'p1' AS node), h1 AS (SELECT DISTINCT b AS node FROM both_ways WHERE a IN (SELECT node FROM h0) AND b NOT IN (SELECT node FROM h0)),
h2 AS (SELECT DISTINCT b AS node FROM both_ways WHERE a IN (SELECT node FROM h1) AND b NOT IN (SELECT node FROM h0) AND b NOT IN (SELECT node FROM h1))
SELECT node, 0 AS distance FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2
""")
def khop(spark, sf_dir):
    """Two steps around a part."""
    items = table(spark, sf_dir, "lineitem")
    edges = items.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    return graph.neighbourhood(edges, spark.createDataFrame([("p1",)], "node string"), 2)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_quantity >= 49 AND l_partkey IN (SELECT s_suppkey FROM supplier)),
w(path, here) AS (SELECT [src], dst FROM e UNION ALL SELECT list_append(path, here), e.dst FROM w JOIN e ON e.src = here WHERE here > path[1] AND NOT list_contains(path, here) AND len(path) < 6)
SELECT array_to_string(path, '|') AS cycle FROM w WHERE here = path[1]
""")
def cycles(spark, sf_dir):
    """All simple cycles of up to six nodes in the graph of the largest sales, each once."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_partkey"))
    edges = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").join(suppliers, "l_partkey", "left_semi").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graph.cycles(edges, 6).select(F.array_join("path", "|").alias("cycle"))


@query("""
SELECT o_orderkey AS id, o_orderstatus AS src, CASE WHEN o_orderkey % 3 = 0 THEN 'Person' WHEN o_orderkey % 3 = 1 THEN 'Order' ELSE 'OrderItem' END || CASE WHEN o_orderkey % 3 > 0 THEN CASE o_orderstatus WHEN 'F' THEN 'Box' WHEN 'O' THEN 'Category' ELSE 'Status' END ELSE '' END AS dst FROM orders
""")
def association_edges(spark, sf_dir):
    """G1: the target is the class named, else the name as a class."""
    k = F.col("o_orderkey") % 3
    many = F.when(F.col("o_orderstatus") == "F", "boxes").when(F.col("o_orderstatus") == "O", "categories").otherwise("statuses")
    rows = table(spark, sf_dir, "orders").select(
        F.struct("o_orderkey", "o_orderstatus").alias("model"), F.concat(F.when(k == 1, "order_").otherwise("order_item_"), many).alias("name"), F.lit("has_many").alias("type"), F.when(k == 0, "Person").alias("class_name"), F.lit(None).cast("string").alias("through"), F.lit(False).alias("polymorphic")
    )
    return graph.association_edges(rows).select(F.col("src.o_orderkey").alias("id"), F.col("src.o_orderstatus").alias("src"), "dst")


@query("""
WITH e AS (SELECT 'c' || o_custkey AS src, 's' || o_orderstatus AS dst, CASE WHEN o_orderkey % 2 = 0 THEN 'p' || o_orderpriority END AS through FROM orders)
SELECT src, coalesce(through, dst) AS dst FROM e UNION SELECT through, dst FROM e WHERE through IS NOT NULL
""")
def through_edges(spark, sf_dir):
    """An edge through a third node as two."""
    return graph.through_hops(_edges(spark, sf_dir))


@query("""
WITH e AS (SELECT 'c' || o_custkey AS src, 's' || o_orderstatus AS dst FROM orders), chosen AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_nationkey = 3 UNION SELECT 'sP')
SELECT DISTINCT node FROM (SELECT dst AS node FROM e WHERE src IN (SELECT node FROM chosen) UNION ALL SELECT src FROM e WHERE dst IN (SELECT node FROM chosen)) WHERE node NOT IN (SELECT node FROM chosen)
""")
def related_nodes(spark, sf_dir):
    """One step outside the chosen nodes."""
    chosen = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.concat(F.lit("c"), "c_custkey").alias("node")).unionByName(spark.createDataFrame([("sP",)], "node string"))
    return graph.related(_edges(spark, sf_dir), chosen)


@query("""
WITH RECURSIVE up(node, here, distance) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT node, here // 10, distance + 1 FROM up WHERE here > 0)
SELECT node, arg_min(here, distance) AS ancestor, CAST(min(distance) AS INTEGER) AS distance FROM up WHERE here IN (SELECT o_custkey FROM orders) GROUP BY node
""")
def nearest_ancestor(spark, sf_dir):
    """The nearest ancestor that has rows."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    parents = customers.select("node", F.when(F.col("node") > 0, F.floor(F.col("node") / 10)).alias("parent"))
    return graph.nearest_with_rows(parents, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node")).distinct())


@query("WITH RECURSIVE r(node, depth) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT p_partkey, depth + 1 FROM part JOIN r ON p_partkey = node * 2 OR p_partkey = node * 3) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node")
def inclusion_closure(spark, sf_dir):
    """Files that draw other files, until nothing new is met."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dst"))
    by = lambda k: parts.where(f"dst % {k} = 0").select((F.col("dst") / k).cast("long").alias("src"), "dst")
    return graph.closure(by(2).unionByName(by(3)), spark.createDataFrame([(1,)], "node long"))


@query("SELECT o_custkey AS src, string_agg(DISTINCT o_custkey || ' --> ' || o_orderstatus, chr(10) ORDER BY o_custkey || ' --> ' || o_orderstatus) AS lines FROM orders GROUP BY o_custkey")
def graph_text(spark, sf_dir):
    """K8: edges as lines of a flow chart."""
    return graph.as_text(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("dst")))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'Machinery' ELSE upper(left(lower(c_mktsegment), 1)) || substr(lower(c_mktsegment), 2) END AS name FROM customer")
def camel_names(spark, sf_dir):
    """String case: words to class names."""
    return table(spark, sf_dir, "customer").select("c_custkey", text.camelize(F.lower("c_mktsegment")).alias("name"))


@query(f"""
{_SCHEMA}, models AS (SELECT DISTINCT p_name AS model, lower(p_brand) AS "table" FROM part WHERE p_partkey % 41 = 0), secret AS (SELECT DISTINCT p_name AS model, lower(p_type) || '_id' AS name FROM part WHERE p_partkey % 3 = 0)
SELECT c."table", c.name, coalesce((SELECT string_agg(DISTINCT model, '|' ORDER BY model) FROM models m WHERE m."table" = c."table"), '') AS models,
  EXISTS (SELECT 1 FROM models m JOIN secret s ON s.model = m.model WHERE m."table" = c."table" AND s.name = c.name) AS encrypted, EXISTS (SELECT 1 FROM indexes i WHERE i."table" = c."table" AND list_contains(i.columns, c.name)) AS indexed,
  EXISTS (SELECT 1 FROM indexes i WHERE i."table" = c."table" AND i.columns[1] = c.name) AS leading, EXISTS (SELECT 1 FROM indexes i WHERE i."table" = c."table" AND i.columns = [c.name]) AS "unique"
FROM columns c
""")
def table_listing(spark, sf_dir):
    """Columns with their models, and whether they are encrypted, indexed, leading or unique."""
    part = table(spark, sf_dir, "part")
    columns, indexes = _relations(spark, sf_dir)
    models = part.where("p_partkey % 41 = 0").select(F.col("p_name").alias("model"), F.lower("p_brand").alias("table")).distinct()
    secret = part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("model"), F.concat(F.lower("p_type"), F.lit("_id")).alias("name"))
    out = joins.listing(columns, models, secret, indexes.withColumn("unique", F.size("columns") == 1))
    return out.withColumn("models", F.array_join("models", "|"))
