"""Audit rules with their exemptions, and rule tables, over relations made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import redact, text
from larkspur.operators import graph, joins, ordered, predicates, replay
from larkspur.plans.catalog import query
from larkspur.session import table
from larkspur.sources import files


@query("""
WITH fk AS (SELECT DISTINCT p_brand AS "table", p_type AS name FROM part WHERE p_size <= 10), belongs AS (SELECT DISTINCT p_brand AS "table", p_type AS name FROM part WHERE p_size BETWEEN 8 AND 20)
SELECT "table", name FROM (SELECT * FROM fk UNION SELECT * FROM belongs) k WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 48) i WHERE i.p_brand = k."table" AND i.p_type = k.name)
""")
def declared_unindexed(spark, sf_dir):
    """Keys declared by the table or by an association that lead no index."""
    part = table(spark, sf_dir, "part")
    keys = lambda where: part.where(where).select(F.col("p_brand").alias("table"), F.col("p_type").alias("name"))
    indexes = part.where("p_size > 48").select(F.col("p_brand").alias("table"), F.array("p_type", "p_name").alias("columns"))
    return joins.declared_unindexed(keys("p_size <= 10"), keys("p_size between 8 and 20"), indexes)


@query("""
WITH chains AS (SELECT DISTINCT event_type AS controller, user_id AS action, user_id % 25 AS model FROM events), assoc AS (SELECT DISTINCT p_size % 25 AS model, p_name AS name FROM part),
views AS (SELECT DISTINCT event_type AS controller, user_id AS action, p_name AS mention FROM events JOIN part ON p_partkey = event_id)
SELECT DISTINCT c.controller, c.action, c.model, a.name FROM chains c JOIN assoc a USING (model) JOIN views v ON v.controller = c.controller AND v.action = c.action AND v.mention = a.name
""")
def repeated_loads(spark, sf_dir):
    """Controller chains, associations and what their views mention, distinct on four keys."""
    events, part = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    chains = events.select(F.col("event_type").alias("controller"), F.col("user_id").alias("action"), (F.col("user_id") % 25).alias("model")).distinct()
    associations = part.select((F.col("p_size") % 25).cast("long").alias("model"), F.col("p_name").alias("name")).distinct()
    views = events.join(part, F.col("p_partkey") == F.col("event_id")).select(F.col("event_type").alias("controller"), F.col("user_id").alias("action"), F.col("p_name").alias("mention"))
    return joins.repeated_loads(chains, associations, views)


@query("""
WITH routes AS (SELECT DISTINCT p_brand AS controller, p_name AS action FROM part), actions AS (SELECT DISTINCT p_brand AS controller, p_name AS action FROM part WHERE p_size > 25 AND p_brand <> 'Brand#7')
SELECT controller, action FROM routes r WHERE controller IN (SELECT controller FROM actions) AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.controller = r.controller AND a.action = r.action)
""")
def route_gaps(spark, sf_dir):
    """Actions that routes name and their controller lacks; of unknown controllers nothing is said."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("controller"), F.col("p_name").alias("action"), "p_size")
    actions = part.where("p_size > 25 and controller <> 'Brand#7'")
    return joins.unknown_members(part, [actions], ["controller", "action"], within=actions)


@query("""
WITH params AS (SELECT DISTINCT c_nationkey AS model, c_mktsegment || '_' || c_custkey % 40 AS name FROM customer), known AS (
  SELECT c_nationkey AS model, c_mktsegment || '_' || c_custkey % 40 AS name FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey, 'BUILDING_' || s_suppkey % 40 FROM supplier)
SELECT model, name FROM params p WHERE model NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.model = p.model AND k.name = p.name)
""")
def unknown_params(spark, sf_dir):
    """Permitted parameters that are neither columns nor associations; models with a JSON column are exempt."""
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    params = customer.select(F.col("c_nationkey").alias("model"), F.concat_ws("_", "c_mktsegment", F.col("c_custkey") % 40).alias("name"), "c_acctbal")
    associations = supplier.select(F.col("s_nationkey").alias("model"), F.concat(F.lit("BUILDING_"), F.col("s_suppkey") % 40).alias("name"))
    with_json = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("model"))
    return joins.unknown_members(params, [params.where("c_acctbal > 5000"), associations], ["model", "name"], exempt=with_json)


@query("""
WITH callbacks AS (SELECT DISTINCT user_id AS model, event_type || '_' || event_id % 9 AS name FROM events WHERE value > 10), methods AS (SELECT DISTINCT user_id AS model, event_type || '_' || event_id % 9 AS name FROM events WHERE value < 12)
SELECT model, name FROM callbacks c WHERE model NOT IN (SELECT user_id FROM events WHERE event_id % 997 = 0) AND NOT EXISTS (SELECT 1 FROM methods m WHERE m.model = c.model AND m.name = c.name)
""")
def unknown_callbacks(spark, sf_dir):
    """Callbacks that name no method of their model; models with concerns are exempt, as these may bring it."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("model"), F.concat("event_type", F.lit("_"), F.col("event_id") % 9).alias("name"), "value", "event_id")
    return joins.unknown_members(events.where("value > 10"), [events.where("value < 12")], ["model", "name"], exempt=events.where("event_id % 997 = 0"))


@query("""
WITH named AS (SELECT DISTINCT l_suppkey AS model, l_partkey AS name FROM lineitem WHERE l_quantity > 25), known AS (
  SELECT l_suppkey AS model, l_partkey AS name FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'F')
SELECT model, name FROM named n WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.model = n.model AND k.name = n.name)
""")
def unknown_columns(spark, sf_dir):
    """Columns that validations name and neither the table nor an association has."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("model"), F.col("l_partkey").alias("name"), "l_quantity", "l_returnflag", "l_linestatus")
    return joins.unknown_members(items.where("l_quantity > 25"), [items.where("l_returnflag = 'R'"), items.where("l_linestatus = 'F'")], ["model", "name"])


@query("SELECT DISTINCT upper(replace(p_name, ' ', '_')) AS name FROM part WHERE upper(replace(p_name, ' ', '_')) NOT IN (SELECT upper(replace(p_name, ' ', '_')) FROM part WHERE p_type = 'SMALL' AND p_size > 40)")
def unused_variables(spark, sf_dir):
    """Variables of the example file that the code never reads."""
    part = table(spark, sf_dir, "part").select(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"), "p_type", "p_size")
    return joins.unknown_members(part, [part.where("p_type = 'SMALL' and p_size > 40")], ["name"])


@query("""
WITH c AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'app/controllers/' || o_custkey || '_controller.rb' WHEN o_orderkey % 8 = 1 THEN 'spec/controllers/' || o_custkey || '_controller_spec.rb' WHEN o_orderkey % 8 = 3 THEN 'spec/requests/' || o_custkey || '_spec.rb'
  WHEN o_orderkey % 8 = 5 THEN 'test/controllers/' || o_custkey || '_controller_test.rb' ELSE 'lib/' || o_custkey || '.rb' END AS path FROM orders WHERE o_custkey % 3 = 0)
SELECT DISTINCT path FROM c WHERE path LIKE 'app/controllers/%' AND replace(replace(path, 'app/controllers/', ''), '_controller.rb', '') NOT IN (SELECT regexp_extract(path, '^(?:spec|test)/(?:controllers|requests)/([0-9]+)_', 1) FROM c)
""")
def changed_untested(spark, sf_dir):
    """Changed controllers without a changed test under any of four names."""
    orders, k = table(spark, sf_dir, "orders").where("o_custkey % 3 = 0"), F.col("o_orderkey")
    named = lambda before, after: F.concat(F.lit(before), F.col("o_custkey"), F.lit(after))
    path = F.when(k % 2 == 0, named("app/controllers/", "_controller.rb")).when(k % 8 == 1, named("spec/controllers/", "_controller_spec.rb")).when(k % 8 == 3, named("spec/requests/", "_spec.rb"))
    changed = orders.select(path.when(k % 8 == 5, named("test/controllers/", "_controller_test.rb")).otherwise(named("lib/", ".rb")).alias("path"))
    return joins.changed_without_test(changed)


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS version FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000)")
def pending_versions(spark, sf_dir):
    """Versions that were not applied, compared as numbers."""
    have = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_totalprice > 200000").select(F.concat(F.lit(" "), "o_custkey").alias("version"))
    return joins.pending_versions(table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("version")), have)


@query("""
WITH l AS (SELECT DISTINCT split_part(split_part(url, '/', 3), '.', 1) || ':{a}' AS s FROM pages WHERE page_id % 2 = 0), r AS (SELECT DISTINCT '@' || split_part(split_part(url, '/', 3), '.', 1) || ':{b}' AS s FROM pages WHERE page_id % 3 = 0)
SELECT s AS stream, 'left' AS side FROM l WHERE split_part(s, '{', 1) NOT IN (SELECT split_part(substr(s, 2), '{', 1) FROM r) UNION ALL SELECT s, 'right' FROM r WHERE split_part(substr(s, 2), '{', 1) NOT IN (SELECT split_part(s, '{', 1) FROM l)
""")
def streams_both_ways(spark, sf_dir):
    """Streams without a partner, in both directions."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("."), F.lit(1)).alias("s"))
    left = pages.where("page_id % 2 = 0").select(F.concat("s", F.lit(":{a}")).alias("stream")).distinct()
    right = pages.where("page_id % 3 = 0").select(F.concat(F.lit("@"), "s", F.lit(":{b}")).alias("stream")).distinct()
    return joins.unmatched_both(left, right, "stream")


@query("""
SELECT n_name AS base, r_name AS "table", (SELECT string_agg(n2.n_name, '|' ORDER BY n2.n_name) FROM nation n2 WHERE n2.n_regionkey = n.n_regionkey AND n2.n_nationkey <> n.n_nationkey) AS children
FROM nation n JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation m WHERE m.n_regionkey = n.n_regionkey)
""")
def hierarchies(spark, sf_dir):
    """Models that share a table, below their base."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    first = nation.groupBy("n_regionkey").agg(F.min_by("n_name", "n_nationkey").alias("first"))
    models = nation.join(first, "n_regionkey").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    models = models.select(F.col("n_name").alias("model"), F.when(F.col("n_name") == F.col("first"), "Record").otherwise(F.col("first")).alias("parent"), F.col("r_name").alias("table"))
    return graph.hierarchies(models).withColumn("children", F.array_join("children", "|"))


@query("""
WITH e AS (SELECT DISTINCT p_brand AS src, p_type AS dst, CASE WHEN p_size % 3 = 0 THEN 't' || p_size % 4 END AS through, p_size % 3 = 1 AS polymorphic FROM part), impl AS (SELECT DISTINCT p_type AS name, 'm' || p_size % 5 AS model FROM part),
d AS (SELECT src, '==>' AS arrow, 'through' AS label, through AS dst FROM e WHERE through IS NOT NULL UNION SELECT through, '==>', 'through', dst FROM e WHERE through IS NOT NULL
  UNION SELECT src, '-.->', 'polymorphic', dst FROM e WHERE through IS NULL AND polymorphic UNION SELECT model, '-.->', 'implements', src FROM e JOIN impl ON name = dst WHERE through IS NULL AND polymorphic
  UNION SELECT src, '-->', 'has_many', dst FROM e WHERE through IS NULL AND NOT polymorphic)
SELECT src, string_agg(DISTINCT regexp_replace(src, '[^A-Za-z0-9_]', '_', 'g') || ' ' || arrow || '|' || label || '| ' || regexp_replace(dst, '[^A-Za-z0-9_]', '_', 'g'), chr(10)
  ORDER BY regexp_replace(src, '[^A-Za-z0-9_]', '_', 'g') || ' ' || arrow || '|' || label || '| ' || regexp_replace(dst, '[^A-Za-z0-9_]', '_', 'g')) AS lines FROM d GROUP BY src
""")
def drawn_graph(spark, sf_dir):
    """Through edges as two hops, polymorphic ones with their implementers, as lines of a flow chart."""
    part = table(spark, sf_dir, "part")
    edges = part.select(
        F.col("p_brand").alias("src"), F.col("p_type").alias("dst"), F.lit("has_many").alias("type"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("t"), F.col("p_size") % 4)).alias("through"), (F.col("p_size") % 3 == 1).alias("polymorphic")
    ).distinct()
    implementers = part.select(F.col("p_type").alias("name"), F.concat(F.lit("m"), F.col("p_size") % 5).alias("model")).distinct()
    return graph.drawn_text(graph.drawn_edges(edges, implementers))


_FOLDERS = ("app/models/", "app/controllers/", "db/migrate/", "app/views/", "config/routes/", "spec/", "app/services/", "app/jobs/", "app/javascript/", "config/", "lib/")
_KINDS = ("model", "controller", "migration", "view", "routes", "test", "service", "job", "javascript", "config", "other")


@query("SELECT kind, count(*) AS n FROM (SELECT list_extract([" + ", ".join(f"'{k}'" for k in _KINDS) + "], CAST(p_partkey % 11 + 1 AS INTEGER)) AS kind FROM part) GROUP BY kind")
def review_kinds(spark, sf_dir):
    """Changed files by kind."""
    path = F.concat(F.element_at(F.array(*map(F.lit, _FOLDERS)), (F.col("p_partkey") % 11 + 1).cast("int")), F.replace("p_name", F.lit(" "), F.lit("_")))
    kind = predicates.first_case(path, predicates.REVIEW_KINDS, "other")
    return table(spark, sf_dir, "part").select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_VARIABLES = ("STRIPE_API_KEY", "SMTP_HOST", "REDIS_URL", "SENTRY_DSN", "VAPID_PUBLIC", "WEB_CONCURRENCY", "LOCALE")


@query("SELECT kind, count(*) AS n FROM (SELECT list_extract(['API Keys & Secrets', 'Mail', 'Database', 'Monitoring', 'Push Notifications', 'Infrastructure', 'Other'], CAST(c_custkey % 7 + 1 AS INTEGER)) AS kind FROM customer) GROUP BY kind")
def variable_kinds(spark, sf_dir):
    """Environment variables by kind."""
    name = F.concat(F.element_at(F.array(*map(F.lit, _VARIABLES)), (F.col("c_custkey") % 7 + 1).cast("int")), F.lit("_"), F.col("c_custkey"))
    kind = predicates.first_case(name, predicates.VARIABLE_KINDS, "Other")
    return table(spark, sf_dir, "customer").select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_ERRORS = (
    ("undefined local variable or method x", "NameError"), ("undefined method x", "NoMethodError"), ("uninitialized constant X", "NameError"), ("missing keyword: a", "ArgumentError"), ("Couldn't find Order with id", "ActiveRecord::RecordNotFound"),
    ("param is missing or the value is empty: a", "ActionController::ParameterMissing"), ("No route matches /x", "ActionController::RoutingError"), ('relation "x" does not exist', "ActiveRecord::StatementInvalid"), ("nothing of the kind", "Unknown"),
)


@query("SELECT o_orderkey, list_extract([" + ", ".join(f"'{k}'" for _, k in _ERRORS) + f"], CAST(o_orderkey % {len(_ERRORS)} + 1 AS INTEGER)) AS kind FROM orders")
def error_kinds(spark, sf_dir):
    """Error messages by what they say."""
    message = F.concat(F.element_at(F.array(*(F.lit(m) for m, _ in _ERRORS)), (F.col("o_orderkey") % len(_ERRORS) + 1).cast("int")), F.lit(" at "), F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", predicates.first_case(message, predicates.ERROR_KINDS, "Unknown").alias("kind"))


@query("SELECT page_id, CASE WHEN position('/fr/' IN url) > 0 THEN 'low' WHEN page_id % 2 = 0 THEN 'medium' ELSE 'high' END AS risk FROM pages")
def preload_risk(spark, sf_dir):
    """How likely an association is loaded row by row."""
    name = F.concat(F.lit("lines"), F.col("page_id"))
    code = F.when(F.col("url").contains("/fr/"), F.concat(F.lit("Order.includes(:user, :"), name, F.lit(")"))).when(F.col("page_id") % 2 == 0, "Order.preload (:user)").otherwise("Order.all")
    return table(spark, sf_dir, "pages").select("page_id", predicates.preload_risk(code, name).alias("risk"))


@query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text WHEN position(' ' IN left(text, 80)) = 0 THEN left(text, 80) || '...' ELSE regexp_extract(left(text, 80), '(?s)^(.*) [^ ]*$', 1) || '...' END AS short FROM documents")
def word_cut(spark, sf_dir):
    """Truncate at the border of a word."""
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_at_word(F.col("text"), 80).alias("short"))


@query("SELECT o_custkey, count(*) || CASE WHEN count(*) = 1 THEN ' order, ' ELSE ' orders, ' END || sum(CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END) || CASE WHEN sum(CASE o_orderstatus WHEN 'P' THEN 1 ELSE 0 END) = 1 THEN ' index' ELSE ' indexes' END AS phrase FROM orders GROUP BY o_custkey")
def counted_nouns(spark, sf_dir):
    """Counts with their nouns."""
    n, open_ones = F.count("*"), F.count_if(F.col("o_orderstatus") == "P")
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(n.alias("n"), open_ones.alias("p"))
    return grouped.select("o_custkey", F.concat_ws(", ", text.counted(F.col("n"), "order"), text.counted(F.col("p"), "index", "indexes")).alias("phrase"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'lib/' WHEN 1 THEN 'pkg-' ELSE '/srv/apple/' END || page_id AS path FROM pages")
def portable_paths(spark, sf_dir):
    """Portable paths: without the root or the longest install folder; a folder that merely begins alike is none."""
    k = F.col("page_id") % 3
    path = F.concat(F.when(k == 0, "/srv/app/lib/").when(k == 1, "/opt/packs/own/pkg-").otherwise("/srv/apple/"), "page_id")
    return table(spark, sf_dir, "pages").select("page_id", text.portable_path(path, "/srv/app", ("/opt/packs", "/opt/packs/own/")).alias("path"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARN' WHEN 'click' THEN 'INFO' ELSE upper(event_type) END AS level, CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS rank FROM events")
def json_log_level(spark, sf_dir):
    """JSON log level; an unknown one ranks as DEBUG."""
    word = F.when(F.col("event_type") == "view", "warning").when(F.col("event_type") == "click", "info").otherwise(F.col("event_type"))
    level = text.log_level(F.concat(F.lit('{"ts": 1, "level" : "'), word, F.lit('"}')), as_json=True)
    return table(spark, sf_dir, "events").select("event_id", level.alias("level"), text.level_rank(level).alias("rank"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN '[FILTERED]' WHEN 'click' THEN '60' ELSE event_type END AS value FROM events")
def redacted_settings(spark, sf_dir):
    """Settings by their name: secrets hidden, descriptions kept."""
    kind = F.col("event_type")
    key = F.when(kind == "view", "smtp_password").when(kind == "click", "token_ttl").otherwise("label")
    settings = F.create_map(key, F.when(kind == "click", "60").otherwise(kind))
    return table(spark, sf_dir, "events").select("event_id", F.map_values(redact.redact_map(settings))[0].alias("value"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'x' ELSE '[FILTERED]' END AS value FROM customer")
def secret_paths(spark, sf_dir):
    """Names that are secret under one path only."""
    customer, k = table(spark, sf_dir, "customer"), F.col("c_nationkey") % 3
    path = F.when(k == 0, F.array(F.lit("record"), F.lit("primary_key"))).when(k == 1, F.array(F.lit("record"), F.lit("encryption"), F.lit("primary_key"))).otherwise(F.array(F.lit("encryption"), F.lit("key_derivation_salt")))
    return redact.redact_rows(customer.select("c_custkey", path.alias("path"), F.lit("x").alias("value"))).select("c_custkey", "value")


@query("SELECT s_suppkey, left('token: ' || repeat('[FILTERED]', 1) || ' ' || repeat('x', CAST(s_suppkey % 40 AS INTEGER)), 1000) AS full_text, CASE WHEN 18 + s_suppkey % 40 > 30 THEN left('token: [FILTERED] ' || repeat('x', CAST(s_suppkey % 40 AS INTEGER)), 27) || '...' ELSE 'token: [FILTERED] ' || repeat('x', CAST(s_suppkey % 40 AS INTEGER)) END AS short FROM supplier")
def redact_before_cut(spark, sf_dir):
    """Redacted first and shortened after, where the secret alone is longer than the limit."""
    line = F.concat(F.lit("token: "), F.lit("k" * 64), F.lit(" "), F.expr("repeat('x', cast(s_suppkey % 40 as int))"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", redact.redact_value(line).alias("full_text"), redact.redact_then_shorten(line, 30).alias("short"))


@query("""
SELECT * FROM (SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_name ORDER BY CASE p_type WHEN 'LARGE' THEN 1 WHEN 'SMALL' THEN 2 ELSE 99 END, p_size DESC, p_partkey) AS nth FROM part) WHERE nth = 1
""")
def priority_dumps(spark, sf_dir):
    """Of sources with the same name, the one of the first kind wins; then L6, L7, L9: several sort keys with ties by name."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", ordered.listed_order(F.col("p_type"), ["LARGE", "SMALL"]).alias("priority"), (-F.col("p_size")).alias("size"))
    return ordered.first_wins(part, ["p_name"], ["priority", "size", "id"]).select("id", F.lit(1).cast("long").alias("nth"))


@query("SELECT o_orderpriority AS locale, 'a.b.c.d.e.f' AS key, count(*) AS n FROM orders GROUP BY o_orderpriority UNION ALL SELECT o_orderpriority, 'a.g', count(*) FROM orders GROUP BY o_orderpriority")
def deep_keys(spark, sf_dir):
    """Dotted keys of documents six maps deep."""
    doc = F.concat(F.lit('{"a":{"b":{"c":{"d":{"e":{"f":'), F.col("o_orderkey"), F.lit('}}}},"g":[1,2]},"h":{}}'))
    keys = files.locale_keys(table(spark, sf_dir, "orders").select("o_orderpriority", doc.alias("doc")), "o_orderpriority", "doc")
    return keys.groupBy("locale", "key").agg(F.count("*").alias("n"))


_STEPS = (
    ("create_table", "users", None, None, None, None, None, None), ("add_column", "users", "name", "string", None, None, None, {"null": "false"}), ("add_column", "users", "age", "integer", None, None, None, {"default": "7"}),
    ("add_column", "users", "name", "text", None, None, None, None), ("change_column_default", "users", "age", None, None, None, None, {"to": "8"}), ("change_column_null", "users", "age", None, None, None, None, {"null": "false"}),
    ("change_column", "users", "age", "bigint", None, None, None, None), ("add_reference", "users", "team", "bigint", None, None, None, {"null": "false"}), ("add_index", "users", None, None, None, ["team_id", "age"], None, {"unique": "true", "name": "by_team"}),
    ("add_foreign_key", "users", None, None, None, None, "teams", None), ("rename_table", "users", None, None, "people", None, None, None), ("add_column", "gone", "x", "text", None, None, None, None),
)


@query("""
SELECT n_name AS db, t.* FROM nation, (VALUES ('column', 'people', 0, 'id', 'bigint', false, NULL, NULL, NULL, NULL), ('column', 'people', 1, 'age', 'bigint', false, '8', NULL, NULL, NULL), ('column', 'people', 2, 'name', 'text', true, NULL, NULL, NULL, NULL), ('column', 'people', 3, 'team_id', 'bigint', false, NULL, NULL, NULL, NULL),
  ('index', 'people', 0, 'by_team', NULL, NULL, NULL, 'team_id,age', true, NULL), ('foreign_key', 'people', 0, 'team_id', NULL, NULL, NULL, NULL, NULL, 'teams')) AS t(kind, "table", position, name, type, nullable, "default", columns, "unique", to_table)
""")
def replayed_schema(spark, sf_dir):
    """Columns with their flags and defaults, indexes and foreign keys after all events, one database a nation."""
    rows = [(i, *s) for i, s in enumerate(_STEPS)]
    steps = spark.createDataFrame(rows, "location int, action string, table string, column string, type string, new_name string, columns array<string>, to_table string, options map<string,string>")
    named = table(spark, sf_dir, "nation").select(F.col("n_name").alias("db"), F.lit("1").alias("file"))
    events = named.join(F.broadcast(steps.withColumn("file", F.lit("1"))), "file")  # a dozen literal steps for each nation
    state = replay.replay_schema(events)
    return state.select("db", "kind", "table", "position", "name", "type", "nullable", "default", F.array_join("columns", ",").alias("columns"), "unique", "to_table")
