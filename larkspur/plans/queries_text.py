"""Queries over ordered and textual rows: logs, search, ranking, sessions."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import graph, ordered, predicates, replay
from larkspur.plans.catalog import query
from larkspur.session import table
from larkspur.sources import dumps, files, sections
from larkspur.streaming import changes, stateful
from larkspur.streaming.content_cache import ContentCache

_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'INFO' END"


@query(f"""
WITH tailed AS (SELECT event_id, user_id, ts, event_type, CASE {_LEVEL} WHEN 'ERROR' THEN 3 WHEN 'WARN' THEN 2 WHEN 'INFO' THEN 1 END AS r
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50),
carried AS (SELECT *, last_value(r IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried_rank FROM tailed)
SELECT event_id, user_id, carried_rank FROM carried WHERE carried_rank >= 2 AND contains(lower(event_type), 'e')
""")
def log_tail_filter(spark, sf_dir):
    """The last 50 lines of each log, filtered by carried level, then searched."""
    level = F.expr(_LEVEL)
    lines = ordered.tail(table(spark, sf_dir, "events"), 50, ["user_id"], ["ts", "event_id"]).withColumn("r", text.level_rank(level))
    kept = predicates.level_filter(lines, "r", 2, ["user_id"], ["ts", "event_id"])
    return kept.where(predicates.contains_folded(F.col("event_type"), "E")).select("event_id", "user_id", "carried_rank")


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS opened_by FROM events
""")
def carry_forward_event(spark, sf_dir):
    """Events attached to the latest opening event."""
    opening = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return ordered.carry_forward(table(spark, sf_dir, "events"), opening, "opened_by", ["user_id"], ["ts", "event_id"]).select("event_id", "opened_by")


@query("""
SELECT conv_id, turn, contains(text, '?') OR contains(text, 'the') AS is_match FROM conversations c
WHERE EXISTS (SELECT 1 FROM conversations m WHERE m.conv_id = c.conv_id AND m.turn BETWEEN c.turn - 1 AND c.turn + 1 AND (contains(m.text, '?') OR contains(m.text, 'the')))
""")
def context_lines(spark, sf_dir):
    """Matching turns with one turn around them."""
    match = F.col("text").contains("?") | F.col("text").contains("the")
    return ordered.with_context(table(spark, sf_dir, "conversations"), match, 1, ["conv_id"], "turn").select("conv_id", "turn", "is_match")


@query("""
SELECT doc_id, line_number, last_value(CASE WHEN regexp_matches(content, '^[A-Z][a-z]* ') THEN regexp_extract(content, '^([A-Z][a-z]*) ', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS enclosing
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents)
""")
def enclosing_block(spark, sf_dir):
    """Lines with the nearest heading above them."""
    numbered = files.lines(table(spark, sf_dir, "documents"), "text", "doc_id")
    heading = F.nullif(F.regexp_extract("content", "^([A-Z][a-z]*) ", 1), F.lit(""))
    return ordered.carry_forward(numbered, heading, "enclosing", ["doc_id"], ["line_number"]).select("doc_id", F.col("line_number").cast("long"), "enclosing")


@query("""
SELECT o.l_orderkey, o.l_linenumber, min(c.l_linenumber) AS block_end FROM lineitem o LEFT JOIN lineitem c
  ON c.l_orderkey = o.l_orderkey AND c.l_linestatus = o.l_linestatus AND c.l_linenumber > o.l_linenumber AND c.l_returnflag = 'N'
WHERE o.l_returnflag = 'R' GROUP BY o.l_orderkey, o.l_linenumber, o.l_partkey, o.l_suppkey, o.l_linestatus, o.l_extendedprice
""")
def block_end(spark, sf_dir):
    """The first closing line after an opening one at the same indent."""
    items = table(spark, sf_dir, "lineitem")
    ended = ordered.block_end(items, F.col("l_returnflag") == "R", F.col("l_linestatus"), F.col("l_returnflag") == "N", ["l_orderkey"], "l_linenumber")
    return ended.select("l_orderkey", "l_linenumber", "block_end")


@query("""
SELECT event_id, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS private FROM events
""")
def visibility_state(spark, sf_dir):
    """Everything after a mark."""
    return ordered.after_mark(table(spark, sf_dir, "events"), F.col("event_type") == "error", "private", ["user_id"], ["ts", "event_id"]).select("event_id", "private")


@query("SELECT event_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
def heading_change(spark, sf_dir):
    """Rows at which the type changes."""
    return ordered.headings(table(spark, sf_dir, "events"), "event_type", ["user_id"], ["ts", "event_id"]).select("event_id", "event_type")


@query("SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def first_wins(spark, sf_dir):
    """The first document of each source."""
    return ordered.first_wins(table(spark, sf_dir, "documents").select("source", "doc_id", "lang"), ["source"], ["doc_id"])


@query("""
SELECT p_partkey, score, CAST(row_number() OVER (ORDER BY score DESC, p_partkey) AS INTEGER) AS rank FROM (
  SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 10 ELSE 0 END + CASE WHEN contains(lower(p_type), 'red') THEN 5 ELSE 0 END + CASE WHEN contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red') THEN 1 ELSE 0 END
    + CASE WHEN contains(lower(p_name), 'small') THEN 10 ELSE 0 END + CASE WHEN contains(lower(p_type), 'small') THEN 5 ELSE 0 END + CASE WHEN contains(lower(p_brand), 'small') OR contains(lower(p_type), 'small') THEN 1 ELSE 0 END AS score FROM part
) WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 20
""")
def keyword_score(spark, sf_dir):
    """Scoring, W8: the top 20 parts for two words."""
    score = text.keyword_score(["red", "small"], F.col("p_name"), F.col("p_type"), F.array("p_brand", "p_type"))
    scored = table(spark, sf_dir, "part").select("p_partkey", score.alias("score")).where("score > 0")
    return ordered.ranked(scored, [F.desc("score"), F.col("p_partkey")], 20).select("p_partkey", "score", "rank")


@query("""
SELECT doc_id, CASE WHEN contains(lower(source), 'the') THEN 10 ELSE 0 END + CASE WHEN contains(lower(text), 'the') THEN 5 ELSE 0 END + CASE WHEN contains(lower(lang), 'the') THEN 1 ELSE 0 END AS score FROM documents
""")
def document_score(spark, sf_dir):
    """Scoring over whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.keyword_score(["the"], F.col("source"), F.col("text"), F.array("lang")).alias("score"))


@query("SELECT p_partkey FROM part WHERE p_name = 'red widget' OR p_name = 'red widgets'")
def word_match(spark, sf_dir):
    """Names that hold a run of words, plural or singular."""
    return table(spark, sf_dir, "part").where(text.words_in_run(F.col("p_name"), ["red", "widgets"])).select("p_partkey")


@query("""
SELECT 'documents' AS kind, CAST(sum(len(regexp_extract_all(text, '[A-Z][a-z]+'))) AS BIGINT) AS capitals, CAST(sum(len(regexp_extract_all(text, '[0-9]+'))) AS BIGINT) AS numbers FROM documents
UNION ALL SELECT 'pages', CAST(sum(len(regexp_extract_all(html, '[A-Z][a-z]+'))) AS BIGINT), CAST(sum(len(regexp_extract_all(html, '[0-9]+'))) AS BIGINT) FROM pages
""")
def regex_counts(spark, sf_dir):
    """Occurrences of patterns, summed."""
    parts = [table(spark, sf_dir, "documents").select(F.lit("documents").alias("kind"), F.col("text")), table(spark, sf_dir, "pages").select(F.lit("pages").alias("kind"), F.col("html").alias("text"))]
    counted = lambda p: F.sum(F.regexp_count("text", F.lit(p)).cast("long"))
    return parts[0].unionByName(parts[1]).groupBy("kind").agg(counted("[A-Z][a-z]+").alias("capitals"), counted("[0-9]+").alias("numbers"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z]+)', 1)) AS tag FROM pages) GROUP BY tag")
def stream_actions(spark, sf_dir):
    """Extracted actions, counted."""
    return table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z]+)"), F.lit(1))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("""
SELECT page_id, CASE WHEN regexp_matches(url, '/fr/') THEN 'french' WHEN regexp_matches(url, '\\.html$') THEN 'static' WHEN regexp_matches(url, '[?]') THEN 'query' ELSE 'other' END AS kind FROM pages
""")
def classify_case(spark, sf_dir):
    """The first pattern that matches decides."""
    rules = (("/fr/", "french"), (r"\.html$", "static"), ("[?]", "query"))
    return table(spark, sf_dir, "pages").select("page_id", predicates.first_case(F.col("url"), rules, "other").alias("kind"))


@query("SELECT doc_id, line_number FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents) WHERE regexp_matches(content, '(^|[^0-9A-Za-z_])The($|[^0-9A-Za-z_])')")
def line_search(spark, sf_dir):
    """Lines that call a name, whole words only."""
    numbered = files.lines(table(spark, sf_dir, "documents"), "text", "doc_id")
    return numbered.where(predicates.line_matches(F.col("content"), "The", "call", True)).select("doc_id", F.col("line_number").cast("long"))


@query("SELECT page_id, regexp_matches(lower(url), '(^|.*/)[^/]*\\.html$') AS hidden FROM pages")
def sensitive_paths(spark, sf_dir):
    """Paths under globs, by base name."""
    return table(spark, sf_dir, "pages").select("page_id", predicates.is_sensitive_path(F.col("url"), ("*.html",)).alias("hidden"))


@query("SELECT conv_id AS session, count(*) AS n_calls, count(DISTINCT role) AS n_tools, count(DISTINCT role || '|' || turn) AS n_params FROM conversations GROUP BY conv_id")
def session_summary(spark, sf_dir):
    """Calls, tools and parameters of each session."""
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session")
    return changes.session_totals(rows, "session", "role", F.concat_ws("|", "role", F.col("turn").cast("string")))


@query("SELECT CAST(user_id AS VARCHAR) AS session, event_type AS tool, '' AS params, count(*) AS call_count, max(ts) AS last_ts FROM events GROUP BY user_id, event_type")
def session_calls(spark, sf_dir):
    """T5: calls of each session by tool, with the last time."""
    calls = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("tool"), F.lit("").alias("params"), "ts")
    return changes.session_calls(calls)


@query("SELECT user_id, max(ts) AS last_ts, CAST(row_number() OVER (ORDER BY max(ts) DESC, user_id) AS INTEGER) AS rank FROM events GROUP BY user_id ORDER BY rank LIMIT 100")
def lru_sessions(spark, sf_dir):
    """The 100 sessions used last."""
    return changes.recent_sessions(table(spark, sf_dir, "events"), "user_id", "ts", 100)


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'")
def replay_state(spark, sf_dir):
    """the last event of each key, where it leaves the key alive."""
    return replay.last_state(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "error").select("user_id", "event_id", "event_type")


@query("""
WITH p AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'r' ELSE 't' END || p_partkey AS name_ FROM part WHERE p_size % 7 <> 0)
SELECT p_brand AS db, name_ AS "table", 'id' AS "column", CASE WHEN p_size % 4 = 0 THEN 'uuid' ELSE 'bigint' END AS type, 0 AS position FROM p WHERE p_size % 9 <> 0
UNION ALL SELECT p_brand, name_, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'third' ELSE 'second' END ELSE 'first' END, CASE WHEN p_size % 5 = 0 THEN 'text' ELSE lower(p_type) END, CASE WHEN p_size % 9 = 0 THEN 0 ELSE 1 END FROM p
UNION ALL SELECT p_brand, name_, 'team_id', 'bigint', CASE WHEN p_size % 9 = 0 THEN 1 ELSE 2 END FROM p WHERE p_size % 8 <> 0
""")
def replay_migrations(spark, sf_dir):
    """A history for each part, of renamed tables and columns, keys of their own, parts that only run downwards and dropped tables; a database for each brand."""
    p = table(spark, sf_dir, "part")
    t, size = F.concat(F.lit("t"), "p_partkey"), F.col("p_size")
    r = F.when(size % 2 == 0, F.concat(F.lit("r"), "p_partkey")).otherwise(t)
    at = F.when(size % 3 == 0, F.when(size % 2 == 0, "third").otherwise("second")).otherwise("first")
    none = F.lit(None).cast("string")

    def step(i, action, tab, when=None, column=none, kind=none, new=none, part=none, **options):
        given = [x for k, v in options.items() for x in (F.lit(k), F.lit(v) if isinstance(v, str) else v)]
        fields = {"location": F.lit(i), "action": F.lit(action), "table": tab, "column": column, "type": kind, "new_name": new, "part": part, "options": F.create_map(*given) if given else F.lit(None).cast("map<string,string>")}
        one = F.struct(*(c.alias(n) for n, c in fields.items()))
        return one if when is None else F.when(when, one)

    steps = [
        step(0, "create_table", t, id=F.when(size % 9 == 0, "false").when(size % 4 == 0, "uuid").otherwise("true")),
        step(1, "add_column", t, column=F.lit("first"), kind=F.lower("p_type")),
        step(2, "drop_table", t, part=F.lit("down")),
        step(3, "rename_column", t, size % 3 == 0, column=F.lit("first"), new=F.lit("second")),
        step(4, "rename_table", t, size % 2 == 0, new=r),
        step(5, "rename_column", r, size % 6 == 0, column=F.lit("second"), new=F.lit("third")),
        step(6, "change_column", r, size % 5 == 0, column=at, kind=F.lit("text")),
        step(7, "add_reference", r, column=F.lit("team")),
        step(8, "remove_reference", r, size % 8 == 0, column=F.lit("team")),
        step(9, "drop_table", r, size % 7 == 0),
        step(10, "rename_table", t, size % 7 == 0, new=F.lit("lost")),
    ]
    events = p.select(F.col("p_brand").alias("db"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("file"), F.explode(F.array(*steps)).alias("e")).where("e IS NOT NULL").select("db", "file", "e.*")
    return replay.replay(events).select("db", "table", "column", "type", "position")


def _dumps(spark, sf_dir):
    """A dump for each part, in one of three dialects, with its values as names, sizes and defaults."""
    narrow = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size").repartition("p_partkey")  # a small file makes large texts
    part = narrow.select("p_partkey", F.col("p_partkey").cast("string").alias("k"), F.lower("p_type").alias("t"), F.col("p_size").cast("string").alias("z"), F.substring_index("p_name", " ", 1).alias("w"))
    postgres = """-- dump of (one, 'table
SET search_path = public;
CREATE TABLE public.t{k} (
    id bigint NOT NULL,
    {t} character varying({z}) DEFAULT '{w},(x'::character varying,
    "{w}" numeric(10,2) DEFAULT round((1.5)::numeric, 1) NOT NULL, /* ; not ( an end */
    CONSTRAINT c{k} CHECK ((({t})::text <> ','::text))
);
ALTER TABLE ONLY public.t{k}
    ADD CONSTRAINT t{k}_pkey PRIMARY KEY (id);
ALTER TABLE ONLY public.t{k} ADD CONSTRAINT f{k} FOREIGN KEY ({t}) REFERENCES public.kinds(name) ON DELETE CASCADE;
ALTER TABLE ONLY public.gone ADD CONSTRAINT g FOREIGN KEY (a) REFERENCES public.kinds(name);
CREATE UNIQUE INDEX i{k} ON public.t{k} USING btree (lower(({t})::text), "{w}" DESC NULLS LAST) WHERE ({w} > (0)::numeric);
"""
    mysql = """CREATE TABLE `t{k}` (
  `id` int NOT NULL AUTO_INCREMENT,
  `{t}` tinyint(1) DEFAULT '{z}' COMMENT 'it''s ({w}), NOT NULL or so;',
  `{w}` varchar({z}) COLLATE utf8_bin NOT NULL,
  PRIMARY KEY (`id`,`{w}`),
  UNIQUE KEY `i{k}` (`{w}`({z}),`{t}`),
  CONSTRAINT `f{k}` FOREIGN KEY (`{t}`) REFERENCES `kinds` (`name`)
) ENGINE=InnoDB;
CREATE TABLE `schema_migrations` (`version` varchar(255) NOT NULL);
"""
    sqlite = (
        'CREATE TABLE IF NOT EXISTS "schema_migrations" ("version" varchar NOT NULL PRIMARY KEY);CREATE TABLE "t{k}" ("id" integer PRIMARY KEY AUTOINCREMENT NOT NULL, '
        '''"{t}" decimal(5,2) DEFAULT {z}.5, "{w}" text DEFAULT 'a,b' NOT NULL, key text);CREATE INDEX "i{k}" ON "t{k}" ("{t}");'''
    )

    def filled(template):
        out = F.lit(template)
        for name in "ktzw":
            out = F.replace(out, F.lit("{" + name + "}"), F.col(name))
        return out

    text_ = F.when(F.col("p_partkey") % 3 == 0, filled(postgres)).when(F.col("p_partkey") % 3 == 1, filled(mysql)).otherwise(filled(sqlite))
    return part.select(F.concat(F.lit("db/"), "k", F.lit(".sql")).alias("path"), text_.alias("content"))


#: What :func:`_dumps` writes, straight from its values.
_DUMPED = "SELECT *, p_partkey % 3 AS d, 't' || p_partkey AS name_, lower(p_type) AS t, CAST(p_size AS VARCHAR) AS z, split_part(p_name, ' ', 1) AS w FROM part"


@query(f"""
WITH p AS ({_DUMPED})
SELECT name_ AS "table", 0 AS position, 'id' AS name, CASE d WHEN 0 THEN 'bigint' ELSE 'integer' END AS type, false AS nullable, NULL AS "default" FROM p
UNION ALL SELECT name_, 1, t, CASE d WHEN 0 THEN 'string' WHEN 1 THEN 'boolean' ELSE 'decimal' END, true, CASE d WHEN 0 THEN chr(39) || w || ',(x' || chr(39) WHEN 1 THEN chr(39) || z || chr(39) ELSE z || '.5' END FROM p
UNION ALL SELECT name_, 2, w, CASE d WHEN 0 THEN 'decimal' WHEN 1 THEN 'string' ELSE 'text' END, false, CASE d WHEN 0 THEN 'round((1.5)::numeric, 1)' WHEN 2 THEN chr(39) || 'a,b' || chr(39) END FROM p
UNION ALL SELECT name_, 3, 'key', 'text', true, NULL FROM p WHERE d = 2
""")
def dump_columns(spark, sf_dir):
    """Columns of a dump for each part, in three dialects, with nested brackets, quoted commas, comments and statements on one line."""
    found = dumps.dump_columns(dumps.dump_tables(dumps.statements(_dumps(spark, sf_dir))))
    return found.select("table", "position", "name", "type", "nullable", "default")


@query(f"""
WITH p AS ({_DUMPED})
SELECT name_ AS "table", 'i' || p_partkey AS name, CASE d WHEN 0 THEN 'lower((' || t || ')::text)|' || w WHEN 1 THEN w || '|' || t ELSE t END AS columns, d < 2 AS "unique" FROM p
""")
def dump_indexes(spark, sf_dir):
    """Indexes of these dumps, inside a table and outside, over expressions too."""
    return dumps.dump_indexes(dumps.statements(_dumps(spark, sf_dir))).select("table", "name", F.array_join("columns", "|").alias("columns"), "unique")


@query(f"""
WITH p AS ({_DUMPED})
SELECT 'db/' || p_partkey || '.sql' AS path, name_ AS "table", 'primary' AS kind, CASE d WHEN 1 THEN 'id|' || w ELSE 'id' END AS columns, NULL AS to_table, NULL AS to_columns, CASE d WHEN 0 THEN 'postgresql' WHEN 1 THEN 'mysql' ELSE 'sqlite' END AS dialect FROM p
UNION ALL SELECT 'db/' || p_partkey || '.sql', name_, 'foreign', t, 'kinds', 'name', CASE d WHEN 0 THEN 'postgresql' ELSE 'mysql' END FROM p WHERE d < 2
""")
def dump_keys(spark, sf_dir):
    """Primary and foreign keys of these dumps, and the dialect of each."""
    found = _dumps(spark, sf_dir)
    keys = dumps.dump_keys(dumps.statements(found)).join(found.select("path", dumps.dialect(F.col("content")).alias("dialect")), "path")
    return keys.select("path", "table", "kind", F.array_join("columns", "|").alias("columns"), "to_table", F.array_join("to_columns", "|").alias("to_columns"), "dialect")


@query("""
SELECT 'app' || s_nationkey || '/db/' || s_suppkey || CASE WHEN n THEN '_schema.rb' ELSE '_structure.sql' END AS path, CAST(s_suppkey AS VARCHAR) AS database
FROM (SELECT *, s_suppkey % 2 = 0 AND s_acctbal > 0 AS n FROM supplier) WHERE n OR s_suppkey % 3 <> 0
""")
def secondary_dumps(spark, sf_dir):
    """Of the two dumps of a secondary database the first kind counts, unless it has no tables; main dumps are not among them."""
    s = table(spark, sf_dir, "supplier")
    folder = F.concat(F.lit("app"), "s_nationkey", F.lit("/db/"))
    kinds = (("_schema.rb", F.when((F.col("s_suppkey") % 2 == 0) & (F.col("s_acctbal") > 0), 2).otherwise(0)), ("_structure.sql", F.when(F.col("s_suppkey") % 3 == 0, 0).otherwise(3)))
    listed = [F.struct(F.concat(folder, F.col("s_suppkey").cast("string"), F.lit(end)).alias("path"), n.alias("n_tables")) for end, n in kinds]
    main = F.struct(F.concat(folder, F.lit("schema.rb")).alias("path"), F.lit(9).alias("n_tables"))
    return dumps.chosen_dumps(s.select(F.explode(F.array(*listed, main)).alias("x")).select("x.*")).select("path", "database")


@query("""
SELECT p_brand AS path, section, name, version FROM (SELECT p_brand, 'GEM' AS section, replace(p_name, ' ', '-') || '_' || p_partkey AS name, p_size || '.' || p_partkey AS version FROM part
UNION ALL SELECT DISTINCT p_brand, 'GIT', 'forked', '0.1' FROM part)
""")
def lock_file(spark, sf_dir):
    """Entries of a lock file for each brand, in sections; what an entry needs, and platforms, are no entries."""
    part = table(spark, sf_dir, "part")
    k, name = F.col("p_partkey").cast("long"), F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_"), "p_partkey")
    line = lambda n, text_: F.struct(n.cast("long").alias("n"), text_.alias("line"))
    entry = F.concat(F.lit("    "), name, F.lit(" ("), "p_size", F.lit("."), "p_partkey", F.when(k % 2 == 0, "-x86_64-linux").otherwise(""), F.lit(")"))
    rows = part.select(F.col("p_brand").alias("path"), F.explode(F.array(line(2 * k + 10, entry), line(2 * k + 11, F.lit("      needed (~> 1.0)")))).alias("x")).select("path", "x.*")
    fixed = ("GIT", "  remote: y", "  specs:", "    forked (0.1)", "", "GEM", "  remote: x", "  specs:")
    heads = part.select(F.col("p_brand").alias("path")).distinct().select("path", F.explode(F.array(*(line(F.lit(i), F.lit(t)) for i, t in enumerate(fixed)), line(F.lit(2**40), F.lit("PLATFORMS")), line(F.lit(2**40 + 1), F.lit("  ruby")))).alias("x")).select("path", "x.*")
    return files.locked_versions(rows.unionByName(heads), "path", "line", "n").select("path", "section", "name", "version")


@query("SELECT CASE WHEN contains(url, '/fr/') THEN 'french' WHEN contains(url, '/de/') THEN 'german' ELSE 'other' END AS kind, count(*) AS n FROM pages GROUP BY kind")
def change_batches(spark, sf_dir):
    """Changes counted by kind; the batch form of the stream's reaction."""
    kind = predicates.first_case(F.col("url"), (("/fr/", "french"), ("/de/", "german")), "other")
    return table(spark, sf_dir, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    """T5: the batch form of windowed counts of a stream."""
    w = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT p_type FROM part), w(wanted) AS (VALUES ('Red Widget'), ('RED_WIDGET'), ('widget'), ('promotion'), ('standing'), ('zzz'), ('large red widget set')),
r AS (SELECT wanted, name, CASE WHEN lower(name) = lower(wanted) OR replace(lower(name), ' ', '_') = lower(wanted) AND false THEN 1 WHEN contains(lower(name), lower(wanted)) OR contains(lower(wanted), lower(name)) THEN 2
  WHEN left(lower(name), 3) = left(lower(wanted), 3) THEN 3 END AS rank FROM n, w)
SELECT wanted, name, CAST(rank AS INTEGER) AS rank FROM r WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY rank, length(name), name) = 1
""")
def closest_name(spark, sf_dir):
    """The nearest name to each of several wanted ones, of all three ranks, or none."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("name")).union(part.select("p_type")).distinct()
    wanted = ("Red Widget", "RED_WIDGET", "widget", "promotion", "standing", "zzz", "large red widget set")
    found = [predicates.closest(names, "name", w).select(F.lit(w).alias("wanted"), "name", F.col("match_rank").alias("rank")) for w in wanted]
    return reduce(DataFrame.unionByName, found)


@query("SELECT p_partkey, p_size, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS INTEGER) AS rank FROM part QUALIFY rank <= 3")
def top_per_group(spark, sf_dir):
    """The largest three of each brand."""
    return ordered.ranked(table(spark, sf_dir, "part"), [F.desc("p_size"), F.col("p_partkey")], 3, ["p_brand"]).select("p_partkey", "p_size", "rank")


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 99 END, o_orderpriority DESC, o_orderdate, o_orderkey) AS place FROM orders
""")
def listed_order(spark, sf_dir):
    """A sort by a listed order, others last, then by a falling and a rising key, ties by key; places of each customer."""
    keys = [ordered.listed_order(F.col("o_orderstatus"), ["F", "O"]), F.desc("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")]
    return ordered.ranked(table(spark, sf_dir, "orders"), keys, 1_000_000_000, ["o_custkey"]).select("o_orderkey", F.col("rank").cast("long").alias("place"))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#7' ORDER BY p_partkey LIMIT (SELECT CASE WHEN count(*) <= 10 THEN count(*) WHEN count(*) <= 100 THEN (count(*) + 1) // 2 ELSE 100 END FROM part WHERE p_brand = 'Brand#7')")
def adaptive_page(spark, sf_dir):
    """The page size follows the number of matches."""
    found = table(spark, sf_dir, "part").where("p_brand = 'Brand#7'").select("p_partkey")
    return ordered.page(found, ["p_partkey"], 0, ordered.page_size(found.count()))


@query("SELECT doc_id, n FROM (SELECT doc_id, line_number AS n, sum(strlen(content) + 1) OVER (PARTITION BY doc_id ORDER BY line_number DESC) AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents)) WHERE b <= 500")
def tail_bytes(spark, sf_dir):
    """The last lines of each file within a byte limit."""
    numbered = files.lines(table(spark, sf_dir, "documents"), "text", "doc_id")
    return ordered.tail_bytes(numbered, "content", 500, ["doc_id"], ["line_number"]).select("doc_id", F.col("line_number").cast("long").alias("n"))


@query("""
WITH e AS (SELECT CAST(user_id % 50 AS VARCHAR) AS session, event_type AS tool, ts FROM events), o AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session ORDER BY ts) > INTERVAL '15 minutes' THEN 1 ELSE 0 END AS opens FROM e
), n AS (SELECT *, sum(opens) OVER (PARTITION BY session ORDER BY ts) AS nth FROM o)
SELECT session, min(ts) AS started, max(ts) AS last, count(*) AS n_calls, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM n GROUP BY session, nth
""")
def streamed_sessions(spark, sf_dir):
    """Events replayed as a stream in four parts, with a restart after two; each session's state lives until it is idle for 15 minutes."""
    calls = table(spark, sf_dir, "events").select((F.col("user_id") % 50).cast("string").alias("session"), F.col("event_type").alias("tool"), F.col("ts").cast("timestamp").alias("ts"))
    folder = f"{graph.folder(spark)}/sessions-{uuid.uuid4().hex}"
    ends = calls.selectExpr("percentile_approx(ts, array(0.25, 0.5, 0.75), 1000) AS q").first()["q"]
    for i, (least, most) in enumerate(zip([None, *ends], [*ends, None], strict=True)):
        part = calls.where((F.lit(True) if least is None else F.col("ts") > F.lit(least)) & (F.lit(True) if most is None else F.col("ts") <= F.lit(most)))
        part.write.parquet(f"{folder}/in/part-{i}")

    def run(parts):
        stream = spark.readStream.schema(calls.schema).parquet(f"{folder}/in/{parts}")
        keep = lambda batch, nth: batch.write.mode("overwrite").parquet(f"{folder}/out/batch-{nth}")
        query = stateful.tracked_sessions(stream, "15 minutes").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    run("part-[01]")
    run("part-[0-3]")
    return stateful.latest(spark.read.parquet(f"{folder}/out/batch-*"))


@query("""
WITH e AS (SELECT CAST(user_id % 20 AS VARCHAR) AS root, CASE event_type WHEN 'click' THEN 'app/models/' WHEN 'error' THEN 'config/routes/' WHEN 'purchase' THEN 'db/migrate/' ELSE 'lib/' END || user_id AS path, ts FROM events), o AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY root ORDER BY ts) >= INTERVAL '10 minutes' THEN 1 ELSE 0 END AS opens FROM e
), n AS (SELECT *, sum(opens) OVER (PARTITION BY root ORDER BY ts) AS nth FROM o)
SELECT root, min(ts) AS started, max(ts) AS ended, count(*) AS n_changes, count(DISTINCT path) AS n_paths,
  string_agg(DISTINCT CASE split_part(path, '/', 1) WHEN 'app' THEN 'models' WHEN 'config' THEN 'routes' WHEN 'db' THEN 'migrations' ELSE 'other' END, ',' ORDER BY CASE split_part(path, '/', 1) WHEN 'app' THEN 'models' WHEN 'config' THEN 'routes' WHEN 'db' THEN 'migrations' ELSE 'other' END) AS kinds
FROM n GROUP BY root, nth
""")
def debounced_changes(spark, sf_dir):
    """Changes in batches that end with ten quiet minutes, with the kinds of their paths."""
    start = F.when(F.col("event_type") == "click", "app/models/").when(F.col("event_type") == "error", "config/routes/").when(F.col("event_type") == "purchase", "db/migrate/").otherwise("lib/")
    seen = table(spark, sf_dir, "events").select((F.col("user_id") % 20).cast("string").alias("root"), F.concat(start, F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    return stateful.debounced(seen, "10 minutes")


@query("""
WITH d AS (
  SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS z, CAST(event_id AS VARCHAR) AS e, CAST(user_id AS VARCHAR) AS u FROM events
), c AS (SELECT *, 6 + length(u) AS c1, 6 + length(u) + 11 + length(k) AS c2, 6 + length(u) + 11 + length(k) + 7 + length(z) AS c3 FROM d),
s AS (SELECT *, c3 + 7 + length(e) AS c4, c3 + 8 + length(e) + length(u) AS c5 FROM c)
SELECT event_id, '{"u":' || u || CASE WHEN c2 <= 44 THEN ',"m":{"k":' || k || CASE WHEN c3 <= 44 THEN ',"z":"' || z || '"' ELSE '' END || '}' ELSE '' END
  || CASE WHEN c4 <= 44 THEN ',"p":[' || e || CASE WHEN c5 <= 44 THEN ',' || u ELSE '' END || ']' ELSE '' END || '}' AS doc,
  CASE WHEN c2 > 44 THEN '$.m.k|' ELSE '' END || CASE WHEN c3 > 44 THEN '$.m.z|' ELSE '' END || CASE WHEN c4 > 44 THEN '$.p[0]|' ELSE '' END || CASE WHEN c5 > 44 THEN '$.p[1]|' ELSE '' END AS cut
FROM s
""")
def document_budget(spark, sf_dir):
    """K4: nested documents cut to 44 characters, whole leaves only, single values first, with the paths that were cut."""
    e = table(spark, sf_dir, "events")
    doc = F.concat(F.lit('{"p":['), "event_id", F.lit(","), "user_id", F.lit('], "m":{"z":"'), "event_type", F.lit('", "k":'), F.get_json_object("props", "$.k"), F.lit('}, "u":'), "user_id", F.lit("}"))
    out = sections.fit_documents(e.select("event_id", doc.alias("doc")), "event_id", "doc", 44)
    return out.select("event_id", "doc", F.concat(F.array_join("cut", "|"), F.when(F.size("cut") > 0, "|").otherwise("")).alias("cut"))


@query("""
SELECT '/app/n' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '/x/../c' ELSE '/c' END || c_custkey || CASE WHEN c_custkey % 7 = 0 THEN '.pem' ELSE '.rb' END AS path, '/app/real/r' || n_regionkey || '/c' || c_custkey || '.rb' AS real
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey % 5 = 2 AND c_custkey % 7 <> 0
""")
def link_containment(spark, sf_dir):
    """Paths whose real place, once links are followed, is inside and not sensitive; links lead outside, to each other, in circles, and up."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    target = F.when(k % 5 == 0, "/etc/secrets").when(k % 5 == 1, F.concat(F.lit("n"), (k - 1).cast("string"))).when(k % 5 == 2, F.concat(F.lit("./real/../real/r"), F.col("n_regionkey").cast("string"))).when(k % 5 == 3, F.concat(F.lit("/app/n"), (k + 1).cast("string"))).otherwise(F.concat(F.lit("../app/n"), (k - 1).cast("string")))
    links = n.select(F.concat(F.lit("/app/n"), k.cast("string")).alias("link"), target.alias("target"))
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("/app/n"), "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, "/x/../c").otherwise("/c"), "c_custkey", F.when(F.col("c_custkey") % 7 == 0, ".pem").otherwise(".rb"))
    return files.contained(c.select(name.alias("path")), links, "/app").select("path", "real")


@query(r"""
WITH w AS (SELECT p_partkey, split_part(p_name, ' ', 2) AS w FROM part), l AS (
  SELECT p_partkey, unnest([1, 2, 3, 4, 5]) AS line_number, unnest(['def ' || w, '  def self.' || w || '_all', 'class Shop::' || upper(left(w, 1)) || substr(w, 2), '  x.' || w || '(1)', 'the ' || w || 's']) AS line FROM w
), m AS (
  SELECT *, regexp_matches(line, '^\s*def\s+(self\.)?[Ww]idget') AS definition, regexp_matches(line, '^\s*(class|module)\s+(\w+::)*[Ww]idget') AS class, regexp_matches(line, '[Ww]idget') AND NOT regexp_matches(line, '^\s*def\s') AS call, regexp_matches(line, '\b[Ww]idget\b') AS whole FROM l
)
SELECT p_partkey, line_number, definition, class, call, whole FROM m WHERE definition OR class OR call OR whole
""")
def line_modes(spark, sf_dir):
    """Lines that define a name, open its class, or call it; whole words or parts."""
    w = F.substring_index("p_name", " ", -1)
    five = F.array(F.concat(F.lit("def "), w), F.concat(F.lit("  def self."), w, F.lit("_all")), F.concat(F.lit("class Shop::"), F.initcap(w)), F.concat(F.lit("  x."), w, F.lit("(1)")), F.concat(F.lit("the "), w, F.lit("s")))
    lines = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(five).alias("pos", "line"))
    hit = lambda mode, exact=False: predicates.line_matches(F.col("line"), "[Ww]idget", mode, exact)
    marked = lines.select("p_partkey", (F.col("pos") + 1).alias("line_number"), hit("definition").alias("definition"), hit("class").alias("class"), hit("call").alias("call"), hit("any", True).alias("whole"))
    return marked.where("definition OR class OR call OR whole")


@query("""
SELECT doc_id, CAST(length(text) - length(replace(lower(text), 'e', '')) AS BIGINT) AS n_e, sha256(text) IN (SELECT sha256(text) FROM documents WHERE source IN (SELECT max(source) FROM documents)) AS hit FROM documents
""")
def content_cache(spark, sf_dir):
    """Values of texts by their digest: those of one source first, then all; what the first call computed is not computed again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    count = lambda lacking: lacking.select("digest", (F.length("text") - F.length(F.replace(F.lower("text"), F.lit("e"), F.lit("")))).cast("long").alias("value"))
    cache = ContentCache(spark, f"{graph.folder(spark)}/content-{uuid.uuid4().hex}", count)
    cache.get(docs.join(docs.agg(F.max("source").alias("source")), "source"), "text")
    return cache.get(docs, "text").select("doc_id", F.col("value").alias("n_e"), "hit")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10)")
def last_reversed(spark, sf_dir):
    """The last ten rows of each user, oldest first."""
    last = ordered.ranked(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 10, ["user_id"]).drop("rank")
    return ordered.ranked(last, [F.col("ts"), F.col("event_id")], 10, ["user_id"]).select("user_id", "event_id", F.col("rank").cast("long").alias("place"))
