"""What SQL may run: a check of the statement's words, and a list of allowed nodes, functions and relations of Spark's parsed plan.

The plan check decides what Spark would do and always runs. The word check knows what other engines would do: it refuses
names of functions that reach files or the network, sensitive columns, and clauses that lock or write.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of the text policy.
FILE_FUNCTIONS = frozenset(
    "pg_read_binary_file pg_read_file pg_ls_dir pg_ls_logdir pg_ls_tmpdir pg_ls_waldir pg_ls_archive_statusdir pg_stat_file pg_file_settings pg_current_logfile lo_import lo_export load_file load_extension".split()
)
SECRET_SHOWS = frozenset("grants processlist binlog slave master replicas".split())
WRITING = frozenset("insert update delete drop alter truncate create grant revoke set copy merge replace".split())
OPENING = frozenset("select with show explain describe desc".split())
METADATA = OPENING - {"select", "with"}
SENSITIVE_NAMES = (
    "password_digest", "password_hash", "encrypted_password", "password_reset_token", "confirmation_token", "unlock_token", "remember_token", "reset_password_token",
    "api_key", "api_secret", "access_token", "refresh_token", "jti", "otp_secret", "session_data", "secret_key", "secret", "private_key",
)
#: Spark's own functions that run code or tell about files.
ESCAPES = frozenset("java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length".split())
#: Functions that give rows.
TABLE_FUNCTIONS = frozenset("range explode explode_outer inline inline_outer json_tuple posexplode posexplode_outer stack variant_explode variant_explode_outer".split())
#: Nodes of a parsed plan that read only. Anything else is refused.
READ_NODES = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedInlineTable OneRowRelation UnresolvedWith CTERelationDef"
    " WithCTE UnresolvedHaving Window WithWindowDefinition Generate Expand Pivot UnresolvedPivot Unpivot Tail Sample LateralJoin Range LocalRelation UnresolvedTableValuedFunction ResolvedHint UnresolvedHint View"
    " UnresolvedTVFAliases RepartitionByExpression Repartition UnionLoop UnionLoopRef UnresolvedOrdinal PipeOperator".split()
)
META_NODES = frozenset(
    "ShowTables ShowTablesCommand ShowColumns ShowColumnsCommand ShowNamespaces ShowNamespacesCommand ShowFunctions ShowCreateTable ShowViews ShowPartitions ShowTableProperties DescribeRelation DescribeColumn DescribeQueryCommand DescribeFunction"
    " ExplainCommand DescribeNamespace UnresolvedNamespace CurrentNamespace UnresolvedTableOrView UnresolvedTable UnresolvedFunctionName UnresolvedView".split()
)
#: Commands that hold a statement of their own, which is checked like any other.
_BODIES = {"ExplainCommand": "logicalPlan", "DescribeQueryCommand": "plan"}
_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`|[0-9]+(?:\.[0-9]+)?|\w+|[^\w\s]")


@dataclass(frozen=True)
class Policy:
    """What a caller may do.

    redacted and encrypted columns are hidden besides those with sensitive names, but for allowed ones. functions are
    registered functions that statements may call. strict_text also refuses UNION, conditions that always hold and words that write, anywhere.
    """

    enabled: bool = True
    strict_text: bool = False
    redacted: tuple[str, ...] = ()
    encrypted: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    functions: tuple[str, ...] = ()
    redact: bool = True
    default_rows: int = 100
    most_rows: int = 1000
    timeout_s: float = 5.0

    @property
    def hidden(self) -> tuple[str, ...]:
        return (*self.redacted, *self.encrypted)


def without_comments(sql: str) -> str:
    """SQL without comments; what an executable comment holds stays."""
    for pattern, put in ((r"(?s)/\*!\d*(.*?)\*/", r" \1 "), (r"(?s)/\*.*?\*/", " "), (r"--[^\n]*", " "), (r"(?m)^\s*#[^\n]*", " ")):
        sql = re.sub(pattern, put, sql)
    return sql.strip()


def _follows(words: list[str], at: int, *wanted: str) -> bool:
    return words[at : at + len(wanted)] == list(wanted)


def _literal(token: str) -> bool:
    return token[0] in "'\"" or token.isdigit()


def _clauses(words: list[str], tokens: list[str]) -> Iterator[str]:
    """What the words of a statement do besides reading, in their order."""
    selecting = False
    for at, word in enumerate(words):
        if word == ";" and at + 1 < len(words):
            yield "more than one statement"
        elif word == "for" and (words[at + 1 : at + 2] in (["update"], ["share"]) or _follows(words, at + 1, "no", "key", "update")):
            yield "a locking clause"
        elif word == "show" and words[at + 1 : at + 2] and words[at + 1] in SECRET_SHOWS:
            yield f"SHOW {words[at + 1].upper()}"
        elif word == "into" and selecting:
            yield "SELECT INTO, which makes a table"
        selecting = selecting or word == "select"


def _always_true(words: list[str], tokens: list[str]) -> Iterator[str]:
    for at, word in enumerate(words):
        after = tokens[at + 1 : at + 4]
        if word == "or" and (words[at + 1 : at + 2] == ["true"] or len(after) == 3 and after[1] == "=" and _literal(after[0]) and _literal(after[2]) and after[0].isdigit() == after[2].isdigit()):
            yield "a condition that always holds"
        elif word == "union" and (_follows(words, at + 1, "select") or _follows(words, at + 1, "all", "select")):
            yield "UNION"


def check_text(sql: str | None, policy: Policy = Policy()) -> str | None:
    """Why the words of a statement are refused, or None."""
    if sql is None or not sql.strip():
        return "There is no statement."
    clean = without_comments(sql)
    named = set(re.findall(r"\w+", f"{sql} {clean}".lower()))
    if bad := sorted(n for n in named if n in FILE_FUNCTIONS or n.startswith("dblink")):
        return f"Refused: {bad[0]} reaches files or the network."
    tokens = _TOKEN.findall(clean)
    words = [t.strip("`").lower() for t in tokens]
    if _at_load := [i for i, w in enumerate(words) if w == "load" and _follows(words, i + 1, "data")]:
        return "Refused: LOAD DATA reaches files."
    if bad := [w for w, after in zip(words, words[1:], strict=False) if w in ESCAPES and after == "("]:
        return f"Refused: {bad[0]} runs code or tells about files."
    findings = [*_clauses(words, tokens)]
    if policy.strict_text:
        findings += [*_always_true(words, tokens), *(f"the word {w.upper()}" for w in words if w in WRITING)]
    if findings:
        return f"Refused: {findings[0]}."
    if not words or words[0] not in OPENING:
        return "Refused: a statement must begin with SELECT, WITH, SHOW, EXPLAIN or DESCRIBE."
    if name := sensitive_name(" ".join(t for t in tokens if t[0] != "'"), policy):  # a text in quotes names no column
        return f"Refused: the column {name} is sensitive."
    return None


def refusals(statements: DataFrame, policy: Policy = Policy(), column: str = "statement") -> DataFrame:
    """statements with refused, why the words of each are refused, or null: the audit of a log, done where its rows lie."""
    judge = F.pandas_udf(lambda texts: texts.map(lambda sql: check_text(sql, policy)), "string")
    return statements.withColumn("refused", judge(F.col(column)))


def is_metadata(sql: str) -> bool:
    """Whether a statement describes metadata."""
    first = re.match(r"\w+", without_comments(sql))
    return bool(first) and first[0].lower() in METADATA


def sensitive_name(sql: str, policy: Policy) -> str | None:
    """The first sensitive column that the text names as a whole word."""
    allowed, found = {a.lower() for a in policy.allowed}, set(re.findall(r"\w+", sql.lower()))
    wanted = [*(r.lower() for r in policy.hidden), *SENSITIVE_NAMES]
    return next((n for n in wanted if n and n not in allowed and n in found), None)


def _items(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _texts(seq) -> list[str]:
    return [str(x) for x in _items(seq)]


@dataclass
class Parsed:
    """Names in a parsed plan, subqueries included: nodes, functions (as written, by parts), functions that give rows, and relations."""

    nodes: set[str]
    functions: set[tuple[str, ...]]
    table_functions: set[tuple[str, ...]]
    relations: set[tuple[str, ...]]
    computed_names: bool = False


def parsed(spark: SparkSession, sql: str) -> Parsed:
    """What Spark's parser makes of a statement; nothing is looked up."""
    catalyst = "org.apache.spark.sql.catalyst"
    gateway = spark.sparkContext._gateway
    a = lambda node, name: is_instance_of(gateway, node, f"{catalyst}.{name}")
    out = Parsed(set(), set(), set(), set())
    waiting = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while waiting:
        node = waiting.pop()
        kind = node.getClass().getSimpleName()
        if a(node, "plans.QueryPlan"):
            out.nodes.add(node.nodeName().strip().strip("'$"))
            if kind in ("UnresolvedRelation", "UnresolvedTableOrView", "UnresolvedTable", "UnresolvedView"):
                out.relations.add(tuple(_texts(node.multipartIdentifier())))
            if kind in _BODIES:  # the statement inside is no child
                waiting.append(getattr(node, _BODIES[kind])())
            if kind == "UnresolvedTableValuedFunction":
                out.table_functions.add(tuple(_texts(node.name())))
            for group in (node.children(), node.innerChildren(), node.expressions()):
                waiting += list(_items(group))
        elif a(node, "expressions.Expression"):
            if kind == "UnresolvedFunction":
                out.functions.add(tuple(_texts(node.nameParts())))
            if kind == "UnresolvedGenerator":
                out.table_functions.add((str(node.name().funcName()),))
            out.computed_names = out.computed_names or "UnresolvedIdentifier" in kind
            if a(node, "expressions.PlanExpression"):
                waiting.append(node.plan())
            waiting += list(_items(node.children()))
    return out


def plan_nodes(spark: SparkSession, sql: str) -> set[str]:
    """Names of the nodes of Spark's parsed plan of a statement, subqueries included."""
    return parsed(spark, sql).nodes


def check_plan(spark: SparkSession, sql: str, policy: Policy = Policy()) -> str | None:
    """Why the parsed plan is refused, or None.

    Functions must be Spark's own, not among those that run code, or named in the policy; a relation with a database must name one
    that exists, so that no data source is read by its path, whatever the session allows.
    """
    found = parsed(spark, sql)
    if strange := sorted(found.nodes - READ_NODES - META_NODES):
        return f"Refused: {strange[0]} does more than read."
    if found.computed_names:
        return "Refused: names must be written out."
    known = _own_functions(spark)
    for parts in sorted(found.functions | found.table_functions):
        name, where = parts[-1].lower(), [p.lower() for p in parts[:-1]]
        own = name in (known | TABLE_FUNCTIONS if parts in found.table_functions else known) and name not in ESCAPES and where in ([], ["builtin"], ["system", "builtin"])
        if not own and ".".join(parts).lower() not in {f.lower() for f in policy.functions}:
            return f"Refused: the function {'.'.join(parts)} is not allowed."
    for parts in sorted(found.relations):
        if len(parts) > 2 or len(parts) == 2 and not spark.catalog.databaseExists(f"`{parts[0].replace('`', '``')}`"):
            return f"Refused: {'.'.join(parts[:-1])} is not a database."
    return None


_OWN: dict[str, frozenset[str]] = {}


def _own_functions(spark: SparkSession) -> frozenset[str]:
    if spark.version not in _OWN:
        _OWN[spark.version] = frozenset(r[0].rsplit(".", 1)[-1].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect())
    return _OWN[spark.version]
