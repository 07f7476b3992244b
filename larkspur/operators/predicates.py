"""Predicates and classifications as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import camelize, singularize, underscore

# Files that are never shown.
SENSITIVE_GLOBS = (".env", ".env.*", "config/master.key", "config/credentials.yml.enc", "config/credentials/*.yml.enc", "config/credentials/*.key", "*.pem", "*.key", "*.p12", "*.pfx")


def contains_folded(text: Column, part: str) -> Column:
    """Whether text holds part, whatever the case."""
    return F.lower(text).contains(part.lower())


def glob_pattern(globs: Iterable[str]) -> str:
    """A regular expression for relative paths or base names that match any of the globs, case-folded."""
    forms = ("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g) for g in globs)
    return rf"(?i)^(?:.*/)?(?:{'|'.join(forms)})$"


def is_sensitive_path(path: Column, globs: Iterable[str] = SENSITIVE_GLOBS) -> Column:
    return path.rlike(glob_pattern(globs))


def starts_with_any(value: Column, prefixes: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | value.startswith(p)
    return out


def applies(only: Column, skipped: Column, action: Column) -> Column:
    """A filter applies to an action that ``only`` lists; else, unless ``except`` lists it; else always."""
    return F.when(F.size(only) > 0, F.array_contains(only, action)).when(F.size(skipped) > 0, ~F.array_contains(skipped, action)).otherwise(True)


def line_pattern(pattern: str, mode: str = "any", exact: bool = False) -> str:
    """The line pattern of a search mode: any, definition, class or call."""
    core = rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])" if exact else f"(?:{pattern})"
    return {
        "any": core,
        "definition": rf"^\s*def\s+(?:self\.)?{core}",
        "class": rf"^\s*(?:class|module)\s+(?:\w+::)*{core}",
        "call": core,
    }[mode]


def line_matches(line: Column, pattern: str, mode: str = "any", exact: bool = False) -> Column:
    hit = line.rlike(line_pattern(pattern, mode, exact))
    return hit & ~line.rlike(r"^\s*def\s") if mode == "call" else hit


# Kinds of changed files in a review, of environment variables and of error messages, first match first.
REVIEW_KINDS = (
    (r"^app/models/", "model"), (r"^app/controllers/", "controller"), (r"^db/migrate/", "migration"), (r"^app/views/", "view"), (r"^config/routes", "routes"), (r"^(?:spec|test)/", "test"),
    (r"^app/services/", "service"), (r"^app/jobs/", "job"), (r"^app/javascript/", "javascript"), (r"^config/", "config"),
)
VARIABLE_KINDS = (
    (r"(?i)API_KEY|SECRET|TOKEN", "API Keys & Secrets"), (r"(?i)MAIL|IMAP|SMTP", "Mail"), (r"(?i)DATABASE|DB_|REDIS", "Database"), (r"(?i)OTEL|SENTRY|DATADOG|NEWRELIC|APPSIGNAL", "Monitoring"),
    (r"(?i)PUSH|VAPID|FCM", "Push Notifications"), (r"(?i)PORT|CONCURRENCY|THREADS|WORKERS|TIMEOUT|QUEUE|PIDFILE", "Infrastructure"),
)
ERROR_KINDS = (
    (r"undefined local variable or method(?![A-Za-z0-9_])", "NameError"), (r"uninitialized constant(?![A-Za-z0-9_])", "NameError"), (r"undefined method(?![A-Za-z0-9_])", "NoMethodError"),
    (r"wrong number of arguments|missing keywords?:|unknown keywords?:", "ArgumentError"), (r"(?i)couldn't find .+ with", "ActiveRecord::RecordNotFound"), (r"(?i)param is missing or the value is empty", "ActionController::ParameterMissing"),
    (r"(?i)no route matches", "ActionController::RoutingError"), (r'(?i)no such column|no such table|relation ".+" does not exist|column .+ does not exist', "ActiveRecord::StatementInvalid"),
)


def first_case(value: Column, rules: Iterable[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The label of the first pattern that matches."""
    out = None
    for pattern, label in rules:
        out = F.when(value.rlike(pattern), label) if out is None else out.when(value.rlike(pattern), label)
    return out.otherwise(F.lit(otherwise))


def preload_risk(text: Column, name: Column) -> Column:
    """low if the name itself is preloaded, medium if anything is, high otherwise."""
    calls = r"(?:includes|preload|eager_load)\s*\("
    return F.when(F.regexp_like(text, F.concat(F.lit(calls + r"[^)]*:"), name, F.lit(r"\b"))), "low").when(text.rlike(calls), "medium").otherwise("high")


def patterns_found(macros: Column, patterns: dict[str, list[str]]) -> Column:
    """Names of the patterns of which any macro occurs, in the order given."""
    found = [F.when(F.arrays_overlap(macros, F.array(*map(F.lit, wanted))), F.lit(name)) for name, wanted in patterns.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def columns_of_level(detail: str | None, summary: list[str], standard: list[str], full: list[str]) -> list[str]:
    """The columns of a level of detail; an unknown level is standard."""
    return {"summary": summary, "full": full}.get((detail or "").strip().lower(), standard)


def fuzzy_key(df: DataFrame, column: str, wanted: str) -> DataFrame:
    """The best row for a name: equal, then equal as lower_case words, as a singular, as a class name."""
    c, w = F.col(column), F.lit(wanted)
    low = F.lower(c)
    rank = F.when(c == w, 1).when(underscore(c) == underscore(w), 2).when(singularize(underscore(c)) == singularize(underscore(w)), 3).when(low == F.lower(camelize(singularize(w))), 4)
    return df.withColumn("match_rank", rank).where("match_rank is not null").orderBy("match_rank", column).limit(1)


def closest(df: DataFrame, column: str, wanted: str) -> DataFrame:
    """The nearest name: equal but for case and word form, then the shortest that holds it or is held, then one with the same first three letters. A blank name has none."""
    c, w = F.lower(F.col(column)), wanted.lower()
    if not wanted.strip():
        return df.withColumn("match_rank", F.lit(None).cast("int")).limit(0)
    low, under = F.lower(underscore(F.col(column))), F.lower(underscore(F.lit(wanted)))
    rank = F.when((c == w) | (low == under) | (c == under) | (low == w), 1).when(c.contains(w) | F.lit(w).contains(c), 2).when((F.length(c) >= 3) & (F.left(c, F.lit(3)) == w[:3]), 3)
    return df.withColumn("match_rank", rank).where("match_rank is not null").orderBy("match_rank", F.length(c), column).limit(1)


def key_shaped(name: Column) -> Column:
    return name.endswith("_id")


def model_matches(model: Column, table: Column, wanted: str) -> Column:
    """Whether a model or its table is the one named, plural or singular."""
    low, one = wanted.lower(), singularize(F.lit(wanted.lower()))
    return (F.lower(model) == low) | (F.lower(table) == low) | (F.lower(model) == one) | (singularize(F.lower(table)) == one)


def level_filter(df: DataFrame, rank: str, least: int, partition: list[str], order: list[str]) -> DataFrame:
    """Rows whose level, or that of the nearest row before that has one, reaches the least rank; leading rows without are dropped."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("carried_rank", F.last(rank, ignorenulls=True).over(w)).where(F.col("carried_rank") >= least)
