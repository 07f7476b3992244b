"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Irregular and uncountable nouns, and suffix rules in the order in which they are tried.
UNCOUNTABLE = ("equipment", "information", "rice", "money", "species", "series", "fish", "sheep", "jeans", "police")
IRREGULAR = (("person", "people"), ("man", "men"), ("child", "children"), ("move", "moves"), ("zombie", "zombies"))
SINGULAR_RULES = (
    ("(database)s$", "$1"), ("(quiz)zes$", "$1"), ("(matr)ices$", "$1ix"), ("(vert|ind)ices$", "$1ex"), ("(alias|status)(es)?$", "$1"),
    ("(octop|vir)(us|i)$", "$1us"), ("(ax|test)es$", "$1is"), ("(cris|diagnos|analys|bas|hypothes|parenthes)es$", "$1is"), ("(shoe)s$", "$1"), ("(o)es$", "$1"), ("(bus)(es)?$", "$1"), ("^(ox)en$", "$1"), ("(hive)s$", "$1"), ("(tive)s$", "$1"), ("([ti])a$", "$1um"), ("([ml])ice$", "$1ouse"),
    ("(x|ch|ss|sh)es$", "$1"), ("(m)ovies$", "$1ovie"), ("([^aeiouy]|qu)ies$", "$1y"), ("([lr])ves$", "$1f"), ("([^f])ves$", "$1fe"),
    ("(n)ews$", "$1ews"), ("(ss)$", "$1"), ("s$", ""),
)
PLURAL_RULES = (
    ("(quiz)$", "$1zes"), ("(matr|vert|ind)(?:ix|ex)$", "$1ices"), ("(x|ch|ss|sh)$", "$1es"), ("([^aeiouy]|qu)y$", "$1ies"), ("(?:([^f])fe|([lr])f)$", "$1$2ves"),
    ("sis$", "ses"), ("([ti])um$", "$1a"), ("(buffal|her|potat|tomat)o$", "$1oes"), ("^(ox)$", "$1en"), ("(bus|alias|status)$", "$1es"), ("(octop|vir)us$", "$1i"), ("(ax|test)is$", "$1es"), ("s$", "s"), ("$", "s"),
)


def _inflected(word: Column, pairs: tuple, rules: tuple) -> Column:
    out = F.when(F.lower(word).isin(*UNCOUNTABLE), word)
    for a, b in pairs:  # of the last word of a name
        last = f"(^|[_/-]){a}$"
        out = out.when(word.rlike(last), F.regexp_replace(word, last, f"$1{b}")).when(word.rlike(f"(^|[_/-]){b}$"), word)
    for pattern, put in rules:
        out = out.when(word.rlike(pattern), F.regexp_replace(word, pattern, put))
    return out.otherwise(word)


def singularize(word: Column) -> Column:
    """The singular of an English noun, by the suffix rules."""
    return _inflected(word, tuple((b, a) for a, b in IRREGULAR), SINGULAR_RULES)


def pluralize(word: Column) -> Column:
    """The plural of an English noun, by the suffix rules."""
    return _inflected(word, IRREGULAR, PLURAL_RULES)


def underscore(name: Column) -> Column:
    """CamelCase and dashes to lower_case words; ``::`` becomes a slash."""
    split = F.regexp_replace(F.regexp_replace(name, "::", "/"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.translate(F.regexp_replace(split, "([a-z0-9])([A-Z])", "$1_$2"), "-", "_"))


def camelize(name: Column) -> Column:
    """lower_case words to CamelCase; a slash becomes ``::``."""
    return F.regexp_replace(F.array_join(F.transform(F.split(F.regexp_replace(name, "/", "_::_"), "_"), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 20))), ""), "_", "")


def classify(name: Column) -> Column:
    """The class name of a table name."""
    return camelize(singularize(name))


def truncate(text: Column, n: int, omission: str = "...") -> Column:
    """At most n characters, the omission included."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - len(omission))), F.lit(omission))).otherwise(text)


def truncate_at_word(text: Column, n: int, omission: str = "...") -> Column:
    """At most n characters, back to the last whole word where there is one, and the omission behind; shorter texts as they are."""
    cut = F.left(text, F.lit(n))
    return F.when(F.length(text) > n, F.concat(F.coalesce(F.nullif(F.regexp_extract(cut, r"(?s)^(.*) [^ ]*$", 1), F.lit("")), F.when(cut.startswith(" ") & (F.instr(F.substring(cut, 2, n), " ") == 0), "").otherwise(cut)), F.lit(omission))).otherwise(text)


def counted(n: Column, noun: str, many: str | None = None) -> Column:
    """A number with its noun, in the plural unless it is one."""
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, noun).otherwise(F.lit(many) if many else pluralize(F.lit(noun))))


def portable_path(path: Column, root: str, installs: tuple[str, ...] = ()) -> Column:
    """A path below root without it, one below an install folder without that; the longest folder wins, others stay."""
    out = F.when(path.startswith(f"{root.rstrip('/')}/") if root else F.lit(False), F.substring(path, len(root.rstrip("/")) + 2, 1 << 20))
    for folder in sorted(installs, key=len, reverse=True):
        out = out.when(path.startswith(f"{folder.rstrip('/')}/"), F.substring(path, len(folder.rstrip("/")) + 2, 1 << 20))
    return out.otherwise(path)


def bytes_text(size: Column, base: int = 1024) -> Column:
    """A byte count with its unit and at most one decimal, in powers of 1024 or 1000."""
    out = None
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        scaled = F.format_string(f"%.1f {unit}", F.round(size / base**power, 1))
        out = F.when(size >= base**power, scaled) if out is None else out.when(size >= base**power, scaled)
    return out.otherwise(F.concat(size.cast("string"), F.lit(" B")))


def ago(then: Column, now: Column) -> Column:
    """Time since then: seconds, minutes or hours."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, text(s, "s")).when(s < 3600, text(F.floor(s / 60), "m")).otherwise(text(F.floor(s / 3600), "h"))


def log_level(line: Column, as_json: bool = False) -> Column:
    """The level of a log line, upper-case, or null; WARNING counts as WARN. JSON lines are read by pattern."""
    pattern = r'(?i)"level"\s*:\s*"(\w+)"' if as_json else r"(?i)\b(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL)\b"
    found = F.upper(F.regexp_extract(line, pattern, 1))
    return F.when(found == "", None).when(found == "WARNING", "WARN").otherwise(found)


# Ranks of log levels; an unknown one ranks as DEBUG.
LEVEL_RANK = {"DEBUG": 0, "INFO": 1, "WARN": 2, "ERROR": 3, "FATAL": 4}


def level_rank(level: Column) -> Column:
    out = F.when(level.isNull(), None)
    for name, rank in LEVEL_RANK.items():
        out = out.when(level == name, rank)
    return out.otherwise(0)


def keyword_score(words: list[str], title: Column, summary: Column, keywords: Column) -> Column:
    """10 for each word in the title, 5 in the summary, 1 if any keyword holds it."""
    total = F.lit(0)
    for w in words:
        low = w.lower()
        total = total + F.when(F.lower(title).contains(low), 10).otherwise(0) + F.when(F.lower(summary).contains(low), 5).otherwise(0)
        total = total + F.when(F.exists(keywords, _holds(low)), 1).otherwise(0)
    return total


def _holds(low: str):
    return lambda k: F.lower(k).contains(low)


def words_in_run(text: Column, phrase: list[str]) -> Column:
    """Whether the identifier words of text hold the phrase as a contiguous run, plural or singular."""
    found = F.transform(F.regexp_extract_all(underscore(text), F.lit("[a-z0-9]+"), F.lit(0)), singularize)
    wanted = F.array(*(singularize(F.lit(w.lower())) for w in phrase))
    starts = F.sequence(F.lit(1), F.greatest(F.size(found) - len(phrase) + 1, F.lit(1)))
    return F.exists(starts, lambda i: F.slice(found, i, F.lit(len(phrase))) == wanted)


def sql_without_comments(sql: Column) -> Column:
    """SQL text without block, line and hash comments; what an executable comment holds stays."""
    for pattern, put in ((r"(?s)/\*!\d*(.*?)\*/", " $1 "), (r"(?s)/\*.*?\*/", " "), (r"--[^\n]*", " "), (r"(?m)^\s*#[^\n]*", " ")):
        sql = F.regexp_replace(sql, pattern, put)
    return F.trim(sql)
