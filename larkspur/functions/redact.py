"""Redaction of columns, log lines and nested values."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers, sensitive column endings and parts.
FILTERED, EMAIL = "[FILTERED]", "[EMAIL]"
SUFFIXES = ("password", "secret", "token", "key", "digest", "hash")
PARTS = ("password", "secret", "token")

# What log lines lose, in the order in which rules apply, as (pattern, replacement). Word borders are spelt as
# ASCII classes, so that every engine reads them alike.
_START, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
LOG_RULES: tuple[tuple[str, str], ...] = (
    (r"\x1b\[[0-9;]*[mGKHF]", ""),
    (r"(?i)\[dotenv\]\s+Set\s+[^\n]*", f"[dotenv] Set {FILTERED}"),
    (_START + r"[A-Z][A-Z0-9_]*(?:SECRET|KEY|TOKEN|PASSWORD|API|CREDENTIAL)[A-Z0-9_]*=\S+", FILTERED),
    (r"(?i)(?<![A-Za-z0-9._%+-])([.%+-]*+)[A-Za-z0-9_][A-Za-z0-9._%+-]*+@[A-Za-z0-9.-]+\.[A-Z]{2,}" + _END, f"$1{EMAIL}"),
    (r"(?i)((?:password|token|secret|api_key)(?:=|:\s)|(?:session_id|_session)=|cookie:\s)\S+", rf"$1{FILTERED}"),
    (r'(?i)("password"(?::\s*|=>)")[^"]+(")', rf"$1{FILTERED}$2"),
    (r"(?i)(authorization:\s)(?:Bearer\s)?\S+", rf"$1{FILTERED}"),
    (r"(?i)((?:SECRET|PRIVATE|SIGNING|ENCRYPTION)[_A-Z]*=)\S+", rf"$1{FILTERED}"),
    (
        _START + r"(?:AKIA[0-9A-Z]{16}|[sr]k_(?:live|test)_[A-Za-z0-9]{10,}|SG\.[A-Za-z0-9_-]{22,}\.[A-Za-z0-9_-]{10,}|xox[bpras]-[A-Za-z0-9-]{10,}|gh[pus]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{36,})" + _END,
        FILTERED,
    ),
    (_START + r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", FILTERED),
    (r"-----BEGIN\s+(?:RSA|DSA|EC|OPENSSH)?\s*PRIVATE KEY-----", FILTERED),
)
#: For each rule what a text holds wherever the rule matches: groups of texts, one of each group, looked for in the lower-cased text.
_SECRETS = ("secret", "key", "token", "password", "api", "credential")
HINTS: tuple[tuple[tuple[str, ...], ...], ...] = (
    (("\x1b[",),), (("[dotenv]",),), (("=",), _SECRETS), (("@",),), (("password", "token", "secret", "api_key", "session", "cookie"),), (('"password"',),), (("authorization:",),),
    (("=",), ("secret", "private", "signing", "encryption")), (("akia", "_live_", "_test_", "sg.", "xox", "ghp_", "ghu_", "ghs_", "glpat-", "npm_"),), (("eyj",),), (("-----begin",),),
)


# Parts of names that make a setting secret, and last parts that make it a mere description.
SECRET_PARTS = (
    "password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "credentials", "pepper", "salt", "master_key", "signing_key", "encryption_key", "deterministic_key",
)
DESCRIPTIONS = (
    "length", "size", "min", "max", "expiry", "ttl", "strategy", "regex", "format", "field", "param", "params", "column", "columns", "name", "names", "enabled", "required", "confirmation", "count", "algorithm", "method", "type",
)
# Settings that are secret under this path only, and the shape of a bare credential.
SECRET_PATHS = ("encryption.primary_key", "encryption.deterministic_key", "encryption.key_derivation_salt")
CREDENTIAL = r"(?i)[a-f0-9]{16,}|sk_|pk_"

_ASSIGNED = rf"(?i)(?:[a-z0-9_]*(?:{'|'.join(SECRET_PARTS)})[a-z0-9_]*)\s*(?:=>|=|:)\s*(?:\"[^\"]*\"|'[^']*'|[^\s,;)\]}}\"'\[{{:=>][^\s,;)\]}}]*)"


def secret_name(name: Column) -> Column:
    """Whether a setting's name holds a secret part between underscores and does not end as a description."""
    return name.rlike(rf"(?i)(?:^|_)(?:{'|'.join(SECRET_PARTS)})(?:_|$)") & ~name.rlike(rf"(?i)_(?:{'|'.join(DESCRIPTIONS)})$")


def sensitive(name: str, extra: Iterable[str] = (), allowed: Iterable[str] = ()) -> bool:
    """Whether a result column is hidden: a configured name, a sensitive ending or part; never an allowed one."""
    low = name.lower()
    if low in {a.lower() for a in allowed}:
        return False
    return low in {e.lower() for e in extra} or low.endswith(SUFFIXES) or any(p in low for p in PARTS)


def redact_columns(df: DataFrame, extra: Iterable[str] = (), allowed: Iterable[str] = ()) -> DataFrame:
    """df with every cell of its sensitive columns hidden, nulls too; the columns' names and order stay."""
    return df.select([F.lit(FILTERED).alias(c) if sensitive(c, extra, allowed) else F.col(f"`{c}`") for c in df.columns])


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def redact_line(line: Column) -> Column:
    """A log line without credentials and addresses. Each rule runs only where the text holds what it needs, which is looked for byte by byte.

    Colours go first, as they may part what another rule looks for; what the later rules put in never makes or breaks a match of another.
    """

    def hinted(low: Column, groups: tuple) -> Column:
        return reduce(lambda a, b: a & b, (reduce(or_, (F.contains(low, F.lit(h)) for h in one)) for one in groups))

    def ruled(at: int, low: Column, text: Column) -> Column:
        pattern, put = LOG_RULES[at]
        done = F.when(hinted(low, HINTS[at]), F.regexp_replace(text, pattern, put)).otherwise(text)
        return done if at + 1 == len(LOG_RULES) else _let(done, lambda t: ruled(at + 1, low, t))

    plain = F.when(F.contains(line, F.lit(HINTS[0][0][0])), F.regexp_replace(line, *LOG_RULES[0])).otherwise(line)
    return _let(plain, lambda text: _let(F.lower(text), lambda low: ruled(1, low, text)))


def redact_value(text: Column) -> Column:
    """A source or setting text without the values of secrets; values that merely describe one, and collections, stay.

    The text is taken apart at assignments to names that hold a secret word; each name is then judged by itself.
    """
    plain = F.regexp_replace(text, r"(://)[^\s/@]*:[^\s@]+@", f"$1{FILTERED}@")
    found, between = F.regexp_extract_all(plain, F.lit(_ASSIGNED), F.lit(0)), F.split(plain, _ASSIGNED, -1)

    def judged(one: Column) -> Column:
        head, name = F.regexp_extract(one, r"^[^:=]*(?:=>|=|:)\s*", 0), F.regexp_extract(one, r"^\w+", 0)
        value = F.substring(one, F.length(head) + 1, F.length(one))
        put = F.when(value.rlike("^[\"']"), f'"{FILTERED}"').otherwise(FILTERED)
        return F.when(secret_name(name), F.concat(head, put)).otherwise(one)

    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("one"))
    joined = F.concat(F.array_join(F.transform(pairs, lambda p: F.concat(p["gap"], judged(p["one"]))), ""), F.element_at(between, -1))
    return F.when(F.size(found) > 0, joined).otherwise(plain)


def redact_then_shorten(text: Column, n: int) -> Column:
    """Redacted first and shortened after: a cut must not take away what a pattern needs."""
    from larkspur.functions.text import truncate

    return truncate(redact_value(text), n)


def redact_map(values: Column) -> Column:
    """A map of settings: values under secret names are hidden, credential-shaped values too, others scrubbed."""
    return F.transform_values(values, lambda k, v: F.when(v.isNull(), v).when(secret_name(k) | v.rlike(CREDENTIAL), F.lit(FILTERED)).otherwise(redact_value(v)))


def redact_rows(leaves: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """Nested values as rows of path (an array of keys) and value: a secret key anywhere on the path, or a secret path, hides the leaf."""
    ends = F.lower(F.array_join(path, "."))
    at_path = reduce(or_, (ends.endswith(p) for p in SECRET_PATHS))
    hidden = F.exists(F.col(path), secret_name) | at_path | F.col(value).rlike(CREDENTIAL)
    return leaves.withColumn(value, F.when(F.col(value).isNull(), None).when(hidden, FILTERED).otherwise(redact_value(F.col(value))))
