"""Personal data in text: regular expressions propose, checksums confirm, context words adjust the score.

Every step is a column expression. Offsets come from pairing a text's matches with the pieces between them: the
pieces' and matches' lengths, summed, are the code-point offsets. A cheap test of the whole text comes first, so
that most texts never meet the costly expressions.

Four base kinds are always kept once their own checks pass (email; ip with parts up to 255; card with 14 to 19
digits under Luhn; phone with 10 to 15 digits). Three kinds are added by this method and need a score of at least
``THRESHOLD``: iban (pattern 40 points, ISO 7064 mod-97 confirms with 40, a context word within 40 characters before
adds 20), ssn (three, two and four digits in ranges that are issued: pattern 40, context word 40) and secret (24 to 128
letters, digits and underscores with six digits and six letters at least: pattern 40, context word 40). Base spans
carry scores too, but are never dropped for them. A row's score is the largest of its spans, 0 without any.

Patterns are written so that a match takes time linear in the text. ``\\G`` keeps a match that starts where the one
before ended, as leftmost matching asks.

Null texts count as empty: no spans. Very long texts are read in whole. Repeated rows give repeated results, an empty
table an empty one. All other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import once

# The kinds in the order in which equal starts are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "secret")
THRESHOLD = 80

# Context words by kind.
CONTEXT = {
    "email": "e-?mail|contact|correo|courriel|kontakt",
    "ip": "ip|address|adresse|server|host",
    "card": "card|visa|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|telefon|teléfono|téléphone",
    "iban": "iban|account|bank|konto|compte|cuenta|transfer",
    "ssn": "ssn|social|security|sozialversicherung",
    "secret": "token|secret|key|password|passwd|pwd|credential|credentials|bearer|authorization|apikey",
}
#: Points of a context word, where they are not 20.
WEIGHT = {"ssn": 40, "secret": 40}

_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PROPOSE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
    "ssn": r"(?<![A-Za-z0-9_])(?:00[1-9]|0[1-9][0-9]|[1-57-8][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])-(?:0[1-9]|[1-9][0-9])-(?:[0-9]{3}[1-9]|[0-9]{2}[1-9]0|[0-9][1-9]00|[1-9]000)(?![A-Za-z0-9_])",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{24,128}+(?![A-Za-z0-9_])",
}
#: Tests of the whole text without which a kind cannot occur.
HINT = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
    "ssn": r"[0-9]-[0-9]{2}-[0-9]{4}",
    "secret": r"[A-Za-z0-9_]{24}",
}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an international account number, blanks removed, has the ISO 7064 remainder of one."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        value = F.ascii(c)
        return F.when(value < 58, (rest * 10 + value - 48) % 97).otherwise((rest * 100 + value - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _confirmed(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        digits = _digits(s)
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    if kind == "secret":
        return s.rlike("(?:[A-Za-z_]*[0-9]){6}") & s.rlike("(?:[0-9_]*[A-Za-z]){6}")
    return F.lit(True)


def _checksum(kind: str, s: Column) -> Column:
    if kind == "iban":
        code = F.regexp_replace(s, " ", "")
        return F.when(F.length(code).between(15, 34) & mod97(code), 40).otherwise(0)
    return F.lit(50 if kind == "card" else 40 if kind in BASE_KINDS else 0)


def _placed(pairs: Column) -> Column:
    """Structs of start, end, body and before for pairs of a match and the piece before it.

    Appending to an array copies it, so the pairs are taken in runs of about the square root of their number: each run
    is placed from its own zero, and the runs' offsets are then added.
    """
    here = "array<struct<start:int,end:int,body:string,before:string>>"
    run = F.greatest(F.ceil(F.sqrt(F.size(pairs))).cast("int"), F.lit(1))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(pairs) / run).cast("int") - 1, F.lit(0))), lambda i: F.slice(pairs, i * run + 1, run))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["piece"])
        end = begin + F.length(pair["body"])
        one = F.struct(begin.alias("start"), end.alias("end"), pair["body"].alias("body"), F.right(pair["piece"], F.lit(40)).alias("before"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    inside = F.transform(runs, lambda r: F.aggregate(r, F.struct(F.lit(0).alias("at"), F.array().cast(here).alias("out")), step))

    def shift(state: Column, r: Column) -> Column:
        one = F.struct(state["at"].alias("offset"), r["out"].alias("out"))
        return F.struct((state["at"] + r["at"]).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<offset:int,out:{here}>>").alias("out"))
    moved = lambda x, by: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["body"].alias("body"), x["before"].alias("before"))
    return F.flatten(F.transform(F.aggregate(inside, start, shift)["out"], lambda r: F.transform(r["out"], lambda x: moved(x, r["offset"]))))


def spans_of(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind in a text without nulls: structs of start, end (exclusive, code points), rank, kind and score."""
    rank = (BASE_KINDS + ADDED_KINDS).index(kind)
    pieces, found = F.split(text, PROPOSE[kind], -1), F.regexp_extract_all(text, F.lit(PROPOSE[kind]), F.lit(0))
    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("body"))
    bound = F.transform(F.array(pairs), _placed)[0]  # a lambda's variable is computed once, an expression inside a lambda each time
    placed = F.filter(bound, lambda x: _confirmed(kind, x["body"]))
    scored = F.transform(
        placed,
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(rank).alias("rank"),
            x["end"].alias("end"),
            F.lit(kind).alias("kind"),
            (F.lit(40) + _checksum(kind, x["body"]) + F.when(F.lower(x["before"]).rlike(rf"(?:^|[^\p{{L}}])(?:{CONTEXT[kind]})(?![\p{{L}}])"), WEIGHT.get(kind, 20)).otherwise(0)).alias("score"),
        ),
    )
    if kind in ADDED_KINDS:
        scored = F.filter(scored, lambda x: x["score"] >= THRESHOLD)
    return F.when(text.rlike(HINT[kind]), scored).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:int>>"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of doc_id and one array of spans for each kind, in the columns email, ip, card, phone, iban, ssn and secret."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    kinds = BASE_KINDS + ADDED_KINDS
    found = once(base, "_spans", F.struct(*(spans_of(k, F.col("body")).alias(k) for k in kinds)))
    return found.select("doc_id", *(F.col("_spans")[k].alias(k) for k in kinds))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, all spans and the score of :func:`find_pii`'s rows."""
    every = F.concat(*BASE_KINDS, *ADDED_KINDS)
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(F.concat(*BASE_KINDS)), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ADDED_KINDS),
        F.size(every).cast("long").alias("n_spans"),
        F.coalesce(F.array_max(F.transform(every, lambda x: x["score"])), F.lit(0)).alias("score"),
    )


def _sql_kind(kind: str) -> str:
    """DuckDB SQL for the placed matches of a kind. Its patterns know no look-behind: the base ones are plain, the added ones have word borders."""
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+"}
    pattern = plain.get(kind) or PROPOSE[kind].replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b").replace("}+", "}")
    rank = (BASE_KINDS + ADDED_KINDS).index(kind)
    digits = "regexp_replace(body, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN d[length({digits}) - i] WHEN 2 * d[length({digits}) - i] > 9 THEN 2 * d[length({digits}) - i] - 9 ELSE 2 * d[length({digits}) - i] END)) % 10 = 0"
    luhn = luhn.replace("d[", f"CAST(string_split({digits}, '')[").replace(" - i]", " - i] AS INTEGER)")
    code = "replace(body, ' ', '')"
    numbers = f"list_transform(string_split(substr({code}, 5) || left({code}, 4), ''), lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
    mod97 = f"list_reduce(list_prepend(0, {numbers}), lambda r, v: CASE WHEN v < 10 THEN (r * 10 + v) % 97 ELSE (r * 100 + v) % 97 END) = 1"
    checks = {
        "ip": "len(list_filter(string_split(body, '.'), lambda p: coalesce(try_cast(p AS INTEGER), 999) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "secret": "len(regexp_extract_all(body, '[0-9]')) >= 6 AND len(regexp_extract_all(body, '[A-Za-z]')) >= 6",
    }
    sure = f"CASE WHEN length({code}) BETWEEN 15 AND 34 AND {mod97} THEN 40 ELSE 0 END" if kind == "iban" else "50" if kind == "card" else "40" if kind in BASE_KINDS else "0"
    near = rf"regexp_matches(lower(right(piece, 40)), '(?:^|[^\p{{L}}])(?:{CONTEXT[kind]})(?:[^\p{{L}}]|$)')"
    return f"""
SELECT rid, '{kind}' AS kind, {rank} AS rank, upto - length(body) AS start, upto AS stop, 40 + {sure} + CASE WHEN {near} THEN {WEIGHT.get(kind, 20)} ELSE 0 END AS score FROM (
  SELECT *, sum(length(piece) + length(body)) OVER (PARTITION BY rid ORDER BY i) AS upto FROM (
    SELECT rid, generate_subscripts(found, 1) AS i, unnest(found) AS body, unnest(pieces[1:len(found)]) AS piece FROM (
      SELECT rid, regexp_extract_all(body, '{pattern}') AS found, regexp_split_to_array(body, '{pattern}') AS pieces FROM docs WHERE regexp_matches(body, '{pattern}')))) WHERE {checks.get(kind, "true")}"""


def oracle_sql() -> str:
    """DuckDB SQL for the digest of the table ``documents``."""
    added = ", ".join(f"'{k}'" for k in ADDED_KINDS)
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    listed = lambda where: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER ({where}), '')"
    counts = lambda kinds: ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
spans AS (SELECT * FROM ({" UNION ALL ".join(_sql_kind(k) for k in BASE_KINDS + ADDED_KINDS)}) WHERE kind NOT IN ({added}) OR score >= {THRESHOLD})
SELECT any_value(doc_id) AS doc_id, {counts(BASE_KINDS)}, sha256({listed(f"kind IN ({base})")}) AS base_sha256, {listed("kind IS NOT NULL")} AS spans,
  {counts(ADDED_KINDS)}, count(kind) AS n_spans, CAST(coalesce(max(score), 0) AS INTEGER) AS score
FROM docs LEFT JOIN spans USING (rid) GROUP BY rid
"""
