import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import pii


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    """Base spans by the contract's own patterns."""
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def check(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("body", F.lit("clash")).withColumn("email", F.lit(1))
    got = pii.digest(pii.find_pii(frame)).collect()
    assert len(got) == len(rows)
    for r, (doc, text) in zip(got, rows, strict=True):
        want = brute(text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.doc_id == doc and r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (text, r.spans, joined)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[3] == k for x in want) for k in pii.BASE_KINDS)
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    return got


def test_table_and_odd_rows(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    odd = [
        None, "", " ", "a@b.c_d@e.f x", "é😀 bob@example.com 😀 10.0.0.300 1.2.3.4.5.6.7.8 0255.1.1.001", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567)", "+" + "1" * 30, "1" * 2_000, "a" * 2_000, "1.1.1.1 " * 400,
        "@" * 1000, "x@y", "+1+1+1+12345678901", "4111111111111111 4111111111111111", "5 4111111111111111", "99999999999999999999.1.1.1", "é@b.co",
    ]
    check(spark, docs + [(i, t) for i, t in enumerate(odd)] + [(None, "a@b.co"), (1, "a@b.co")])
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_texts(spark):
    """The patterns above take time that is quadratic in a run of signs, so these results are stated by hand."""
    texts = ["1" * 200_000, "a" * 300_000, "x " * 100_000 + "bob@example.com", "@" * 200_000, "1." * 20_000 + " 10.0.0.1"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_pii(frame.where("doc_id != 4"))).collect()}
    assert got == {0: "", 1: "", 2: "email:200000:200015", 3: ""}
    last = pii.digest(pii.find_pii(frame.where("doc_id = 4"))).first()
    assert last.n_ip == 5_001


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="01.25@a-+ ()é%_\n", max_size=60), min_size=30, max_size=60))
def test_random_texts(spark, texts):
    check(spark, list(enumerate(texts)))


@pytest.mark.parametrize(("text", "want"), [("IBAN DE89 3704 0044 0532 0130 00.", "iban:5:32"), ("IBAN DE89 3704 0044 0532 0130 01.", ""), ("account GB82WEST12345698765432", "iban:8:30"), ("my SSN is 123-45-6789", "ssn:10:21"), ("part 123-45-6789", ""), ("SSN 000-45-6789", ""), ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "secret:9:49"), ("commit 04dbebab91ab85687d33eeaaf9ac699e1188f962", ""), ("key abcdefghijklmnopqrstuvwxyz", "")])
def test_added_kinds(spark, text, want):
    assert pii.digest(pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first().spans == want


def test_score_of_a_row(spark):
    rows = [(1, None), (2, "nothing"), (3, "write to a@b.co"), (4, "e-mail: a@b.co"), (5, "card 4111111111111111"), (6, "ssn 123-45-6789, e-mail a@b.co")]
    got = {r.doc_id: (r.score, r.n_spans) for r in pii.digest(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (80, 1), 4: (100, 1), 5: (110, 1), 6: (100, 2)}
