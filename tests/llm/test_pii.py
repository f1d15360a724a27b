from __future__ import annotations

import random
import re

import pytest

from kinfold.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    double = lambda x: 2 * x - 9 if x > 4 else 2 * x
    return sum(double(int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]():
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


ODD = [None, "", "a@b.com_c@d.org x@y..z 1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.1", "é😀 4111 1111 1111 1111-4111111111111111", "+1 (5)5.5-555 555+12345678901234567 +1234567890 ", "a" * 100_000, "1" * 60_000, "1.2.3.4 " * 2000, "a.b@c.d." * 3000, "4111111111111111 " * 700, "+1 555 555 5555", "x\n1.1.1.1\r\n"]


def test_base_spans_equal_plain_patterns(spark, clash):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("a.@1 +-()5é_\n") for _ in range(rnd.randint(1, 120))) for _ in range(1500)]
    df = clash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["spans"] if s["rank"] < len(pii.BASE)] for r in pii.find_pii(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert pii.find_pii(df.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "kinds"), [
    ("Pay to GB82 WEST 1234 5698 7654 32 please", ["iban"]), ("Pay to GB82 WEST 1234 5698 7654 33 please", []), ("social security 123-45-6789", ["ssn"]), ("part 123-45-6789", []), ('token = "abcdef0123456789abcdef"', ["secret"]), ("call 555-123-4567", ["local_phone"]), ("item 555-123-4567", []),
    ("phone +1 (555) 123-4567", ["phone"]), ("server 10.0.0.1", ["ip"]),
])
def test_context_and_checksums(spark, text, kinds):
    spans = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    assert [s["kind"] for s in spans] == kinds
    assert all(0 < s["score"] <= 1 for s in spans)


@pytest.mark.parametrize(("text", "kinds"), [
    ("social security 123-45-6789, 234-56-7890", ["ssn"] * 2), ("call 555-123-4567 or 555-234-5678", ["local_phone"] * 2), ("123-45-6789, 234-56-7890 by ssn", ["ssn"] * 2), ("ssn 123-45-6789 " + "x" * 40 + " 234-56-7890", ["ssn"]),
])
def test_context_reaches_across_hits(spark, text, kinds):
    assert [s["kind"] for s in pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]] == kinds


def test_scores_equal_context_of_plain_text(spark):
    rnd = random.Random(2)
    parts = ["1.2.3.4", "10.0.0.1", "server", "ip", "é😀", " ", ", ", "x" * 30, "y " * 60, "host "]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        for s in r["spans"]:
            if s["kind"] == "ip":
                text = texts[r["doc_id"]]
                context = text[max(0, s["start"] - pii.NEAR) : s["start"]] + " " + text[s["end"] : s["end"] + pii.NEAR]
                assert s["score"] == (0.8 if re.search(r"\b(ip|server|address|host)", context, re.A) else 0.6)


def test_plan_is_native(spark):
    plan = pii.find_pii(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))
