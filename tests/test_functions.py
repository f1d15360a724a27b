from __future__ import annotations

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import columns, formulas, names, places
from kinfold.functions.fuzzy import token_set_ratio


def values(spark, kind, rows, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", make("x")).orderBy("i").collect()]


NAMES = {
    "Acme Capital Partners, L.P.": ("acme capital partners lp", "acme capital partners"),
    "Smith & Sons (Holdings) Ltd.": ("smith and sons holdings ltd", "smith and sons holdings"),
    "Société Générale S.A.": ("societe generale sa", "societe generale"),
    "O’Neil's  Fund-II/III": ("oneils fund ii iii", "oneils fund ii iii"),
    "Straße GmbH & Co. KG": ("strasse gmbh and co kg", "strasse gmbh and"),
    "Ltd": ("ltd", ""),
    "": ("", ""),
}


def test_normalize_and_strip(spark):
    assert values(spark, "string", list(NAMES), names.normalize_name) == [n for n, _ in NAMES.values()]
    assert values(spark, "string", list(NAMES), lambda c: names.strip_legal_suffix(names.normalize_name(c))) == [c for _, c in NAMES.values()]
    assert values(spark, "string", [None], names.normalize_name) == [""]


def test_fund_numbers_agree_in_both_scripts(spark):
    cores = ["abc fund ii", "abc fund 2", "abc fund xx", "abc fund xxi", "abc 1234", "abc 007", "vi", "", "abc fund"]
    assert values(spark, "string", cores, names.fund_number) == [2, 2, 20, None, None, 7, 6, None, None]


def test_aggressive_core(spark):
    assert values(spark, "string", ["alpha master fund iii", "alpha feeder fund iii", "alpha fund", "offshore"], names.aggressive_core) == ["alpha fund", "alpha fund", "alpha fund", ""]


def slow_brand(name_norm: str) -> str:
    """The rule step by step."""
    def strip(words):
        while words and words[-1] in names.LEGAL_SUFFIXES:
            words = words[:-1]
        return words

    tail = {*names.BUSINESS_WORDS, *names.PLACE_WORDS}
    words = strip(name_norm.split())
    while len(words) > 1 and words[-1] in tail:
        words = words[:-1]
        words = strip(words) or words
    return " ".join(words)


def test_brand_core_equals_the_rule_step_by_step(spark):
    rnd = random.Random(1)
    pool = ["co", "ltd", "lp", "capital", "group", "uk", "hong", "kong", "point72", "rock", "north", "pte"]
    cases = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 7))) for _ in range(600)] + ["point72 hong kong limited", "point72 sg pte ltd", "capital group", "asset management inc"]
    assert values(spark, "string", cases, names.brand_core) == [slow_brand(c) for c in cases]


def test_brand_tiers(spark):
    cores = ["point72", "point72 credit", "point720", "", "north park rock"]
    assert values(spark, "string", cores, lambda c: names.brand_tier(F.lit("point72"), c)) == ["high", "possible", None, None, None]


def slow_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    da, db = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not da or not db):
        return 1.0
    row = [0] * (len(db) + 1)
    for c in da:
        new = [0]
        for j, d in enumerate(db):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    s, sep = len(both), int(bool(both))
    total = 2 * (s + sep) + len(da) + len(db)
    best = 1 - (len(da) + len(db) - 2 * row[-1]) / total
    if s:
        best = max(best, 1 - (sep + len(da)) / (2 * s + sep + len(da)), 1 - (sep + len(db)) / (2 * s + sep + len(db)))
    return best


def test_token_set_ratio_equals_the_definition(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 5)))
    pairs = [(" ".join(word() for _ in range(rnd.randint(0, 4))), " ".join(word() for _ in range(rnd.randint(0, 4)))) for _ in range(300)]
    pairs += [("north rock capital", "north moor capital ltd"), ("north rock capital", "north rock capital management uk llp")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.select("i", token_set_ratio("a", "b").alias("r")).orderBy("i").select("r").collect()]
    assert got == pytest.approx([slow_ratio(*p) for p in pairs])
    assert got[-2] == pytest.approx(0.8387, abs=1e-4) and got[-1] == 1.0


def test_token_set_ratio_of_long_names(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdé𝒳") for _ in range(rnd.randint(1, 9)))
    pairs = [(" ".join(word() for _ in range(m)), " ".join(word() for _ in range(n))) for m in (8, 20, 50) for n in (9, 22, 40)]
    pairs += [("a" * m, "a" * n + "b") for m in (59, 60, 61, 120, 121) for n in (59, 60, 61, 119, 121)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.select("i", token_set_ratio("a", "b").alias("r")).orderBy("i").select("r").collect()]
    assert got == pytest.approx([slow_ratio(*p) for p in pairs])


def test_token_set_ratio_copies_no_rows_of_the_table(spark):
    """A row of the table was copied for each of its cells, so the time grew with the cube of the lengths."""
    a, b = "ab" * 1250, "ba" * 1250
    df = spark.createDataFrame([(a, b)], "a string, b string")
    began = time.perf_counter()
    assert df.select(token_set_ratio("a", "b")).first()[0] == pytest.approx(1 - 2 / 5000)
    assert time.perf_counter() - began < 40


@given(st.lists(st.tuples(st.text("ab ", max_size=8), st.text("ab ", max_size=8)), min_size=1, max_size=20))
@settings(max_examples=5, deadline=None)
def test_token_set_ratio_is_symmetric(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(F.abs(token_set_ratio("a", "b") - token_set_ratio("b", "a")) > 1e-9).count() == 0


def test_places(spark):
    assert values(spark, "string", ["ec2n 4ag", None, " - "], places.normalize_postcode) == ["EC2N4AG", None, None]
    assert values(spark, "string", ["EC2N4AG", "12345", None], places.postcode_outward) == ["EC2N", None, None]
    assert values(spark, "string", ["uk", "GB-ENG", "United Kingdom", "xx", " ", None], places.country_of_jurisdiction) == ["GB", "GB", "GB", "XX", None, None]
    assert values(spark, "string", ["NY", "x0", None], places.filer_country) == ["US", "X0", None]
    assert values(spark, "string", ["000123", "0", None], places.pad_cik_or_null) == ["0000000123", None, None]
    assert values(spark, "string", ["000000000", "12ab", ""], places.clean_cusip) == [None, "12AB", None]
    line = lambda c: places.address_line(c, F.lit("Paris"), parse=lambda t: {"city": "paris", "road": "x"})
    assert values(spark, "string", ["1 Rue"], line) == ["x paris"]


def test_dates_and_numbers(spark):
    assert [str(x) for x in values(spark, "string", ["07-FEB-2024", "7-FEB-2024", "bad", None], columns.filing_date)] == ["2024-02-07", "2024-02-07", "None", "None"]
    assert str(values(spark, "string", ["07-FEB-2024"], columns.any_date)[0]) == "2024-02-07" == str(values(spark, "string", ["2024-02-07"], columns.any_date)[0])
    assert values(spark, "string", ["2/7/2024", "soon"], columns.us_date) == ["2024-02-07", "soon"]
    assert values(spark, "string", ["20240207", "99991231", "0"], columns.compact_date) == ["2024-02-07", None, None]
    assert values(spark, "string", ["12.7", "x", "-2.5", "12", None], columns.as_bigint) == [13, None, -3, 12, None]
    assert values(spark, "double", [100.0, 0.0001, 1e7, 2.5, None], columns.double_text) == ["100.0", "0.0001", "10000000.0", "2.5", None]


def test_formulas(spark):
    df = spark.createDataFrame([(1.0, 4.0), (1.0, 0.0), (None, 1.0)], "a double, b double")
    rows = df.select(formulas.ratio("a", "b"), formulas.percent_of("a", "b"), formulas.percent_change("a", "b"), formulas.sum_of("a", "b")).collect()
    assert [tuple(r) for r in rows] == [(0.25, 25.0, -75.0, 5.0), (None, None, None, 1.0), (None, None, None, None)]
    assert df.select(formulas.balances(F.lit(100.0), F.lit(100.4))).first()[0] and not df.select(formulas.balances(F.lit(100.0), F.lit(101.0))).first()[0]


def test_latest_value_skips_nulls_and_lists_keep_order(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, None, 3), (1, "b", 2), (1, "c", None)], "k int, v string, d int")
    assert df.groupBy("k").agg(columns.latest_value("v", "d").alias("v")).first()["v"] == "b"
    got = df.groupBy("k").agg(columns.nested_list(columns.descending("d"), F.struct("v", "d")).alias("l")).first()["l"]
    assert [x["d"] for x in got] == [3, 2, 1, None]


def test_every_state_is_in_the_united_states(spark):
    codes = [*places.US_STATES, "England", " pr ", None]
    rows = spark.createDataFrame([(c,) for c in codes], "c string").select(places.filer_country("c").alias("x")).collect()
    assert len(places.US_STATES) == 52 and [r["x"] for r in rows] == ["US"] * 52 + ["ENGLAND", "US", None]
