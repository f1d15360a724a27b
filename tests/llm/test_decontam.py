from __future__ import annotations

import collections

import regex as re

from kinfold.llm import decontam as D

Q = "Anna buys 12 apples for 3.50 dollars each and gives Bruno 12 of the apples, how many apples does Anna have after 7 days"
ITEMS = [(1, Q), (2, "one two"), (3, None), (4, "the cat sat on the mat and looked at the dog for a very long time"), (4, "the cat sat on the mat and looked at the dog for a very long time"), (5, "seven words are here to be found")]
DOCS = [
    (1, "foo bar baz. " + Q.replace("12", "99").replace("Bruno", "Carla").replace("Anna", "Zoe") + " bar."), (2, Q.replace("gives Bruno 12", "gives Bruno 55")), (3, None), (4, ""), (5, Q), (5, Q), (None, Q), (6, "a b c d"),
    (7, "Well, The cat sat on the mat, and looked at the dog for a very long time indeed"), (8, "the cat sat on the mat and went away"), (9, Q.lower()), (10, ("x " * 3000) + Q + (" y" * 3000)), (11, "\x01\x05 \x02x\x05 seven words are here to be found"), (12, "so Seven words are here to be found, 5 km"),
]


def tokens(text):
    text = re.sub("[\x01\x02\x03\x05]", "", text or "")
    text = re.sub(D.NAME, lambda m: "\x02" + m[0] + "\x05", text)
    text = re.sub(D.NUMBER, lambda m: "\x01" + m[0] + "\x05", text)
    text = re.sub(D.UNIT.replace("(?i)", ""), lambda m: "\x03" + m[0] + "\x05", text, flags=re.I)
    raw = re.sub(r"[^\p{L}\p{N}\s\x01-\x05]+", "", text.lower()).split()
    return raw, [re.sub("([\x01-\x03])[^\x05]*\x05", r"\1", x) for x in raw]


def windows(text, skip=False):
    raw, plain = tokens(text)
    out = {}
    for i in range(1 if skip and len(plain) > 5 else 0, len(plain) - 4):
        w = tuple(plain[i : i + 5])
        if sum(not re.search("[\x01-\x03]", x) for x in w) >= 2:
            out.setdefault(w, [s for x in raw[i : i + 5] for s in re.findall("[\x01-\x03][^\x05]*", x)])
    return out


def brute(docs, items):
    out = collections.defaultdict(set)
    for d, text in docs:
        have = windows(text)
        for i, item in items:
            want = windows(item, True)
            common = want.keys() & have.keys()
            votes = collections.Counter((a, b) for w in common for a, b in zip(want[w], have[w], strict=True))
            choice = {}
            for (a, b), n in votes.items():
                if a not in choice or n > votes[a, choice[a]]:
                    choice[a] = b
            good = [w for w in common if all(choice[a] == b for a, b in zip(want[w], have[w], strict=True))]
            if want and len(good) >= 0.8 * len(want) - 1e-9:
                out[d].add((i, all(want[w] == have[w] for w in good)))
    return out


def test_equals_brute_force(spark, clash):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = D.mark_contaminated(clash(docs), clash(items)).collect()
    expected = brute(DOCS, ITEMS)
    assert len(rows) == len(DOCS)
    for r in rows:
        assert {(x["item"], x["same"]) for x in r["items"]} == expected[r["doc_id"]], r["doc_id"]
    held = {r["doc_id"]: [(x["item"], x["same"]) for x in r["items"]] for r in rows}
    assert held[1] == [(1, False)] and held[5] == [(1, True)] == held[None] == held[10] and held[7] == [(4, True)] and held[8] == []


def test_shuffled_windows_and_empty_tables(spark, monkeypatch):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    a = sorted((repr(r) for r in D.mark_contaminated(docs, items).collect()))
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert sorted(repr(r) for r in D.mark_contaminated(docs, items).collect()) == a
    assert D.mark_contaminated(docs.limit(0), items).count() == 0
    assert all(r["items"] == [] for r in D.mark_contaminated(docs, items.limit(0)).collect())


def test_plan_is_native(spark):
    df = D.mark_contaminated(spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "MapInArrow", "Cartesian", "NestedLoop"))


SHOP = "a baker fills 20 trays with rolls every morning and sells 15 of them before noon while Clara bakes 20 more every day, how many trays are left after 6 days"
OTHER = SHOP.replace("20", "30").replace("Clara", "Petra").replace("15", "40")


def test_item_after_parts_and_variants_of_it(spark):
    third = SHOP.replace("20", "77").replace("15", "11").replace("Clara", "Olga")
    opening = OTHER[: OTHER.index(" before noon")]
    docs = [(1, f"{opening}. {SHOP}"), (2, f"{OTHER}. {SHOP}. {third}"), (3, f"{opening}. {third}"), (4, f"{opening}. {opening}. {opening}"), (5, " ".join([OTHER, opening, third, opening] * 5 + [SHOP])), (6, SHOP.replace("20 more", "21 more").replace("20 trays", "22 trays") + ". " + opening), (7, f"{opening}, {SHOP.replace('while', 'while on the other hand')}")]
    rows = D.mark_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, SHOP)], "item_id long, text string")).collect()
    held = {r["doc_id"]: [(x["share"], x["same"]) for x in r["items"]] for r in rows}
    assert held[1] == held[2] == held[5] == [(1.0, True)] and held[3] == [(1.0, False)] and held[4] == []
    assert [x[1] for x in held[7]] == [True]


def test_items_without_template_are_matched_as_a_whole(spark):
    items = [(1, "What is 12 + 7?"), (2, "3 4 5 6 7 8 9 10"), (3, "Say Anna, Bruno, Clara, Doris, Emil, Franz"), (4, "小明有三个苹果"), (5, "one two"), (6, "!!"), (7, None), (None, "so so")]
    docs = [(1, "Quiz: what is 12 +  7? Nineteen"), (2, "What is 12 - 7? What is 13 + 7? What is 12 + 75?"), (3, "1 2 3 4 5 6 7 8 9 10 11"), (4, "3 4 5 6 7 8 9 11"), (5, "Then say Anna, Bruno, Clara, Doris, Emil, Franz!"), (6, "题目：小明有三个苹果。"), (7, "小明有四个苹果"), (8, "someone two, one twofold"), (9, "One\ntwo"), (10, None), (None, "one two"), (11, "so, so")]
    rows = D.mark_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    held = {r["doc_id"]: [(x["item"], x["share"], x["same"]) for x in r["items"]] for r in rows}
    expected = {1: 1, 3: 2, 5: 3, 6: 4, 9: 5, None: 5, 11: None}
    assert held == {d: [(expected[d], 1.0, True)] if d in expected else [] for d, _ in docs}
