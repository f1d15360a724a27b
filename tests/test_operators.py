from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinfold.catalog import Catalog
from kinfold.config import Matching
from kinfold.operators import entities, evaluation, family, filings, gates, graph, hierarchy, matching, reads, relational, serving
from kinfold.operators.publication import PublicationError, Publisher

P = {"source_file": "f", "snapshot_date": "2024-01-01", "ingested_at": "t"}


def frame(spark, rows, schema, provenance=False):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({k: F.lit(v) for k, v in P.items()}) if provenance else df


# --- relational ---


def test_dedupe_is_idempotent_and_puts_nulls_last(spark):
    df = frame(spark, [(1, None, "a"), (1, "2024", "b"), (2, None, "c"), (2, None, "d")], "k int, snapshot_date string, v string")
    once = relational.dedupe_latest(df, ["k"], ties=["v"])
    assert sorted(map(tuple, once.collect())) == [(1, "2024", "b"), (2, None, "c")]
    assert sorted(map(tuple, relational.dedupe_latest(once, ["k"], ties=["v"]).collect())) == sorted(map(tuple, once.collect()))


def test_find(spark):
    df = frame(spark, [(1, ["A"], None, 5), (2, ["B"], "x", None), (3, ["A", "B"], None, 7), (3, ["A"], None, 9)], "k int, tags array<string>, note string, n int")
    got = relational.find(df, where={"tags": "A"}, missing=["note"], sort=[("n", "desc")], collapse="k", fields=["k", "n"]).collect()
    assert [tuple(r) for r in got] == [(3, 9), (1, 5)]
    assert relational.find(df, either=[{"k": [1, 2]}, {"n": 9}], sort=[("n", "asc")], size=2, offset=1).select("k").collect()[0][0] == 3


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 5)
    a = relational.sample_per_group(df, "g", "id", 10, 1)
    b = relational.sample_per_group(df.repartition(17), "g", "id", 10, 1)
    assert sorted(r["id"] for r in a.collect()) == sorted(r["id"] for r in b.collect())


# --- matching ---

REGISTER = "lei string, legal_name string, jurisdiction string, legal_country string, legal_postcode string, legal_city string, registration_id string"


def make_register(spark, rows):
    from kinfold.functions import names

    df = frame(spark, [(*r, *[None] * (7 - len(r))) for r in rows], REGISTER)
    return df.withColumns(names.name_fields("legal_name")).withColumn("aliases_norm", F.array().cast("array<string>"))


def ask(spark, rows):
    df = frame(spark, rows, "query_id string, name string, country string, postcode string, city string, registration_id string")
    return matching.build_queries(df, "name", "country", "postcode", "city", "registration_id")


def test_features_and_conflicts(spark):
    register = make_register(spark, [("L1", "Alpha Fund III LP", "GB-ENG", "GB", "EC2N4AG", "london", "R1")])
    asked = ask(spark, [("q", "Alpha Fund II LP", "UK", "EC2N 4AG", " London ", "R2")])
    row = matching.score(asked.crossJoin(register)).first()
    assert row["fund_number_conflict"] and row["registration_id_conflict"] and not row["name_exact"]
    assert row["country_exact"] and row["jurisdiction_exact"] is False and row["postcode_exact"] and row["postcode_prefix_exact"] and row["city_exact"]
    assert row["registration_id_exact"] is False and not row["master_conflict"]
    assert row["score"] == pytest.approx(sum(row["evidence"].values()), abs=0.02)


def test_missing_inputs_give_no_signal(spark):
    register = make_register(spark, [("L1", "Alpha Master Fund")])
    row = matching.score(ask(spark, [("q", "Alpha Fund", None, None, None, None)]).crossJoin(register)).first()
    assert all(row[c] is None for c in ("country_exact", "jurisdiction_exact", "postcode_exact", "postcode_prefix_exact", "city_exact", "registration_id_exact", "fund_number_exact"))
    assert not row["master_conflict"]  # the query claims nothing
    row = matching.score(ask(spark, [("q", "Alpha Feeder Fund", None, None, None, None)]).crossJoin(register)).first()
    assert row["master_conflict"] and row["feeder_conflict"]


def decided(spark, scores, flags=None, claim=False):
    flags = flags or [(False, False)] * len(scores)
    rows = [("q", f"L{i}", i, float(s), m, f, claim, False, None, None, None, {"x": float(s)}) for i, (s, (m, f)) in enumerate(zip(scores, flags, strict=True))]
    df = frame(spark, rows, "query_id string, lei string, retrieval_rank int, score double, is_master boolean, is_feeder boolean, q_is_master boolean, q_is_feeder boolean, q_country string, q_postcode string, q_registration_id string, evidence map<string,double>")
    return matching.decide(df).first()


@pytest.mark.parametrize(("scores", "decision"), [([150], "AUTO_MATCH"), ([150, 120], "AUTO_MATCH"), ([150, 121], "REVIEW"), ([139], "REVIEW"), ([90], "REVIEW"), ([89], "UNMATCHED")])
def test_decisions(spark, scores, decision):
    row = decided(spark, scores)
    assert row["decision"] == decision and (row["lei"] is None) == (decision == "UNMATCHED")
    assert row["gap"] == (scores[0] - scores[1] if len(scores) > 1 else None)


def test_ties_and_structure_guard(spark):
    row = decided(spark, [100, 98, 96, 80])
    assert row["decision"] == "REVIEW" and row["n_competing"] == 3 and "3 candidates" in row["reason"] and row["missing_evidence"] == ["country", "postcode", "registration identifier"]
    assert decided(spark, [200, 100], [(True, False), (False, True)])["decision"] == "REVIEW"
    assert decided(spark, [200, 100], [(True, False), (False, True)], claim=True)["decision"] == "AUTO_MATCH"


def test_match_batch(spark):
    register = make_register(spark, [(f"L{i}", n, "GB", "GB") for i, n in enumerate(["North Rock Capital LLP", "North Moor Capital Ltd", "Alpha Fund II", "Alpha Fund III", "Beta Holdings"])])
    out = {r["query_id"]: r for r in matching.match_batch(ask(spark, [("a", "north rock capital llp", "UK", None, None, None), ("b", "Alpha Fund III", "GB", None, None, None), ("c", "Zeta", None, None, None, None), ("d", "betaholdings", None, None, None, None)]), register).collect()}
    assert out["a"]["decision"] == "AUTO_MATCH" and out["a"]["lei"] == "L0"
    assert out["b"]["lei"] == "L3" and out["c"]["decision"] == "UNMATCHED"
    with pytest.raises(ValueError, match="country_mode"):
        matching.search(ask(spark, []), register, register, country_mode="odd")


def test_common_words_count_in_retrieval(spark):
    names = ["Oak Elm Trust", "Oak Elm Harbour", *[f"Harbour Word{i}" for i in range(30)], *[f"Trust Name{i}" for i in range(30)]]
    register = make_register(spark, [(f"L{i:02}", n) for i, n in enumerate(names)])
    asked = ask(spark, [("q", "Harbour Elm Oak", None, None, None, None)])
    found = {r["lei"]: (r["retrieval_rank"], r["retrieval_score"]) for r in matching.search(asked, register, matching.build_index(register), 40).collect()}
    weights = {r["lei"]: r["w"] for r in matching.build_index(register).where("token IN ('harbour', 'elm', 'oak')").groupBy("lei").agg(F.sum("weight").alias("w")).collect()}
    assert found["L01"][0] == 1 and found["L00"][0] == 2
    assert {k: v[1] for k, v in found.items()} == pytest.approx(weights)


def test_copies_of_names_are_searched_once(spark):
    """Each copy of a name had postings of its own, and each query made a row for each of them."""
    some = ["Oak Elm Trust", "Oak Harbour Ltd", "Elm Harbour Trust Ltd", "Birch"]
    copies = [(f"L{i:03}", some[i % 4], None, ["GB", "KY", None][i % 3]) for i in range(240)]
    register = make_register(spark, copies)
    index = matching.build_index(register)
    assert index.count() == matching.build_index(make_register(spark, copies[:4])).count()
    asked = [(f"q{i}", ["oak elm", "Harbour Ltd", "oakelmtrust", "zeta"][i % 4], ["GB", None, "KY"][i % 3], None, None, None) for i in range(24)]
    weights = {}
    for r in index.collect():
        weights.setdefault(r["lei"], []).append((r["token"], r["weight"]))
    for mode in ("soft", "strict"):
        got = {}
        for r in matching.search(ask(spark, asked), register, index, 13, mode).collect():
            got.setdefault(r["query_id"], {})[r["retrieval_rank"]] = (r["lei"], r["retrieval_score"], r["legal_name"])
        for key, name, country, *_ in asked:
            scores = []
            for i, (lei, found, _, where) in enumerate(copies):
                hit = sum(w for t, w in weights[copies[i % 4][0]] if t in name.lower().split())
                hit += 4 * (name.lower().replace(" ", "") == found.lower().replace(" ", ""))
                if not hit or mode == "strict" and country and where != country:
                    continue
                scores.append((-round(hit if mode == "strict" or not country else hit + 8 if where == country else hit * 0.3, 9), lei, found))
            best = [(lei, pytest.approx(-score), found) for score, lei, found in sorted(scores)[:13]]
            assert [x for _, x in sorted(got.get(key, {}).items())] == best


def most_rows(plan):
    """The most rows that a join or aggregate of an executed plan put out."""
    name, metric = plan.nodeName(), plan.metrics().get("numOutputRows")
    kids = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = metric.get().value() if metric.isDefined() and ("Join" in name or "Aggregate" in name) else 0
    return max([own, *map(most_rows, kids)])


@pytest.mark.parametrize("mode", ["soft", "strict"])
def test_names_alike_in_common_words_are_compared_once(spark, mode):
    """Where all names differ, each query was joined to every name that shares a word with it."""
    rows = [(f"L{i:03}", ["Oak Elm Trust w{}", "Oak Harbour w{} Ltd", "Elm Trust w{}"][i % 3].format(i // 2 if i > 380 else i), None, ["GB", "KY", None][i % 4 % 3]) for i in range(400)]
    register = make_register(spark, rows)
    asked = [(f"q{i}", f"{['Oak Elm', 'Harbour Oak Ltd', 'Elm', 'Birch'][i % 4]} w{i * 9}", ["GB", None, "KY"][i % 3], None, None, None) for i in range(44)]
    asked += [("exact", "oakelmtrustw3", None, None, None, None), ("rare", "w385 w7 w192", "KY", None, None, None)]
    index = matching.build_index(register)
    found = matching.search(ask(spark, asked), register, index, 7, mode)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["retrieval_rank"]] = (r["lei"], r["retrieval_score"])
    weights = {}
    for r in index.collect():
        weights.setdefault(r["lei"], []).append((r["token"], r["weight"]))
    same = {r["legal_name_norm"]: r["lei"] for r in register.orderBy(F.col("lei").desc()).collect()}
    for key, name, country, *_ in asked:
        scores = []
        for lei, raw, _, where in rows:
            hit = sum(w for t, w in weights[same[raw.lower()]] if t in name.lower().split()) + 4 * (name.lower().replace(" ", "") == raw.lower().replace(" ", ""))
            if hit and not (mode == "strict" and country and where != country):
                scores.append((-round(hit if mode == "strict" or not country else hit + 8 if where == country else hit * 0.3, 9), lei))
        assert [x for _, x in sorted(got.get(key, {}).items())] == [(lei, pytest.approx(-score)) for score, lei in sorted(scores)[:7]]
    assert most_rows(found._jdf.queryExecution().executedPlan()) < 2_000  # 14,524 when each query met each name that shares a word


@pytest.mark.parametrize("mode", ["soft", "strict"])
def test_names_without_the_heaviest_words_are_not_scored(spark, mode, monkeypatch):
    """Where names differ in their common words, each query was joined to every name that shares one of them."""
    monkeypatch.setattr(matching, "COMMON", 10)
    rows = [(f"L{i:04}", f"a{i % 8} b{i // 8 % 5} c{i // 40 % 4} d{i // 160 % 3} oak", None, ["GB", "KY", None][i % 7 % 3]) for i in range(960)]
    register = make_register(spark, rows)
    asked = [(f"q{i}", f"d{i % 3} c{i % 4} b{i * 3 % 5} a{i * 5 % 8}", ["GB", None, "KY", "FR"][i % 4], None, None, None) for i in range(40)] + [("few", "b1 d1 oak", "KY", None, None, None), ("one", "oak", None, None, None, None)]
    index = matching.build_index(register)
    found = matching.search(ask(spark, asked), register, index, 5, mode)
    got, weights = {}, {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["retrieval_rank"]] = (r["lei"], r["retrieval_score"])
    for r in index.collect():
        weights.setdefault(r["lei"], []).append((r["token"], r["weight"]))
    same = {r[1]: r[0] for r in reversed(rows)}
    for key, name, country, *_ in asked:
        scores = []
        for lei, raw, _, where in rows:
            hit = sum(w for t, w in weights[same[raw]] if t in name.split())
            if hit and not (mode == "strict" and country and where != country):
                scores.append((-round(hit if mode == "strict" or not country else hit + 8 if where == country else hit * 0.3, 9), lei))
        assert [x for _, x in sorted(got.get(key, {}).items())] == [(lei, pytest.approx(-score)) for score, lei in sorted(scores)[:5]]
    assert most_rows(found._jdf.queryExecution().executedPlan()) < 5_000  # 19,239 when each query met each name that shares a word


def test_match_features_where_names_differ(spark, sf_dir, tmp_path, monkeypatch):
    """Each query met every name that shares a word with it; the result is that of the SQL."""
    from kinfold.plans.queries import ORACLES, QUERIES

    from .oracle import TABLES, duck_rows, spark_rows

    for t in TABLES:
        if t != "part":
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").limit(1)
    part = spark.range(600).crossJoin(part).selectExpr("id AS p_partkey", "concat('old ring n', id) AS p_name", *[c for c in part.columns if c not in ("p_partkey", "p_name")])
    part.coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "part.parquet")
    pairs, score = [], matching.score
    monkeypatch.setattr(matching, "score", lambda found, *more: pairs.append(found) or score(found, *more))
    got = spark_rows(QUERIES["match_features"](spark, str(tmp_path)))
    assert got == duck_rows(ORACLES["match_features"], str(tmp_path)) and len(got[1]) == 150
    assert pairs[0].count() == 150
    pairs[0].collect()
    assert most_rows(pairs[0]._jdf.queryExecution().executedPlan()) < 4_000  # each of 30 queries met each of 600 names


def test_register_is_not_broadcast(spark, sf_dir):
    """Its file is small beside the names made from it, which filled the driver."""
    from kinfold.plans.base import register as of

    asked = ask(spark, [("q", "hot bolt", "GB", None, None, None)])
    register = of(spark, sf_dir)
    plan = matching.search(asked, register, matching.build_index(register))._jdf.queryExecution().executedPlan().toString()
    last = next(line for line in plan.splitlines() if "Join" in line)
    assert "SortMergeJoin" in last and "lei" in last


def test_fingerprint_follows_every_value():
    from dataclasses import replace

    a = Matching()
    assert len(a.fingerprint()) == 12 and a.fingerprint() == Matching().fingerprint() != replace(a, candidate_pool_size=21).fingerprint()


def test_family(spark):
    register = make_register(spark, [("A", "Point72 Hong Kong Limited", "HK", "HK"), ("B", "Point72 Credit LP", "US", "US"), ("C", "Point72 Fund II", "KY", "KY"), ("D", "North Park Rock", "GB", "GB")])
    links = frame(spark, [("A", "B", "IS_SUBFUND_OF", "ACTIVE"), ("C", "D", "IS_SUBFUND_OF", "ACTIVE"), ("A", "C", "X", "INACTIVE")], "start_node_id string, end_node_id string, relationship_type string, relationship_status string")
    got = {r["lei"]: (r["tier"], r["role"], r["graph_confirmed"]) for r in family.discover_family(frame(spark, [("q", "Point72")], "query_id string, name string"), register, links).collect()}
    assert got == {"A": ("high", "management", True), "B": ("possible", "management", True), "C": ("possible", "fund", False)}


# --- hierarchy ---


def test_hierarchy(spark):
    rel = "start_node_id string, end_node_id string, relationship_type string, relationship_status string"
    links = frame(spark, [("a", "b", "IS_DIRECTLY_CONSOLIDATED_BY", "ACTIVE"), ("b", "c", "IS_DIRECTLY_CONSOLIDATED_BY", "ACTIVE"), ("c", "a", "ODD", "ACTIVE"), ("d", "a", "IS_SUBFUND_OF", "INACTIVE")], rel)
    names = frame(spark, [(x, x.upper()) for x in "abcd"], "entity_id string, canonical_name string")
    tree = hierarchy.hierarchy_tree(links, names, "a", depth=1)
    assert [(n.lei, n.name, n.label, n.expanded) for n in tree.up] == [("b", "B", "Direct parent", False)] and [n.lei for n in tree.down] == ["c"]
    deep = hierarchy.hierarchy_tree(links, names, "a", depth=3, direction="parents")
    assert deep.up[0].up[0].lei == "c" and not deep.down and deep.up[0].up[0].up[0].lei == "a" and not deep.up[0].up[0].up[0].expanded
    small = hierarchy.hierarchy_tree(links, names, "a", depth=3, max_nodes=1)
    assert small.expanded and not any(n.expanded for n in [*small.up, *small.down])
    kin = frame(spark, [("r", "p", "IS_DIRECTLY_CONSOLIDATED_BY", "ACTIVE"), ("s", "p", "IS_DIRECTLY_CONSOLIDATED_BY", "ACTIVE"), ("p", "g", "IS_DIRECTLY_CONSOLIDATED_BY", None), *[(f"k{i:02}", "r", "IS_FUND-MANAGED_BY", "ACTIVE") for i in range(40)]], rel)
    silent = frame(spark, [("p", "ULTIMATE_ACCOUNTING_CONSOLIDATION_PARENT", "NO_LEI")], "lei string, exception_category string, exception_reason string")
    wide = hierarchy.hierarchy_tree(kin, names, "r", depth=2, exceptions=silent)
    parent = wide.up[0]
    assert parent.expanded and (parent.relationship_type, parent.status) == ("IS_DIRECTLY_CONSOLIDATED_BY", "ACTIVE") and parent.exceptions == [{"label": "Ultimate parent", "reason": "parent has no LEI"}]
    assert [(n.lei, n.expanded) for n in parent.down] == [("r", False), ("s", True)] and [n.lei for n in parent.up] == ["g"] and len(wide.down) == 40 and all(n.expanded for n in wide.down)
    tight = hierarchy.hierarchy_tree(kin, names, "r", depth=2, max_nodes=5)  # parents come first
    assert tight.up[0].expanded and sum(n.expanded for n in tight.down) == 2
    far = hierarchy.hierarchy_tree(kin, names, "r", depth=1, extra_parent_depth=1)
    assert far.up[0].expanded and far.up[0].up[0].lei == "g" and not far.up[0].up[0].expanded and not any(n.expanded for n in far.down)
    edges = links.selectExpr("start_node_id AS a", "end_node_id AS b")
    got = {(r["node"], r["hops"]) for r in hierarchy.reachable(edges, frame(spark, [("a",)], "node string"), 5).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}
    exceptions = frame(spark, [("a", "DIRECT_ACCOUNTING_CONSOLIDATION_PARENT", "NO_LEI"), ("a", "ULTIMATE_ACCOUNTING_CONSOLIDATION_PARENT", "NO_LEI"), ("d", "DIRECT_ACCOUNTING_CONSOLIDATION_PARENT", "ODD")], "lei string, exception_category string, exception_reason string")
    left = {(r["lei"], r["label"], r["reason_text"]) for r in hierarchy.open_exceptions(exceptions, links).collect()}
    assert left == {("a", "Ultimate parent", "parent has no LEI"), ("d", "Direct parent", "ODD")}


# --- filings ---


def test_amendments_and_reconciliation(spark):
    f = frame(spark, [("A1", "14-FEB-2024", "c1", "31-DEC-2023", False, None), ("A2", "20-FEB-2024", "c1", "31-DEC-2023", True, "new holdings "), ("A3", "01-FEB-2024", "c1", "31-DEC-2023", True, "NEW HOLDINGS"), ("A4", "31-DEC-2022", "c2", "30-SEP-2022", True, "RESTATEMENT"), ("A5", "bad", "c3", "p", True, "odd"), ("A6", "01-FEB-2024", "c4", "p", False, None)], "accession_number string, filing_date string, cik string, period_of_report string, is_amendment boolean, amendment_type string")
    h = frame(spark, [(a, str(i), v, "X", 1.0, "SH", None) for i, (a, v) in enumerate([("A1", 5), ("A1", 7), ("A2", 1), ("A3", 2), ("A4", 3), ("A6", 4)])], "accession_number string, infotable_sk string, value long, cusip string, shares_or_principal_amount double, shares_or_principal_type string, put_call string")
    s = frame(spark, [("A1", 2, 12), ("A2", 1, 1), ("A3", 1, 2), ("A4", 1, 3), ("A5", 0, 1)], "accession_number string, declared_entry_total long, declared_value_total long")
    checked = filings.validate(f, s, h)
    errors = {r["accession_number"]: r["errors"] for r in checked.collect()}
    assert errors == {"A1": [], "A2": [], "A3": [], "A4": [], "A5": ["TABLE_VALUE_TOTAL_MISMATCH", "UNKNOWN_AMENDMENT_TYPE", "UNPARSEABLE_FILING_DATE"]}
    assert filings.quarantine(checked).count() == 1
    got = sorted((r["accession_number"], r["value_usd"]) for r in filings.effective_holdings(f, h, checked).collect())
    assert got == [("A1", 5), ("A1", 7), ("A2", 1), ("A4", 3000)]  # A3 came before the anchor, A6 has no summary


def test_scale_check(spark):
    rows = [(f"A{i}", f"c{i}", "p", f"S{j}", "USD", None, "SH", 10.0, (1 if i == 0 else 1000) * (j + 1)) for i in range(6) for j in range(5)]
    e = frame(spark, rows, "accession_number string, cik string, period_of_report string, cusip string, value_unit string, put_call string, shares_or_principal_type string, shares_or_principal_amount double, value_usd int")
    got = {r["accession_number"]: r["looks_like_thousands"] for r in filings.scale_checks(e).collect()}
    assert got["A0"] and not any(v for k, v in got.items() if k != "A0")


# --- graph and documents ---


def test_rejected_and_confirmed_reviews_change_the_graph(spark):
    cross = frame(spark, [("0001", "L1", "AUTO_MATCH", 150.0, 100.0, '{"name_exact":100.0}', "h"), ("0002", "L2", "AUTO_MATCH", 150.0, None, None, "h"), ("0003", "L3", "REVIEW", 100.0, 1.0, None, "h")], "cik string, lei string, decision string, score double, gap double, feature_contributions string, config_hash string", True).withColumn("runner_up_lei", F.lit(None).cast("string"))
    reviews = frame(spark, [("cik:0001", "L1", "confirmed", "r", "2024-01-01", None, 2), ("cik:0001", "L1", "Rejected", "r", "2024-01-02", "why", 3), ("cik:0003", "L3", "CONFIRMED", "s", "2024-01-01", None, 4)], "node_id string, lei string, outcome string, reviewer string, reviewed_at string, rationale string, line_no int")
    out = graph.build_graph(Catalog(spark, tables={"crosswalk_sec_13f_gleif": cross, "match_reviews": reviews}))
    assert {(r["start_node_id"], r["end_node_id"], r["source"]) for r in out["edges"].collect()} == {("cik:0002", "lei:L2", "sec_13f_crosswalk"), ("cik:0003", "lei:L3", "human_review")}
    facts = {(r["subject_node_id"], r["predicate"]): r["value"] for r in out["facts"].collect()}
    assert facts["cik:0001", "match.feature.name_exact"] == "100.0" and facts["cik:0001", "match.score"] == "150.0" and ("cik:0002", "match.runner_up_gap") not in facts
    assert sum(k[1] == "review.outcome" for k in facts) >= 2
    ids = {r["locator"] for r in out["facts"].where("source = 'human_review'").collect()}
    assert "match_reviews.csv:line=3:review.rationale" in ids


def test_series_register_and_mappings(spark):
    series = frame(spark, [("1", "T", "S1", "Ser", "C1", "Cl", "TK")], "cik string, entity_name string, series_id string, series_name string, class_id string, class_name string, class_ticker string", True)
    figi = frame(spark, [("X", "F1", "SC", None, "US"), ("X", "F2", "SC", "CF", "LN"), ("Y", "F3", "SA", None, "US"), ("Y", "F4", "SB", None, "US"), ("Z", None, None, None, None)], "cusip string, figi string, share_class_figi string, composite_figi string, exchange_code string", True)
    figi = figi.withColumns({n: F.lit(n) for n in ("name", "security_type", "security_type_2", "market_sector")} | {"ticker": F.lit("t"), "error": F.lit(None).cast("string")})
    c = Catalog(spark, tables={"sec_series_classes": series, "openfigi_mappings": figi})
    out = graph.build_graph(c)
    assert {r["node_id"] for r in out["nodes"].collect()} == {"cik:1", "series:S1", "class:C1", "figi:SC", "figi:SA", "figi:SB"}
    assert {(r["start_node_id"], r["end_node_id"]) for r in out["edges"].collect()} == {("series:S1", "cik:1"), ("class:C1", "series:S1"), ("security:cusip:X", "figi:SC")}
    assert out["identifiers"].count() == 2 and "facts" not in out
    docs = {r["cusip"]: (r["status"], len(r["securities"]), r["figis"]) for r in serving.security_documents(c).collect()}
    assert docs == {"X": ("resolved", 1, ["SC", "CF"]), "Y": ("ambiguous", 2, ["SA", "SB"]), "Z": ("no_match", 0, [])}


def test_missing_tables_contribute_nothing(spark):
    empty = Catalog(spark)
    assert graph.build_graph(empty) == {} and entities.build_identifiers(empty) is None and all(b(empty) is None for b in serving.BUILDERS.values())


def test_source_urls(spark):
    df = frame(spark, [("sec_13dg", "0001-23-4:1", "cik:0000012"), ("sec_insiders", "0001-23-4", "cik:0000012"), ("nport", "x", "cik:1"), ("sec_13dg", None, "cik:1"), ("sec_13dg", "x", "lei:1")], "source string, source_record_ref string, end_node_id string")
    got = [r[0] for r in df.select(serving.source_url()).collect()]
    assert got == [serving.ARCHIVE + "12/0001234/primary_doc.xml", serving.ARCHIVE + "12/0001234/", None, None, None]


def test_nested_connections(spark):
    e = "start_node_id string, end_node_id string, edge_type string, source string, source_record_ref string, valid_from string, valid_to string"
    edges = frame(spark, [("cik:1", "lei:L", "SAME_AS", "x", "r", None, None)] + [(f"owner-cik:{i}", "cik:1", "INSIDER_OF", "sec_insiders", f"000-{i}", None, None) for i in range(30)], e)
    nodes = frame(spark, [("cik:1", "One", "LEGAL_ENTITY")], "node_id string, display_name string, node_type string")
    row = serving.connections(edges, nodes).first()
    assert row["entity_id"] == "L" and row["linked_records"][0]["display_name"] == "One" and row["groups"][0]["total"] == 30 and len(row["groups"][0]["connections"]) == 25


# --- reads, gates, metrics ---


def test_known_on_and_history(spark):
    obs = frame(spark, [("c", "Assets", "USD", None, "2023-12-31", "2024-02-01", 10.0, "a"), ("c", "Assets", "USD", None, "2023-12-31", "2024-05-01", 11.0, "b"), ("c", "Assets", "USD", None, "2024-03-31", "2024-05-01", 12.0, "b")], "cik string, tag string, unit string, period_start string, period_end string, filed string, value double, accession_number string")
    assert [r["value"] for r in reads.known_on(obs, "2024-03-01").collect()] == [10.0]
    assert sorted(r["value"] for r in reads.known_on(obs, "2024-06-01").collect()) == [11.0, 12.0]
    assert reads.series_change(reads.known_on(obs, "2024-06-01")).first()["percent_change"] == pytest.approx(9.09)
    with pytest.raises(ValueError, match="identifier"):
        reads.fund_structure(obs)


def test_gates_and_rendering(spark):
    assert gates.render_answer("It is {{f_0123456789abcdef}}.", {"f_0123456789abcdef": ("1234.5", "USD")}) == "It is $1,234.50."
    with pytest.raises(ValueError, match="without a fact"):
        gates.render_answer("It is 5.", {})
    with pytest.raises(ValueError, match="unknown"):
        gates.render_answer("{{f_0123456789abcdef}}", {})
    assert gates.fact_address("a", "b").startswith("f_") and len(gates.fact_address("a")) == 18


def test_categories_partition_and_rates(spark):
    rows = frame(spark, [("a", ["a", "b"], "AUTO_MATCH", "a"), ("b", ["a", "b"], "AUTO_MATCH", "a"), ("b", ["a", "b"], "REVIEW", "a"), ("a", ["a"], "REVIEW", "a"), ("z", ["a"], "UNMATCHED", None)], "expected string, ranked array<string>, decision string, chosen string")
    shares = {r["category"]: r["share"] for r in evaluation.failure_breakdown(rows).collect()}
    assert shares == dict.fromkeys(evaluation.CATEGORIES, 0.2)
    m = evaluation.metrics(rows, k=1).first()
    assert (m["recall"], m["top1"], m["mrr"], m["auto_precision"], m["dangerous_rate"]) == (0.4, 0.4, 0.6, 0.5, 0.2)
    assert evaluation.metrics(rows.where("decision <> 'AUTO_MATCH'")).first()["auto_precision"] is None


def test_benchmark_run(spark):
    register = make_register(spark, [(f"L{i}", n, "GB", "GB") for i, n in enumerate(["North Rock Capital LLP", "Alpha Beta Fund II", "Alpha Beta Fund III", "Gamma Holdings"])])
    pairs = frame(spark, [("p1", "North Rock Capital LLP", "GB", "L0", None, "isin_confirmed", "easy", None), ("p2", "alpha beta fund", "GB", "L1", "L2", "confusable_pair", "hard", "fund_number"), ("p3", "Omega", None, "L9", None, "isin_confirmed", "easy", None)], "pair_id string, query_name string, query_country string, expected_lei string, confusable_lei string, case_type string, difficulty string, conflict_type string")
    rows = {r["pair_id"]: r for r in evaluation.run_benchmark(pairs, register).collect()}
    assert rows["p1"]["decision"] == "AUTO_MATCH" and rows["p1"]["chosen"] == "L0" == rows["p1"]["ranked"][0]
    assert rows["p2"]["decision"] == "UNMATCHED" and set(rows["p2"]["ranked"]) == {"L1", "L2"} and rows["p3"]["ranked"] == []


# --- publication ---


def test_pointers_survive_crashes_and_races(spark, tmp_path):
    spark.range(3).toDF("id").write.parquet(f"file://{tmp_path}/in/t.parquet")
    c, p = Catalog(spark, f"file://{tmp_path}/in"), Publisher(spark, f"file://{tmp_path}/pub")
    first = p.publish(c, {"one": lambda c: c["t"]})
    assert set(p.manifest(first)["inputs"]) == {"t"}
    (tmp_path / "pub" / "current" / "0000000002.json").write_text('{"gener')  # a run that was killed while it switched
    assert p.current() == first
    second = p.publish(c, {"one": lambda c: c["t"]})
    assert p.current() == second and (tmp_path / "pub" / "current" / "0000000003.json").exists()

    def outrun(c):
        (tmp_path / "pub" / "current" / "0000000004.json").write_text((tmp_path / "pub" / "current" / "0000000003.json").read_text())
        return c["t"]

    with pytest.raises(PublicationError, match="exists"):
        p.publish(c, {"one": outrun})

    def change(c):
        rows = c["t"].limit(1)
        spark.range(9).toDF("id").write.mode("append").parquet(f"file://{tmp_path}/in/t.parquet")
        return rows

    with pytest.raises(PublicationError, match="inputs have changed"):
        p.publish(Catalog(spark, f"file://{tmp_path}/in"), {"zero": lambda c: c["t"], "one": change})
    assert p.current() == second and len([d for d in (tmp_path / "pub").iterdir() if d.is_dir() and d.name != "current"]) == 2


def test_generations(spark, tmp_path):
    tables = {"t": spark.range(3).toDF("id")}
    c, p = Catalog(spark, tables=tables), Publisher(spark, f"file://{tmp_path}/pub")
    build = {"one": lambda c: c["t"], "two": lambda c: c["t"].limit(1), "none": lambda c: None}
    first = p.publish(c, build)
    assert p.current() == first and p.read("one").count() == 3 and p.read("none") is None
    c.put("t", spark.range(5).selectExpr("id", "1 AS more"))
    second = p.publish(c, build, only=["one"])
    assert p.read("one").count() == 5 and p.read("two").count() == 1 and p.manifest(second)["partial"] and p.manifest(second)["indexes"]["one"]["schema_changed"]

    def broken(c):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError, match="no"):
        p.publish(c, {**build, "two": broken})
    assert p.current() == second and p.publish(c, build)
    p.rollback(first)
    assert p.current() == first and p.read("one").count() == 3
    with pytest.raises(PublicationError, match="no generation"):
        p.rollback("x")
    with pytest.raises(PublicationError, match="no such"):
        p.publish(c, build, only=["odd"])


def test_facts_come_from_the_newest_row_that_has_a_value(spark):
    from kinfold.catalog import Catalog
    from kinfold.operators.graph import build_graph

    columns = "accession_number string, transaction_id string, owner_cik string, issuer_cik string, shares double, price_per_share double, shares_following double, transaction_date string, source_file string, snapshot_date string, ingested_at string"
    rows = [
        ("A1", "t1", "7", "9", 100.0, 2.5, None, "2024-01-01", "a", "2024-01-01", "x"),
        ("A1", "t1", "7", "9", 200.0, None, None, "2024-01-01", "b", "2024-02-01", "x"),
        ("A1", "t1", "7", "9", 300.0, 4.0, None, "2024-01-01", "b", None, "x"),
        ("A1", "t1", "8", "9", 5.0, None, 0.0001, "2024-01-01", "a", "2024-01-01", "x"),
        ("A1", "t1", "8", "9", 5.0, None, 0.0001, "2024-01-01", "a", "2024-01-01", "x"),
        ("A1", None, "8", "9", 5.0, None, None, "2024-01-01", "a", "2024-01-01", "x"),
    ]
    facts = build_graph(Catalog(spark, tables={"sec_insider_transactions": lambda: spark.createDataFrame(rows, columns)}))["facts"]
    got = sorted((r["subject_node_id"], r["predicate"], r["value"], r["snapshot_date"]) for r in facts.collect())
    assert got == [
        ("owner-cik:7", "insider.price_per_share", "2.5", "2024-01-01"), ("owner-cik:7", "insider.transaction_shares", "200.0", "2024-02-01"),
        ("owner-cik:8", "insider.shares_following", "0.0001", "2024-01-01"), ("owner-cik:8", "insider.transaction_shares", "5.0", "2024-01-01"),
    ]


# --- work done once ---


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ratio_of_two_names_is_computed_once(spark):
    """Each pair of a query and a candidate had its ratio computed, in as few tasks as the rows' size asked for."""
    some = ["Oak Elm Trust", "Oak Elm Trust II", "Ashen Harbour & Söhne GmbH", None, ""]
    register = make_register(spark, [(f"L{i:02}", some[i % 5]) for i in range(20)])
    asked = ask(spark, [(f"q{i}", ["oak elms trust", "Harbour", None][i % 3], None, None, None, None) for i in range(6)])
    pairs = asked.crossJoin(register.withColumn("legal_name_norm", F.when(F.col("lei") != "L00", F.col("legal_name_norm"))))
    got = matching.score(pairs)
    assert "bit_count" not in optimized(got) and got.count() == 120
    plain = pairs.select("query_id", "lei", matching.token_set_ratio("q_name_norm", "legal_name_norm").alias("name_ratio"))
    assert sorted(got.select(plain.columns).collect()) == sorted(plain.collect())


def test_crosswalk_reads_its_filings_once(spark):
    """The latest filing of each filer was found anew for every use of the queries."""
    register = make_register(spark, [("L1", "North Rock Capital LLP", "GB", "GB"), ("L2", "Beta Ltd", "GB", "GB")])
    rows = [("1", "A1", "01-JAN-2020", "Old Name", "7", "London", "X0", "10001"), ("1", "A2", "02-JAN-2020", "North Rock Capital LLP", "7", "London", "X0", "10001"), ("2", "A3", "01-JAN-2020", "Zeta", None, None, "NY", None)]
    filings = frame(spark, rows, "cik string, accession_number string, filing_date string, filer_name string, crd_number string, filer_city string, filer_state_or_country string, filer_zipcode string")
    filings = filings.withColumns({c: F.lit("x") for c in ("source_file", "snapshot_date", "ingested_at")})
    out = matching.crosswalk(filings, register)
    assert "filing_date" not in optimized(out)
    assert {(r["cik"], r["filer_name"], r["decision"], r["lei"]) for r in out.collect()} == {("1", "North Rock Capital LLP", "AUTO_MATCH", "L1"), ("2", "Zeta", "UNMATCHED", None)}


def test_name_fields_made_in_steps(spark):
    from kinfold.functions import names

    df = frame(spark, [(n,) for n in ("Alpha Fund III LP", "Ærø & Söhne GmbH", "Ltd", "", None, "Łódź Master (Feeder) 12 plc", "株式会社 Oak")], "n string")
    assert names.with_name_fields(df, "n").collect() == df.withColumns(names.name_fields("n")).collect()


def test_stored_register_is_made_by_all_tasks(spark, sf_dir):
    from kinfold.operators.relational import tasks
    from kinfold.plans.base import register, stored_register

    got = stored_register(spark, sf_dir)
    assert got.rdd.getNumPartitions() == tasks(got) and "regexp" not in optimized(got)
    assert sorted(got.collect()) == sorted(register(spark, sf_dir).select(got.columns).collect())


@pytest.mark.parametrize("name", ["benchmark_run", "family_pool", "match_batch", "match_features"])
def test_names_of_the_register_are_made_once(spark, sf_dir, name):
    """What the query returns was made from the raw names, again for each use of queries, pairs or members."""
    from kinfold.plans.queries import QUERIES

    assert "initcap" not in optimized(QUERIES[name](spark, sf_dir))


def test_pairs_and_members_are_found_once(spark):
    """Positives were joined anew for each sample, evaluation pairs and the family's pool for each use of them."""
    register = make_register(spark, [(f"L{i}", n, "GB", "GB") for i, n in enumerate(["Oak Elm Capital LLP", "Oak Elm Fund II", "Oak Elm Fund III", "Oak Elm Fund III", "Gamma Holdings"])]).withColumn("entity_status", F.lit("ACTIVE"))
    isins = frame(spark, [(f"I{i}", f"L{i % 4}") for i in range(6)], "isin string, lei string").withColumn("isin", F.initcap("isin"))
    pairs = evaluation.evaluation_pairs(evaluation.positives(register, isins), evaluation.confusable_pairs(register))
    assert "initcap" not in optimized(pairs) and pairs.where("source = 'positives'").count() == 4
    asked = pairs.withColumn("query_name", F.initcap("query_name"))
    assert "initcap" not in optimized(evaluation.run_benchmark(asked, register))
    tied = frame(spark, [("L0", "L2", "IS_FUND-MANAGED_BY", "ACTIVE"), ("L0", "L4", "IS_FUND-MANAGED_BY", "ACTIVE")], "start_node_id string, end_node_id string, relationship_type string, relationship_status string")
    members = family.discover_family(frame(spark, [("a", "oak elm"), ("b", "Oak Elm Capital")], "query_id string, name string").withColumn("name", F.initcap("name")), register, tied)
    assert "initcap" not in optimized(members)
    want = {("L0", "high", True), ("L1", "possible", False), ("L2", "possible", True), ("L3", "possible", False)}
    got = members.collect()
    assert {q: {(r["lei"], r["tier"], r["graph_confirmed"]) for r in got if r["query_id"] == q} for q in "ab"} == {"a": want, "b": want} and len(got) == 8
