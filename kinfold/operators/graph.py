"""The typed evidence graph: nodes, edges, identifiers and addressed facts from every source table there is.

Each kind of row is a declaration over one source table. A source that is missing contributes nothing; one of an
older shape contributes what its columns allow. Rows are united by name and reduced to the newest for each key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.catalog import Catalog, optional
from kinfold.functions.columns import any_date, double_text, latest_value, some_value

from .relational import dedupe_latest, first_per_key, union_by_name, unpivot

NODE_TYPES = "LEGAL_ENTITY FUND_SERIES SHARE_CLASS SECURITY PERSON REPORTING_OWNER".split()
EDGE_OF_RELATIONSHIP = {
    "IS_DIRECTLY_CONSOLIDATED_BY": "ACCOUNTING_PARENT", "IS_ULTIMATELY_CONSOLIDATED_BY": "ACCOUNTING_ULTIMATE_PARENT",
    "IS_FUND-MANAGED_BY": "FUND_MANAGED_BY", "IS_SUBFUND_OF": "SUBFUND_OF", "IS_INTERNATIONAL_BRANCH_OF": "BRANCH_OF",
}
PROVENANCE = ["source_file", "snapshot_date", "ingested_at"]


def node_id(prefix: str, key: Column | str) -> Column:
    """prefix:key; null for a null key."""
    return F.concat(F.lit(prefix + ":"), F.col(key) if isinstance(key, str) else key)


def owner_node() -> Column:
    """A reporting person: individuals share the node of insiders, others are entities."""
    return F.concat(F.when(F.col("reporting_person_type") == "IN", "owner-cik:").otherwise("cik:"), F.col("reporting_person_cik"))


def security_key() -> Column:
    return F.coalesce("share_class_figi", "composite_figi", "figi")


def _securities(t: DataFrame) -> DataFrame:
    return t.where("figi IS NOT NULL").withColumn("security_key", security_key())


@dataclass(frozen=True)
class NodeRule:
    """Nodes from a table: one a row, or, if grouped, one a key, named by some value or by the newest of a date column."""

    table: str
    source: str
    prefix: str
    key: str
    type: str
    name: str
    status: str | None = None
    where: str | None = None
    grouped: bool = True
    newest_by: str | None = None
    prepare: Callable[[DataFrame], DataFrame] | None = None

    def rows(self, t: DataFrame) -> DataFrame:
        t = self.prepare(t) if self.prepare else t
        t = t.where(self.where) if self.where else t
        t = t.withColumns({"_name": F.expr(self.name), "_status": F.expr(self.status) if self.status else F.lit(None).cast("string")})
        if self.grouped:
            pick = (lambda c: latest_value(c, any_date(self.newest_by))) if self.newest_by else some_value
            t = t.groupBy(self.key).agg(pick("_name").alias("_name"), F.lit(None).cast("string").alias("_status"), pick("source_file").alias("source_file"), F.max("snapshot_date").alias("snapshot_date"), F.max("ingested_at").alias("ingested_at"))
        return t.select(node_id(self.prefix, self.key).alias("node_id"), F.lit(self.type).alias("node_type"), F.col("_name").alias("display_name"), F.col("_status").alias("status"), F.lit(self.source).alias("source"), F.col(self.key).alias("source_record_ref"), *PROVENANCE)


NODES = [
    NodeRule("gleif_entities", "gleif", "lei", "lei", "LEGAL_ENTITY", "legal_name", "entity_status", grouped=False),
    NodeRule("sec_submissions", "sec_submissions", "cik", "cik", "LEGAL_ENTITY", "name", grouped=False),
    NodeRule("sec_series_classes", "sec_series_class", "cik", "cik", "LEGAL_ENTITY", "entity_name"),
    NodeRule("sec_series_classes", "sec_series_class", "series", "series_id", "FUND_SERIES", "series_name"),
    NodeRule("sec_series_classes", "sec_series_class", "class", "class_id", "SHARE_CLASS", "class_name", where="class_id IS NOT NULL"),
    NodeRule("nport_funds", "nport", "series", "series_id", "FUND_SERIES", "series_name", where="series_id IS NOT NULL"),
    NodeRule("nport_holdings", "nport", "security:cusip", "issuer_cusip", "SECURITY", "coalesce(issuer_title, issuer_name)", where="issuer_cusip IS NOT NULL"),
    NodeRule("openfigi_mappings", "openfigi", "figi", "security_key", "SECURITY", "name", prepare=_securities),
    NodeRule("sec_13f_filings", "sec_13f", "cik", "cik", "LEGAL_ENTITY", "filer_name", newest_by="filing_date"),
    NodeRule("sec_13f_effective_holdings", "sec_13f", "security:cusip", "cusip", "SECURITY", "name_of_issuer", where="cusip IS NOT NULL"),
    NodeRule("sec_insider_relationships", "sec_insiders", "owner-cik", "owner_cik", "REPORTING_OWNER", "owner_name"),
    NodeRule("sec_insider_relationships", "sec_insiders", "cik", "issuer_cik", "LEGAL_ENTITY", "issuer_name"),
    NodeRule("companies_house_companies", "companies_house", "uk-company", "company_number", "LEGAL_ENTITY", "company_name", "company_status", grouped=False),
    NodeRule("companies_house_psc", "companies_house_psc", "ch-psc", "psc_id", "REPORTING_OWNER", "name", "CASE WHEN ceased_on IS NULL THEN 'ACTIVE' ELSE 'CEASED' END", grouped=False),
    NodeRule("sec_13dg_ownership", "sec_13dg", "owner-cik", "reporting_person_cik", "REPORTING_OWNER", "reporting_person_name", where="reporting_person_cik IS NOT NULL AND reporting_person_type = 'IN'", newest_by="filing_date"),
    NodeRule("sec_13dg_ownership", "sec_13dg", "cik", "reporting_person_cik", "LEGAL_ENTITY", "reporting_person_name", where="reporting_person_cik IS NOT NULL AND reporting_person_type IS DISTINCT FROM 'IN'", newest_by="filing_date"),
    NodeRule("sec_13dg_ownership", "sec_13dg", "cik", "issuer_cik", "LEGAL_ENTITY", "issuer_name", newest_by="filing_date"),
    NodeRule("sec_13dg_ownership", "sec_13dg", "security:cusip", "issuer_cusip", "SECURITY", "issuer_name", where="length(issuer_cusip) = 9", newest_by="filing_date"),
    NodeRule("ffiec_nic_institutions", "ffiec_nic", "rssd", "rssd_id", "LEGAL_ENTITY", "legal_name", "CASE WHEN closed_on IS NULL THEN 'ACTIVE' ELSE 'CLOSED' END", grouped=False),
]


def _edge(t: DataFrame, start: Column, end: Column, kind: Column | str, source: str, ref: Column, since: Column | None = None, until: Column | None = None, snapshot: str = "snapshot_date") -> DataFrame:
    none = F.lit(None).cast("string")
    return t.select(
        start.alias("start_node_id"), end.alias("end_node_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("edge_type"),
        (none if since is None else since).alias("valid_from"), (none if until is None else until).alias("valid_to"), F.lit(source).alias("source"), ref.alias("source_record_ref"),
        "source_file", F.col(snapshot).alias("snapshot_date"), "ingested_at",
    )


def _ref(*parts: str) -> Column:
    return F.concat(*[x for i, p in enumerate(parts) for x in ([F.lit(":")] if i else []) + [F.col(p).cast("string")]])


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The last outcome for each (node_id, lei): by time, then by line."""
    return first_per_key(reviews, ["node_id", "lei"], [F.col("reviewed_at").desc_nulls_last(), F.col("line_no").desc()])


def _gleif_edges(c: Catalog) -> DataFrame:
    t = c["gleif_relationships"].where("relationship_status = 'ACTIVE'")
    kind = F.coalesce(*[F.when(F.col("relationship_type") == k, F.lit(v)) for k, v in EDGE_OF_RELATIONSHIP.items()], F.lit("GLEIF_RELATIONSHIP"))
    return _edge(t, node_id("lei", "start_node_id"), node_id("lei", "end_node_id"), kind, "gleif", _ref("start_node_id", "end_node_id", "relationship_type"), F.col("start_date"), F.col("end_date"))


def _crosswalk_edges(c: Catalog) -> DataFrame:
    t = c["crosswalk_sec_13f_gleif"].where("lei IS NOT NULL AND decision = 'AUTO_MATCH'")
    if "match_reviews" in c:
        no = latest_reviews(c["match_reviews"]).where("upper(outcome) = 'REJECTED'").select(F.col("node_id").alias("_node"), F.col("lei").alias("_lei"))
        t = t.join(no, (node_id("cik", "cik") == F.col("_node")) & (F.col("lei") == F.col("_lei")), "left_anti")
    return _edge(t, node_id("cik", "cik"), node_id("lei", "lei"), "SAME_AS", "sec_13f_crosswalk", _ref("cik", "lei")).distinct()


def _review_edges(c: Catalog) -> DataFrame:
    t = latest_reviews(c["match_reviews"]).where("upper(outcome) = 'CONFIRMED'").withColumns({"source_file": F.lit("match_reviews.csv"), "ingested_at": F.lit(None).cast("string")})
    return _edge(t, F.col("node_id"), node_id("lei", "lei"), "SAME_AS", "human_review", _ref("reviewer", "reviewed_at"), snapshot="reviewed_at")


def _nport_holding_edges(c: Catalog) -> DataFrame:
    funds = c["nport_funds"].where("series_id IS NOT NULL").select("accession_number", "series_id", "report_date")
    t = c["nport_holdings"].where("issuer_cusip IS NOT NULL").join(funds, "accession_number")
    return _edge(t, node_id("series", "series_id"), node_id("security:cusip", "issuer_cusip"), "REPORTED_HOLDING", "nport", F.col("holding_id"), snapshot="report_date").distinct()


def _figi_edges(c: Catalog) -> DataFrame:
    """A CUSIP is one security only if all its listings agree on the share class."""
    t = _securities(c["openfigi_mappings"]).groupBy("cusip").agg(F.min("security_key").alias("low"), F.max("security_key").alias("high"), some_value("source_file").alias("source_file"), F.max("snapshot_date").alias("snapshot_date"), F.max("ingested_at").alias("ingested_at"))
    return _edge(t.where("low = high"), node_id("security:cusip", "cusip"), node_id("figi", "low"), "SAME_AS", "openfigi", F.col("cusip"))


def _company_edges(c: Catalog) -> DataFrame:
    key = lambda x: F.upper(F.trim(F.col(x)))
    g = c["gleif_entities"].where("jurisdiction LIKE 'GB%'").select("lei", key("registration_id").alias("_key"), *PROVENANCE)
    t = g.join(c["companies_house_companies"].select("company_number", key("company_number").alias("_key")), "_key")
    return _edge(t, node_id("uk-company", "company_number"), node_id("lei", "lei"), "SAME_AS", "gleif_registration_id", _ref("company_number", "lei")).distinct()


def _simple(table: str, start: tuple[str, str], end: tuple[str, str], kind: str, source: str, ref: tuple[str, ...], where: str = "true", since: str | None = None, until: str | None = None, snapshot: str = "snapshot_date", distinct: bool = False):
    def rows(c: Catalog) -> DataFrame:
        out = _edge(c[table].where(where), node_id(*start), node_id(*end), kind, source, _ref(*ref), F.expr(since) if since else None, F.expr(until) if until else None, snapshot)
        return out.distinct() if distinct else out

    return (table,), rows


def _ownership_edges(c: Catalog) -> DataFrame:
    """A stake reported below five percent closes the edge on the event's day."""
    t = c["sec_13dg_ownership"].where("reporting_person_cik IS NOT NULL")
    return _edge(t, owner_node(), node_id("cik", "issuer_cik"), "BENEFICIAL_OWNER", "sec_13dg", _ref("accession_number", "person_index"), F.col("event_date"), F.when(F.col("percent_of_class") < 5, F.col("event_date")))


def _successor_edges(c: Catalog) -> DataFrame:
    t = c["gleif_entities"]
    t = t.withColumn("successor_lei", optional(t, "successor_lei")).where("successor_lei IS NOT NULL")
    return _edge(t, node_id("lei", "lei"), node_id("lei", "successor_lei"), "SUCCEEDED_BY", "gleif", _ref("lei", "successor_lei"))


EDGES: list[tuple[tuple[str, ...], Callable[[Catalog], DataFrame]]] = [
    (("gleif_relationships",), _gleif_edges),
    _simple("sec_series_classes", ("series", "series_id"), ("cik", "cik"), "SERIES_OF_REGISTRANT", "sec_series_class", ("series_id", "cik"), distinct=True),
    _simple("sec_series_classes", ("class", "class_id"), ("series", "series_id"), "CLASS_OF_SERIES", "sec_series_class", ("class_id", "series_id"), "class_id IS NOT NULL", distinct=True),
    (("crosswalk_sec_13f_gleif",), _crosswalk_edges),
    (("match_reviews",), _review_edges),
    _simple("nport_funds", ("cik", "cik"), ("lei", "registrant_lei"), "SAME_AS", "nport", ("accession_number",), "cik IS NOT NULL AND registrant_lei IS NOT NULL", snapshot="report_date", distinct=True),
    _simple("nport_funds", ("series", "series_id"), ("lei", "series_lei"), "SAME_AS", "nport", ("accession_number",), "series_id IS NOT NULL AND series_lei IS NOT NULL", snapshot="report_date", distinct=True),
    _simple("nport_holdings", ("security:cusip", "issuer_cusip"), ("lei", "issuer_lei"), "ISSUED_BY", "nport", ("holding_id",), "issuer_cusip IS NOT NULL AND issuer_lei IS NOT NULL", distinct=True),
    (("nport_holdings", "nport_funds"), _nport_holding_edges),
    (("openfigi_mappings",), _figi_edges),
    _simple("sec_insider_relationships", ("owner-cik", "owner_cik"), ("cik", "issuer_cik"), "INSIDER_OF", "sec_insiders", ("accession_number",), snapshot="filing_date", distinct=True),
    _simple("sec_13f_effective_holdings", ("cik", "cik"), ("security:cusip", "cusip"), "REPORTED_HOLDING", "sec_13f", ("accession_number", "infotable_sk"), "cusip IS NOT NULL AND put_call IS NULL", "period_of_report", "period_of_report", distinct=True),
    (("companies_house_companies", "gleif_entities"), _company_edges),
    _simple("companies_house_psc", ("ch-psc", "psc_id"), ("uk-company", "company_number"), "SIGNIFICANT_CONTROL", "companies_house_psc", ("psc_id",), since="notified_on", until="ceased_on"),
    (("gleif_entities",), _successor_edges),
    (("sec_13dg_ownership",), _ownership_edges),
    _simple("sec_13dg_ownership", ("security:cusip", "issuer_cusip"), ("cik", "issuer_cik"), "ISSUED_BY", "sec_13dg", ("accession_number",), "length(issuer_cusip) = 9", distinct=True),
    _simple("ffiec_nic_institutions", ("rssd", "rssd_id"), ("lei", "lei"), "SAME_AS", "ffiec_nic", ("rssd_id", "lei"), "lei IS NOT NULL"),
    _simple("ffiec_nic_relationships", ("rssd", "offspring_rssd_id"), ("rssd", "parent_rssd_id"), "BANK_CONTROL_PARENT", "ffiec_nic", ("parent_rssd_id", "offspring_rssd_id"), "controlled AND end_date IS NULL", "start_date", "end_date"),
    _simple("ffiec_nic_transformations", ("rssd", "predecessor_rssd_id"), ("rssd", "successor_rssd_id"), "SUCCEEDED_BY", "ffiec_nic", ("predecessor_rssd_id", "successor_rssd_id"), since="transformation_date"),
]


@dataclass(frozen=True)
class IdentifierRule:
    table: str
    prefix: str
    key: str
    type: str  # SQL
    value: str
    source: str
    ref: tuple[str, ...]
    where: str = "true"

    def rows(self, t: DataFrame) -> DataFrame:
        return t.where(self.where).select(node_id(self.prefix, self.key).alias("node_id"), F.expr(self.type).alias("identifier_type"), F.col(self.value).alias("identifier_value"), F.lit("SOURCE").alias("confidence"), F.lit(self.source).alias("source"), _ref(*self.ref).alias("source_record_ref"), *PROVENANCE).distinct()


IDENTIFIERS = [
    IdentifierRule("gleif_entities", "lei", "lei", "'LEI'", "lei", "gleif", ("lei",)),
    IdentifierRule("gleif_external_identifiers", "lei", "lei", "identifier_type", "identifier_value", "gleif_mapping", ("lei", "identifier_value")),
    IdentifierRule("sec_series_classes", "series", "series_id", "'SEC_SERIES_ID'", "series_id", "sec_series_class", ("series_id",)),
    IdentifierRule("sec_series_classes", "class", "class_id", "'TICKER'", "class_ticker", "sec_series_class", ("class_id",), "class_id IS NOT NULL AND class_ticker IS NOT NULL"),
    IdentifierRule("companies_house_companies", "uk-company", "company_number", "'COMPANIES_HOUSE_NUMBER'", "company_number", "companies_house", ("company_number",)),
    IdentifierRule("ffiec_nic_institutions", "rssd", "rssd_id", "'RSSD_ID'", "rssd_id", "ffiec_nic", ("rssd_id",)),
]


def _facts(t: DataFrame, id_parts: list[Column], subject: Column, obj: Column, facts: list[tuple[str, Column, Column, Column]], as_of: str, source: str, document: Column, ref: Column, locator: Callable[[Column], Column], suffix: str | None = None) -> DataFrame:
    """A row for each fact (predicate, value text, unit, field) that has a value; its id is the SHA-256 of its address.

    Addresses of different sources never agree, so each source keeps its newest facts itself: its rows are sorted once
    by address before they are spread over their facts, and a fact comes from the first row that has a value for it.
    A row without an address has no facts.
    """
    keep = ["_subject", "_object", "_as_of", "_document", "_ref", "_id", *PROVENANCE]
    cells = {f"_{kind}{i}": c for i, (_, *row) in enumerate(facts) for kind, c in zip(("value", "unit", "field"), row, strict=True)}
    t = t.select(subject.alias("_subject"), obj.alias("_object"), F.col(as_of).alias("_as_of"), document.alias("_document"), ref.alias("_ref"), F.concat(*id_parts).alias("_id"), *PROVENANCE, *[c.alias(n) for n, c in cells.items()]).where("_id IS NOT NULL")
    # the hash sorts by its prefix, which addresses of one source share
    address = Window.partitionBy(F.xxhash64("_id"), "_id").orderBy(F.col("snapshot_date").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in t.columns if c not in ("_id", "snapshot_date")])
    so_far = address.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns({f"_n{i}": F.count(f"_value{i}").over(so_far) for i in range(len(facts))})
    rows = unpivot(t, keep, [{"predicate": F.lit(p), "value": F.when(F.col(f"_n{i}") == 1, F.col(f"_value{i}")), "unit": F.col(f"_unit{i}"), "field": F.col(f"_field{i}")} for i, (p, *_) in enumerate(facts)])
    ident = F.concat(F.col("_id"), F.lit(suffix) if suffix else F.col("predicate"))
    return rows.select(
        F.sha2(ident, 256).alias("fact_id"), F.col("_subject").alias("subject_node_id"), F.col("_object").alias("object_node_id"), "predicate", "value", "unit", F.col("_as_of").alias("as_of"),
        F.lit(source).alias("source"), F.col("_document").alias("document_id"), F.col("_ref").alias("source_record_ref"), locator(F.col("field")).alias("locator"), *PROVENANCE,
    )


NONE = "CAST(NULL AS STRING)"


def _decision_facts(c: Catalog) -> DataFrame:
    t = c["crosswalk_sec_13f_gleif"]
    file = "crosswalk_sec_13f_gleif.parquet"
    facts = [("match.decision", F.col("decision"), F.expr(NONE), F.lit("decision")), ("match.score", double_text("score"), F.lit("points"), F.lit("score")), ("match.runner_up_gap", double_text("gap"), F.lit("points"), F.lit("gap"))]
    if "config_hash" in t.columns:
        facts += [("match.runner_up_lei", F.col("runner_up_lei"), F.expr(NONE), F.lit("runner_up_lei")), ("match.config_hash", F.col("config_hash"), F.expr(NONE), F.lit("config_hash"))]
    where = lambda f: F.concat(F.lit(f"{file}:cik="), F.col("_ref"), F.lit(":"), f)
    out = _facts(t, [F.lit("crosswalk:"), F.col("cik"), F.lit(":")], node_id("cik", "cik"), node_id("lei", "lei"), facts, "snapshot_date", "sec_13f_crosswalk", F.lit(file), F.col("cik"), where)
    if "feature_contributions" not in t.columns:
        return out
    each = t.where("feature_contributions IS NOT NULL").select("*", F.explode(F.from_json("feature_contributions", "map<string,double>")).alias("feature", "points"))
    more = each.where("points IS NOT NULL").select(
        F.sha2(F.concat(F.lit("crosswalk:"), "cik", F.lit(":feature:"), "feature"), 256).alias("fact_id"), node_id("cik", "cik").alias("subject_node_id"), node_id("lei", "lei").alias("object_node_id"),
        F.concat(F.lit("match.feature."), "feature").alias("predicate"), double_text("points").alias("value"), F.lit("points").alias("unit"), F.col("snapshot_date").alias("as_of"), F.lit("sec_13f_crosswalk").alias("source"),
        F.lit(file).alias("document_id"), F.col("cik").alias("source_record_ref"), F.concat(F.lit(f"{file}:cik="), "cik", F.lit(":feature_contributions."), "feature").alias("locator"), *PROVENANCE,
    )
    return out.unionByName(_newest(more.where("fact_id IS NOT NULL"), "facts"))


def _review_facts(c: Catalog) -> DataFrame:
    t = c["match_reviews"].withColumns({"source_file": F.lit("match_reviews.csv"), "snapshot_date": F.col("reviewed_at"), "ingested_at": F.expr(NONE), "line": F.col("line_no").cast("string")})
    facts = [("review.outcome", F.upper("outcome"), F.expr(NONE), F.col("line")), ("review.reviewer", F.col("reviewer"), F.expr(NONE), F.col("line")), ("review.rationale", F.col("rationale"), F.expr(NONE), F.col("line"))]
    return _facts(t, [F.lit("review:"), F.col("line"), F.lit(":")], F.col("node_id"), node_id("lei", "lei"), facts, "reviewed_at", "human_review", F.lit("match_reviews.csv"), F.col("reviewer"), lambda f: F.concat(F.lit("match_reviews.csv:line="), f, F.lit(":"), F.col("predicate")))


def _nport_facts(c: Catalog) -> DataFrame:
    funds = c["nport_funds"].where("series_id IS NOT NULL").select("accession_number", "series_id", "report_date")
    t = c["nport_holdings"].join(funds, "accession_number")
    facts = [("holding.balance", double_text("balance"), F.col("unit"), F.lit("BALANCE")), ("holding.currency_value", double_text("currency_value"), F.col("currency_code"), F.lit("CURRENCY_VALUE")), ("holding.portfolio_percentage", double_text("percentage"), F.lit("percent"), F.lit("PERCENTAGE"))]
    return _facts(t, [F.lit("nport:"), F.col("holding_id"), F.lit(":")], node_id("series", "series_id"), node_id("security:cusip", "issuer_cusip"), facts, "report_date", "nport", F.col("accession_number"), F.col("holding_id"), lambda f: F.concat(F.lit("FUND_REPORTED_HOLDING.tsv:HOLDING_ID="), F.col("_ref"), F.lit(":"), f))


def _insider_facts(c: Catalog) -> DataFrame:
    facts = [("insider.transaction_shares", double_text("shares"), F.lit("shares"), F.lit("TRANS_SHARES")), ("insider.price_per_share", double_text("price_per_share"), F.expr(NONE), F.lit("TRANS_PRICEPERSHARE")), ("insider.shares_following", double_text("shares_following"), F.lit("shares"), F.lit("SHRS_OWND_FOLWNG_TRANS"))]
    return _facts(c["sec_insider_transactions"], [F.lit("sec-insider:"), F.col("transaction_id"), F.lit(":"), F.col("owner_cik"), F.lit(":")], node_id("owner-cik", "owner_cik"), node_id("cik", "issuer_cik"), facts, "transaction_date", "sec_insiders", F.col("accession_number"), F.col("transaction_id"), lambda f: F.concat(F.lit("transaction:"), F.col("_ref"), F.lit(":"), f))


def _holding_facts(c: Catalog) -> DataFrame:
    t = c["sec_13f_effective_holdings"].where("value_usd IS NOT NULL AND put_call IS NULL")
    facts = [("holding.reported_value", F.col("value_usd").cast("string"), F.lit("USD"), F.lit("VALUE"))]
    return _facts(t, [F.lit("sec-13f:"), F.col("accession_number"), F.lit(":"), F.col("infotable_sk")], node_id("cik", "cik"), node_id("security:cusip", "cusip"), facts, "period_of_report", "sec_13f", F.col("accession_number"), F.col("infotable_sk"), lambda f: F.concat(F.lit("INFOTABLE.tsv:INFOTABLE_SK="), F.col("_ref"), F.lit(":"), f), suffix=":value_usd")


def _ownership_facts(c: Catalog) -> DataFrame:
    t = c["sec_13dg_ownership"].where("reporting_person_cik IS NOT NULL")
    long = F.col("form_type").startswith("SCHEDULE 13D")
    at = F.concat(F.when(long, "reportingPersonInfo").otherwise("coverPageHeaderReportingPersonDetails"), F.lit("["), F.col("person_index").cast("string"), F.lit("]/"))
    facts = [
        ("ownership.percent_of_class", double_text("percent_of_class"), F.lit("percent"), F.concat(at, F.when(long, "percentOfClass").otherwise("classPercent"))),
        ("ownership.aggregate_shares", double_text("aggregate_shares"), F.lit("shares"), F.concat(at, F.when(long, "aggregateAmountOwned").otherwise("reportingPersonBeneficiallyOwnedAggregateNumberOfShares"))),
        ("ownership.filing_intent", F.col("filing_intent"), F.expr(NONE), F.lit("headerData/submissionType")),
    ]
    ref = _ref("accession_number", "person_index")
    return _facts(t, [F.lit("sec-13dg:"), ref, F.lit(":")], owner_node(), node_id("cik", "issuer_cik"), facts, "event_date", "sec_13dg", F.col("accession_number"), ref, lambda f: F.concat(F.lit("primary_doc.xml:"), f))


def _bank_facts(c: Catalog) -> DataFrame:
    t = c["ffiec_nic_relationships"].where("controlled AND end_date IS NULL")
    facts = [("bank_control.equity_percent", double_text("equity_percent"), F.lit("percent"), F.concat(F.lit("ID_RSSD_PARENT="), "parent_rssd_id", F.lit(":ID_RSSD_OFFSPRING="), "offspring_rssd_id", F.lit(":PCT_EQUITY")))]
    ref = _ref("parent_rssd_id", "offspring_rssd_id")
    return _facts(t, [F.lit("nic:"), ref], node_id("rssd", "offspring_rssd_id"), node_id("rssd", "parent_rssd_id"), facts, "start_date", "ffiec_nic", F.col("source_file"), ref, lambda f: f, suffix=":equity")


FACTS: list[tuple[tuple[str, ...], Callable[[Catalog], DataFrame]]] = [
    (("nport_holdings", "nport_funds"), _nport_facts), (("sec_insider_transactions",), _insider_facts), (("sec_13f_effective_holdings",), _holding_facts),
    (("sec_13dg_ownership",), _ownership_facts), (("ffiec_nic_relationships",), _bank_facts), (("crosswalk_sec_13f_gleif",), _decision_facts), (("match_reviews",), _review_facts),
]
KEYS = {"nodes": ["node_id"], "edges": ["start_node_id", "end_node_id", "edge_type", "source"], "identifiers": ["node_id", "identifier_type", "identifier_value", "source"], "facts": ["fact_id"]}


def _newest(t: DataFrame, kind: str) -> DataFrame:
    first = ["source", "source_record_ref", "source_file"]
    return dedupe_latest(t, KEYS[kind], ties=[*first, *[c for c in t.columns if c not in first and c not in KEYS[kind]]])


def build_graph(c: Catalog) -> dict[str, DataFrame]:
    """nodes, edges, identifiers and facts; a kind that no source has is left out.

    Newest snapshot first; ties go by source and record and then by all other columns, so that reruns agree. Facts
    come from their sources without older ones.
    """
    found = {
        "nodes": [r.rows(c[r.table]) for r in NODES if r.table in c],
        "edges": [rows(c) for tables, rows in EDGES if all(t in c for t in tables)],
        "identifiers": [r.rows(c[r.table]) for r in IDENTIFIERS if r.table in c],
        "facts": [rows(c) for tables, rows in FACTS if all(t in c for t in tables)],
    }
    united = {kind: union_by_name(tables) for kind, tables in found.items() if tables}
    return {kind: t if kind == "facts" else _newest(t, kind) for kind, t in united.items()}
