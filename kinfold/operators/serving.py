"""Documents that answer one read each: nested rows by key, built once instead of per request."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.catalog import Catalog, optional
from kinfold.config import Serving
from kinfold.functions.columns import ascending, descending, filing_date, latest_value, nested_list, some_value

from .filings import newest_name
from .graph import security_key
from .relational import exists_in, first_per_key, top_per_key, union_by_name

CONNECTION_TYPES = ["BANK_CONTROL_PARENT", "BENEFICIAL_OWNER", "SIGNIFICANT_CONTROL", "INSIDER_OF", "SUCCEEDED_BY"]
CFG = Serving()
ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"


def _or_empty(c: Column | str, like: str) -> Column:
    return F.coalesce(c if isinstance(c, Column) else F.col(c), F.array().cast(like))


def source_url(source: str = "source", ref: str = "source_record_ref", issuer: str = "end_node_id") -> Column:
    """Link to the filing behind an edge; null where there is none."""
    number = F.regexp_extract(F.col(issuer), "^cik:0*([0-9]+)$", 1)
    folder = F.concat(F.lit(ARCHIVE), number, F.lit("/"), F.replace(F.split(F.col(ref), ":")[0], F.lit("-"), F.lit("")), F.lit("/"))
    return F.when((number == "") | F.col(ref).isNull(), None).when(F.col(source) == "sec_13dg", F.concat(folder, F.lit("primary_doc.xml"))).when(F.col(source) == "sec_insiders", folder)


def ranked_connections(edges: DataFrame, nodes: DataFrame, facts: DataFrame | None = None, per_group: int = CFG.connections_per_group) -> DataFrame:
    """Per LEI, edge type and direction: the first per_group connections, current ones first, and the true total.

    An entity's connections are those of its own node and of all nodes known to be the same. Two joins, one for each
    end, take the place of one with OR, which would compare all pairs.
    """
    typed = edges.where(F.col("edge_type").isin(CONNECTION_TYPES))
    same = edges.where("edge_type = 'SAME_AS' AND end_node_id LIKE 'lei:%'").select(F.col("end_node_id").alias("lei_node"), F.col("start_node_id").alias("node_id"))
    own = union_by_name([typed.select(F.col(e).alias("lei_node"), F.col(e).alias("node_id")) for e in ("start_node_id", "end_node_id")]).where("lei_node LIKE 'lei:%'")
    mine = same.unionByName(own).distinct()
    sides = []
    for end, other, direction in (("start_node_id", "end_node_id", "outgoing"), ("end_node_id", "start_node_id", "incoming")):
        sides.append(typed.join(mine, typed[end] == mine["node_id"]).select("lei_node", F.lit(direction).alias("direction"), F.col(other).alias("other_node_id"), *[typed[c] for c in ("edge_type", "source", "valid_from", "valid_to", "source_record_ref", "end_node_id")]))
    touching = union_by_name(sides)
    names = nodes.select(F.col("node_id").alias("other_node_id"), F.col("display_name").alias("other_name"), F.col("node_type").alias("other_type"))
    touching = touching.join(names, "other_node_id", "left")
    if facts is None:
        touching = touching.withColumn("percent", F.lit(None).cast("double"))
    else:
        stakes = facts.where("predicate IN ('ownership.percent_of_class', 'bank_control.equity_percent')")
        touching = touching.join(stakes.groupBy("source_record_ref").agg(F.max(F.col("value").try_cast("double")).alias("percent")), "source_record_ref", "left")
    group = ["lei_node", "edge_type", "direction"]
    totals = touching.groupBy(*group).agg(F.count("*").alias("total"))
    order = [F.col("valid_to").isNotNull(), F.col("percent").desc_nulls_last(), F.col("valid_from").desc_nulls_last(), F.col("other_name").asc_nulls_last(), F.col("other_node_id"), F.col("source_record_ref")]
    return top_per_key(touching, group, order, per_group, "rank").join(totals, group).withColumn("source_url", source_url())


def connections(edges: DataFrame, nodes: DataFrame, facts: DataFrame | None = None, per_group: int = CFG.connections_per_group) -> DataFrame:
    """(entity_id, linked_records, groups): each entity's linked records and ranked groups as nested lists."""
    names = nodes.select(F.col("node_id").alias("start_node_id"), "display_name")
    linked = edges.where("edge_type = 'SAME_AS' AND end_node_id LIKE 'lei:%'").join(names, "start_node_id", "left")
    linked = linked.groupBy("end_node_id").agg(nested_list([F.col("start_node_id")], F.struct(F.col("start_node_id").alias("node_id"), "display_name", "source")).alias("linked_records"))
    linked = linked.withColumnRenamed("end_node_id", "lei_node")
    ranked = ranked_connections(edges, nodes, facts, per_group)
    item = F.struct("edge_type", "direction", "other_node_id", "other_name", "other_type", "source", "valid_from", "valid_to", "percent", "source_url")
    groups = ranked.groupBy("lei_node", "edge_type", "direction", "total").agg(nested_list([F.col("rank")], item).alias("connections"))
    groups = groups.groupBy("lei_node").agg(nested_list([F.col("edge_type"), F.col("direction")], F.struct("edge_type", "direction", "total", "connections")).alias("groups"))
    out = linked.join(groups, "lei_node", "full")
    kinds = dict(out.dtypes)
    return out.select(F.substring("lei_node", 5, 1000).alias("entity_id"), _or_empty("linked_records", kinds["linked_records"]).alias("linked_records"), _or_empty("groups", kinds["groups"]).alias("groups"))


def decision_documents(c: Catalog) -> DataFrame | None:
    """Per filer: the decision, with the runner-up's name and the points of each feature."""
    t = c.get("crosswalk_sec_13f_gleif")
    if t is None:
        return None
    t = t.withColumns({n: optional(t, n, k) for n, k in (("runner_up_lei", "string"), ("runner_up_score", "double"), ("feature_contributions", "string"), ("config_hash", "string"))})
    if "gleif_entities" in c:
        t = t.join(c["gleif_entities"].select(F.col("lei").alias("runner_up_lei"), F.col("legal_name").alias("runner_up_name")), "runner_up_lei", "left")
    else:
        t = t.withColumn("runner_up_name", F.lit(None).cast("string"))
    return t.select(
        F.concat(F.lit("cik:"), "cik").alias("node_id"), F.col("filer_name").alias("source_name"), "lei", "decision", "score", "gap", "reason", "runner_up_lei", "runner_up_name", "runner_up_score",
        F.from_json(F.coalesce("feature_contributions", F.lit("{}")), "map<string,double>").alias("feature_contributions"), "config_hash", F.col("snapshot_date").alias("decided_on"), F.lit("sec_13f_crosswalk").alias("source"),
    )


def entity_documents(c: Catalog, cfg: Serving = CFG) -> DataFrame | None:
    """Per LEI: the entity, its identifiers (capped by type, with the true total), exceptions, decisions and connections."""
    entities = c.get("entities")
    if entities is None:
        return None
    out = entities
    ids = c.get("entity_identifiers")
    if ids is not None:
        totals = ids.groupBy("entity_id").agg(F.count("*").alias("identifier_total"))
        kept = top_per_key(ids, ["entity_id", "identifier_type"], [F.col("identifier_value").asc_nulls_last()], cfg.identifiers_per_type)
        payload = F.struct("identifier_type", "identifier_value", "confidence", "source", "source_file", "snapshot_date", "ingested_at")
        lists = kept.groupBy("entity_id").agg(nested_list([*ascending("identifier_type"), *ascending("identifier_value")], payload).alias("identifiers"))
        ciks = ids.where("identifier_type = 'CIK'").groupBy("entity_id").agg(F.sort_array(F.collect_list("identifier_value")).alias("ciks"))
        out = out.join(totals, "entity_id", "left").join(lists, "entity_id", "left").join(ciks, "entity_id", "left")
        kinds = dict(out.dtypes)
        out = out.withColumns({"identifier_total": F.coalesce("identifier_total", F.lit(0)), "identifiers": _or_empty("identifiers", kinds["identifiers"]), "ciks": _or_empty("ciks", kinds["ciks"])})
    exceptions = c.get("gleif_relationship_exceptions")
    if exceptions is not None:
        lists = exceptions.groupBy(F.col("lei").alias("entity_id")).agg(nested_list([F.col("exception_category"), F.col("exception_reason")], F.struct("exception_category", "exception_reason")).alias("exceptions"))
        out = out.join(lists, "entity_id", "left")
        out = out.withColumn("exceptions", _or_empty("exceptions", dict(out.dtypes)["exceptions"]))
    register = c.get("gleif_entities")
    if register is not None and "successor_lei" in register.columns:
        out = out.join(register.select(F.col("lei").alias("entity_id"), "successor_lei"), "entity_id", "left")
    decisions = decision_documents(c)
    if decisions is not None:
        lists = decisions.where("lei IS NOT NULL").withColumnRenamed("lei", "entity_id").groupBy("entity_id").agg(nested_list([F.col("node_id")], F.struct(*[x for x in decisions.columns if x not in ("lei", "feature_contributions")], F.to_json("feature_contributions").alias("feature_contributions"))).alias("match_decisions"))
        out = out.join(lists, "entity_id", "left")
        out = out.withColumn("match_decisions", _or_empty("match_decisions", dict(out.dtypes)["match_decisions"]))
    if "knowledge_edges" in c and "knowledge_nodes" in c:
        out = out.join(connections(c["knowledge_edges"], c["knowledge_nodes"], c.get("knowledge_facts"), cfg.connections_per_group), "entity_id", "left")
    return out


def filer_documents(c: Catalog, cfg: Serving = CFG) -> DataFrame | None:
    """Per filer: newest name, latest period with its count, largest long positions, quarantined and suspect filings, match."""
    if "sec_13f_filings" not in c or "sec_13f_effective_holdings" not in c:
        return None
    filings, effective = c["sec_13f_filings"], c["sec_13f_effective_holdings"]
    dated = effective.select("accession_number", "cik", "period_of_report", "cusip", "name_of_issuer", "value_usd", "put_call")
    counts = dated.groupBy("cik", "period_of_report", "accession_number").agg(F.count("*").alias("n"))
    periods = counts.join(filings.select("accession_number", filing_date("filing_date").alias("filed")), "accession_number").groupBy("cik", "period_of_report").agg(F.max("filed").alias("filed"), F.sum("n").alias("reported"))
    latest = first_per_key(periods, ["cik"], [filing_date("period_of_report").desc_nulls_last(), F.col("period_of_report")])
    sums = dated.where("put_call IS NULL").join(latest.select("cik", "period_of_report"), ["cik", "period_of_report"]).groupBy("cik", "cusip").agg(some_value("name_of_issuer").alias("name_of_issuer"), F.sum("value_usd").alias("value"))
    top = top_per_key(sums, ["cik"], [F.col("value").desc_nulls_last(), F.col("cusip")], cfg.top_holdings, "rank")
    top = top.groupBy("cik").agg(nested_list([F.col("rank")], F.struct("name_of_issuer", "value", "cusip")).alias("top_reported_holdings"))
    out = newest_name(filings).join(latest, "cik", "left").join(top, "cik", "left")
    if "sec_13f_quarantine" in c:
        held = c["sec_13f_quarantine"].join(filings.select("accession_number", "cik"), "accession_number")
        held = held.groupBy("cik").agg(F.sort_array(F.collect_list(F.concat("accession_number", F.lit(": "), F.array_join("errors", ", ")))).alias("quarantined_filings"))
        out = out.join(held, "cik", "left")
    if "sec_13f_scale_checks" in c:
        suspect = c["sec_13f_scale_checks"].where("looks_like_thousands").groupBy("cik", "period_of_report").agg(F.sort_array(F.collect_list("accession_number")).alias("scale_suspect_filings"))
        out = out.join(suspect, ["cik", "period_of_report"], "left")
    if "crosswalk_sec_13f_gleif" in c:
        out = out.join(c["crosswalk_sec_13f_gleif"].select("cik", "lei", "decision"), "cik", "left")
    out = out.withColumns({n: F.lit(None).cast(k) for n, k in (("quarantined_filings", "array<string>"), ("scale_suspect_filings", "array<string>"), ("lei", "string"), ("decision", "string")) if n not in out.columns})
    kinds = dict(out.dtypes)
    return out.select(
        "cik", "filer_name", F.col("period_of_report").alias("latest_period_of_report"), F.upper(F.date_format("filed", "dd-MMM-yyyy")).alias("latest_filing_date"), F.coalesce("reported", F.lit(0)).alias("reported_security_count"), F.lit("USD").alias("value_unit"),
        *[_or_empty(n, kinds[n]).alias(n) for n in ("top_reported_holdings", "quarantined_filings", "scale_suspect_filings")], "lei", "decision",
    )


def holding_documents(c: Catalog) -> DataFrame | None:
    effective = c.get("sec_13f_effective_holdings")
    if effective is None:
        return None
    out = effective.select(
        "accession_number", "infotable_sk", "cik", "cusip", "name_of_issuer", "title_of_class", "put_call", "period_of_report", F.date_format(filing_date("period_of_report"), "yyyy-MM-dd").alias("period_date"),
        "value_usd", F.col("shares_or_principal_amount").alias("shares"), F.col("shares_or_principal_type").alias("shares_type"), "source_file", "snapshot_date",
    )
    if "sec_13f_scale_checks" not in c:
        return out.withColumn("scale_suspect", F.lit(False))
    return exists_in(out, "accession_number", c["sec_13f_scale_checks"].where("looks_like_thousands"), "accession_number", "scale_suspect")


def nport_fund_documents(c: Catalog, cfg: Serving = CFG) -> DataFrame | None:
    """Per series LEI: its latest report, the number of holdings, and the largest by value."""
    if "nport_funds" not in c or "nport_holdings" not in c:
        return None
    order = [filing_date("report_date").desc_nulls_last(), filing_date("filing_date").desc_nulls_last(), F.col("accession_number").desc()]
    latest = first_per_key(c["nport_funds"].where("series_lei IS NOT NULL"), ["series_lei"], order)
    held = c["nport_holdings"].select("accession_number", "holding_id", "issuer_name", "issuer_lei", F.col("issuer_cusip").alias("cusip"), "isin", "asset_category", "payoff_profile", F.col("currency_value").alias("value_usd"), "percentage")
    held = held.join(latest.select("accession_number").distinct(), "accession_number")
    counts = held.groupBy("accession_number").agg(F.count("*").alias("holding_count"))
    top = top_per_key(held, ["accession_number"], [F.col("value_usd").desc_nulls_last(), F.col("holding_id")], cfg.top_holdings, "rank")
    payload = F.struct("holding_id", "issuer_name", "issuer_lei", "cusip", "isin", "asset_category", "payoff_profile", "value_usd", "percentage")
    top = top.groupBy("accession_number").agg(nested_list([F.col("rank")], payload).alias("top_holdings"))
    out = latest.join(counts, "accession_number", "left").join(top, "accession_number", "left")
    return out.select("series_lei", "series_id", "series_name", "cik", "registrant_name", "registrant_lei", "accession_number", "report_date", "filing_date", "net_assets", "total_assets", "total_liabilities", F.coalesce("holding_count", F.lit(0)).alias("holding_count"), _or_empty("top_holdings", dict(out.dtypes)["top_holdings"]).alias("top_holdings"), "source_file")


def fund_series_documents(c: Catalog) -> DataFrame | None:
    """Per series: registrant, share classes, tickers, and the LEIs that reports state; a registrant's LEI holds for all its series."""
    series = c.get("sec_series_classes")
    if series is None:
        return None
    if "nport_funds" in c:
        reported = c["nport_funds"].where("series_id IS NOT NULL").groupBy("series_id").agg(*[latest_value(n, filing_date("report_date")).alias(n) for n in ("series_lei", "registrant_lei")])
    else:
        reported = series.select("series_id").limit(0).withColumns({n: F.lit(None).cast("string") for n in ("series_lei", "registrant_lei")})
    registrants = series.select("series_id", "cik").distinct().join(reported, "series_id").where("registrant_lei IS NOT NULL").groupBy("cik").agg(some_value("registrant_lei").alias("registrant_lei"))
    rows = series.where("coalesce(series_id, '') <> ''").join(reported.select("series_id", "series_lei"), "series_id", "left").join(registrants, "cik", "left")
    payload = F.struct("class_id", "class_name", F.col("class_ticker").alias("ticker"))
    return rows.groupBy("series_id").agg(
        some_value("series_name").alias("series_name"), some_value("cik").alias("cik"), some_value("entity_name").alias("registrant_name"), some_value("series_lei").alias("series_lei"), some_value("registrant_lei").alias("registrant_lei"),
        nested_list(ascending("class_id"), payload).alias("classes"), F.sort_array(F.collect_set("class_id")).alias("class_ids"), F.sort_array(F.collect_set(F.upper("class_ticker"))).alias("tickers"),
        F.max("snapshot_date").alias("snapshot_date"), some_value("source_file").alias("source_file"),
    )


def security_documents(c: Catalog) -> DataFrame | None:
    """Per CUSIP: the securities it maps to, most listed first; one is resolved, several are ambiguous, none is no_match."""
    t = c.get("openfigi_mappings")
    if t is None:
        return None
    us_first = lambda n: F.coalesce(F.min(F.when(F.col("exchange_code") == "US", F.col(n))), F.min(n)).alias(n)
    listed = t.where("figi IS NOT NULL").withColumn("security_key", security_key())
    each = listed.groupBy("cusip", "security_key").agg(
        some_value("share_class_figi").alias("share_class_figi"), F.sort_array(F.collect_set("composite_figi")).alias("composite_figis"), us_first("name"), us_first("ticker"),
        some_value("security_type").alias("security_type"), some_value("security_type_2").alias("security_type_2"), some_value("market_sector").alias("market_sector"), F.count("*").alias("listing_count"),
    )
    payload = F.struct("security_key", "share_class_figi", "composite_figis", "name", "ticker", "security_type", "security_type_2", "market_sector", "listing_count")
    grouped = each.groupBy("cusip").agg(
        nested_list([*descending("listing_count"), F.col("security_key")], payload).alias("securities"), F.sort_array(F.collect_set(F.upper("ticker"))).alias("tickers"),
        F.concat(F.sort_array(F.collect_set("security_key")), F.sort_array(F.flatten(F.collect_list("composite_figis")))).alias("figis"),
    )
    cusips = t.groupBy("cusip").agg(F.max("snapshot_date").alias("snapshot_date"), some_value("source_file").alias("source_file"), some_value("error").alias("error"))
    out = cusips.join(grouped, "cusip", "left")
    kinds = dict(out.dtypes)
    out = out.withColumns({n: _or_empty(n, kinds[n]) for n in ("securities", "tickers", "figis")})
    return out.withColumn("status", F.when(F.size("securities") == 0, "no_match").when(F.size("securities") == 1, "resolved").otherwise("ambiguous"))


def _plain(table: str) -> Callable[[Catalog], DataFrame | None]:
    def rows(c: Catalog) -> DataFrame | None:
        t = c.get(table)
        return None if t is None else t.drop("ingested_at")

    return rows


def relationship_documents(c: Catalog) -> DataFrame | None:
    t = c.get("gleif_relationships")
    return None if t is None else t.select("start_node_id", "end_node_id", "relationship_type", "relationship_status", "start_date", "end_date")


def xbrl_series_documents(c: Catalog) -> DataFrame | None:
    """Per (cik, tag, unit): every distinct observation by period, filing day and accession; restatements stay."""
    t = c.get("sec_xbrl_facts")
    if t is None:
        return None
    fields = ["period_start", "period_end", "fiscal_year", "fiscal_period", "form", "filed", "accession_number", "frame", "value"]
    rows = t.select("cik", "entity_name", "tag", "unit", *fields).distinct()
    return rows.groupBy("cik", "tag", "unit").agg(some_value("entity_name").alias("entity_name"), nested_list([F.col("period_end"), F.col("filed"), F.col("accession_number"), *[F.col(f) for f in ("period_start", "value")]], F.struct(*fields)).alias("observations"))


#: Builders by the name of their documents; a new read is a function here.
BUILDERS: dict[str, Callable[[Catalog], DataFrame | None]] = {
    "entities": entity_documents, "filers": filer_documents, "holdings": holding_documents, "nport_funds": nport_fund_documents, "fund_series": fund_series_documents, "securities": security_documents,
    "relationships": relationship_documents, "ownership": _plain("sec_13dg_ownership"), "adv_documents": _plain("sec_adv_documents"), "adv_pages": _plain("sec_adv_pages"),
    "xbrl_facts": xbrl_series_documents, "xbrl_issuers": _plain("sec_xbrl_issuers"), "decisions": decision_documents,
}


def coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: its rows, the newest snapshot as a date, and its columns; a table is scanned once."""
    from kinfold.functions.columns import any_date

    rows = []
    for name, t in tables.items():
        newest = F.max(any_date("snapshot_date")) if "snapshot_date" in t.columns else F.lit(None).cast("date")
        rows.append(t.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"), newest.alias("latest_snapshot"), F.lit(",".join(sorted(t.columns))).alias("columns")))
    return union_by_name(rows)
