"""The star-schema tables in the roles of source tables: orders as filings, lines as holdings, parts as entities.

Nulls, amendments, aliases and errors are made from the keys, as the plain tables have none. SQL has the same tables
for the engine that checks the results; the two are written apart on purpose.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.catalog import Catalog
from kinfold.functions import names
from kinfold.operators.matching import CANDIDATE_FIELDS
from kinfold.operators.relational import cut_lineage, tasks

SUFFIXES = ["Limited", "LLC", "Fund II", "Fund III LP", "Master Fund", "Feeder Fund Ltd.", "Holdings (UK) Ltd", "& Söhne GmbH", "Capital Partners LP", "Société S.A."]
PROVENANCE = {"source_file": "'test.zip'", "snapshot_date": "'2024-06-30'", "ingested_at": "'2024-07-01'"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with(df: DataFrame, columns: dict[str, str], provenance: bool = True) -> DataFrame:
    return df.selectExpr(*[f"{sql} AS {n}" for n, sql in (columns | (PROVENANCE if provenance else {})).items()])


def raw_names(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """(p_partkey, name): names with punctuation, marks, legal forms and numbers."""
    options = "array(" + ", ".join(f"'{s}'" for s in SUFFIXES) + ")"
    part = table(spark, sf_dir, "part")
    part = part.repartition(tasks(part), "p_partkey") if spread else part
    return part.selectExpr("p_partkey", f"concat(initcap(p_name), ' ', p_brand, ' ', {options}[int(p_partkey % 10)]) AS name", "p_size", "p_retailprice")


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with the columns that matching, the graph and the documents read."""
    return _register(raw_names(spark, sf_dir))


def stored_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that are searched, written: a register is a table, so its names are not made anew by each reader.

    The file is small for its rows and would be read by one task.
    """
    df = _register(raw_names(spark, sf_dir, spread=True))
    return cut_lineage(df.select(*[c for c in CANDIDATE_FIELDS if c in df.columns]))


def _register(raw: DataFrame) -> DataFrame:
    df = names.with_name_fields(raw.withColumnRenamed("name", "legal_name"), "legal_name")
    return df.selectExpr(
        "concat('LEI', lpad(string(p_partkey), 15, '0'), '00') AS lei", "legal_name", "legal_name_norm", "legal_name_core", "name_tokens", "fund_number", "is_master", "is_feeder", "is_offshore", "is_domestic",
        "CASE WHEN p_partkey % 4 = 0 THEN array(concat('alias ', legal_name_norm)) ELSE array() END AS aliases_norm", "CASE p_partkey % 5 WHEN 0 THEN 'GB' WHEN 1 THEN 'US-DE' WHEN 2 THEN 'KY' WHEN 3 THEN 'GB-ENG' END AS jurisdiction",
        "CASE p_partkey % 5 WHEN 0 THEN 'GB' WHEN 1 THEN 'US' WHEN 2 THEN 'KY' WHEN 3 THEN 'GB' END AS legal_country", "CASE WHEN p_partkey % 3 = 0 THEN concat('EC', string(p_partkey % 9), 'N4AG') END AS legal_postcode", "CASE WHEN p_partkey % 2 = 0 THEN 'london' END AS legal_city",
        "CASE WHEN p_partkey % 6 = 0 THEN concat('R', string(p_partkey)) END AS registration_id", "CASE WHEN p_partkey % 7 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS entity_status", "'GENERAL' AS entity_category", "CASE WHEN p_partkey % 50 = 0 THEN concat('LEI', lpad(string(p_partkey + 1), 15, '0'), '00') END AS successor_lei",
        "'2001-01-01' AS entity_creation_date", "'2013-01-01' AS initial_registration_date", "'2024-01-01' AS last_update_date", "'2025-01-01' AS next_renewal_date", "'ISSUED' AS registration_status", *[f"{sql} AS {n}" for n, sql in PROVENANCE.items()],
    )


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """All tables in their roles, by the names that graph, documents and reads look up."""
    t = cache(lambda n: table(spark, sf_dir, n))
    day = "date_add(add_months(o_orderdate, 312), int(o_orderkey % 40))"
    quarter = "last_day(add_months(trunc(add_months(o_orderdate, 312), 'QUARTER'), 2))"
    text = lambda d: f"upper(date_format({d}, 'dd-MMM-yyyy'))"
    filings = lambda: _with(t("orders"), {
        "accession_number": "concat('A', o_orderkey)", "filing_date": text(day), "cik": "lpad(string(o_custkey), 10, '0')", "period_of_report": text(quarter), "is_amendment": "o_orderkey % 3 <> 0",
        "amendment_type": "CASE o_orderkey % 6 WHEN 1 THEN 'RESTATEMENT' WHEN 2 THEN 'NEW HOLDINGS' WHEN 4 THEN 'restatement ' WHEN 5 THEN 'OTHER' END", "filer_name": "concat('Filer ', o_custkey, ' v', o_orderkey % 3)", "crd_number": "string(o_custkey * 7)",
        "filer_city": "'London'", "filer_state_or_country": "CASE o_custkey % 3 WHEN 0 THEN 'NY' WHEN 1 THEN 'X0' ELSE 'ca' END", "filer_zipcode": "'10001'",
    })
    holdings = lambda: _with(t("lineitem"), {
        "accession_number": "concat('A', l_orderkey)", "infotable_sk": "string(l_linenumber)", "name_of_issuer": "concat('Issuer ', l_partkey)", "title_of_class": "'COM'", "cusip": "lpad(string(l_partkey % 400), 9, '0')", "value": "bigint(round(l_extendedprice / CASE WHEN l_orderkey % 97 = 0 THEN 1000 ELSE 1 END))",
        "shares_or_principal_amount": "l_quantity", "shares_or_principal_type": "CASE WHEN l_linenumber = 6 THEN 'PRN' ELSE 'SH' END", "put_call": "CASE WHEN l_linenumber = 7 THEN 'PUT' END",
    })
    summaries = lambda: t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.expr("bigint(round(l_extendedprice / CASE WHEN l_orderkey % 97 = 0 THEN 1000 ELSE 1 END))")).alias("v")).where("l_orderkey % 41 <> 0").selectExpr(
        "concat('A', l_orderkey) AS accession_number", "CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE n END AS declared_entry_total", "CASE WHEN l_orderkey % 29 = 0 THEN v + 1 ELSE v END AS declared_value_total"
    )
    ownership = lambda: _with(t("orders").where("o_orderkey % 5 = 0"), {
        "accession_number": "concat('G', o_orderkey)", "form_type": "CASE WHEN o_orderkey % 2 = 0 THEN 'SCHEDULE 13D' ELSE 'SCHEDULE 13G/A' END", "filing_intent": "CASE WHEN o_orderkey % 2 = 0 THEN 'ACTIVE' ELSE 'PASSIVE' END", "filing_date": f"date_format({day}, 'yyyy-MM-dd')", "event_date": "date_format(add_months(o_orderdate, 312), 'yyyy-MM-dd')",
        "issuer_cik": "lpad(string(o_custkey % 50), 10, '0')", "issuer_name": "concat('Issuer ', o_custkey % 50)", "issuer_cusip": "CASE WHEN o_orderkey % 3 = 0 THEN lpad(string(o_custkey % 50), 9, '0') END", "person_index": "int(o_orderkey % 3 + 1)", "reporting_person_cik": "CASE WHEN o_orderkey % 11 <> 0 THEN lpad(string(o_custkey), 10, '0') END",
        "reporting_person_name": "concat('Person ', o_custkey)", "reporting_person_type": "CASE WHEN o_custkey % 2 = 0 THEN 'IN' ELSE 'IA' END", "aggregate_shares": "double(o_orderkey * 10)", "percent_of_class": "CASE WHEN o_orderkey % 13 <> 0 THEN double(o_orderkey % 400) / 20 END",
    })
    relationships = lambda: _with(t("part"), {
        "start_node_id": "concat('LEI', lpad(string(p_partkey), 15, '0'), '00')", "end_node_id": "concat('LEI', lpad(string(p_partkey DIV 7), 15, '0'), '00')", "relationship_type": "CASE p_partkey % 4 WHEN 0 THEN 'IS_DIRECTLY_CONSOLIDATED_BY' WHEN 1 THEN 'IS_FUND-MANAGED_BY' WHEN 2 THEN 'IS_SUBFUND_OF' ELSE 'IS_SPECIAL' END",
        "relationship_status": "CASE WHEN p_partkey % 9 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END", "start_date": "'2010-01-01'", "end_date": "CAST(NULL AS STRING)",
    })
    exceptions = lambda: _with(t("part").where("p_partkey % 3 = 0"), {"lei": "concat('LEI', lpad(string(p_partkey), 15, '0'), '00')", "exception_category": "CASE WHEN p_partkey % 2 = 0 THEN 'DIRECT_ACCOUNTING_CONSOLIDATION_PARENT' ELSE 'ULTIMATE_ACCOUNTING_CONSOLIDATION_PARENT' END", "exception_reason": "CASE WHEN p_partkey % 5 = 0 THEN 'NATURAL_PERSONS' ELSE 'OTHER' END"})
    isins = lambda: _with(t("lineitem").where("l_linenumber <= 2"), {"isin": "concat('US', lpad(string(l_orderkey), 9, '0'), string(l_linenumber))", "lei": "concat('LEI', lpad(string(l_partkey), 15, '0'), '00')"})
    funds = lambda: _with(t("orders"), {
        "accession_number": "concat('N', o_orderkey)", "filing_date": text(day), "report_date": text(quarter), "cik": "lpad(string(o_custkey % 40), 10, '0')", "registrant_name": "concat('Trust ', o_custkey % 40)", "registrant_lei": "CASE WHEN o_custkey % 40 <> 7 THEN concat('T', o_custkey % 40) END",
        "series_id": "concat('S', o_custkey)", "series_name": "concat('Series ', o_custkey)", "series_lei": "CASE WHEN o_custkey % 3 <> 0 THEN concat('SL', o_custkey) END", "total_assets": "o_totalprice", "total_liabilities": "o_totalprice / 4", "net_assets": "o_totalprice * 3 / 4",
    })
    fund_holdings = lambda: _with(t("lineitem"), {
        "accession_number": "concat('N', l_orderkey)", "holding_id": "concat(l_orderkey, '-', l_linenumber)", "issuer_name": "concat('Issuer ', l_partkey)", "issuer_lei": "CASE WHEN l_partkey % 2 = 0 THEN concat('LEI', lpad(string(l_partkey), 15, '0'), '00') END", "issuer_title": "CAST(NULL AS STRING)", "issuer_cusip": "CASE WHEN l_partkey % 5 <> 0 THEN lpad(string(l_partkey % 400), 9, '0') END",
        "isin": "CAST(NULL AS STRING)", "balance": "l_quantity", "unit": "'NS'", "currency_code": "'USD'", "currency_value": "CASE WHEN l_linenumber <> 3 THEN l_extendedprice END", "percentage": "l_discount", "payoff_profile": "'Long'", "asset_category": "'EC'",
    })
    series = lambda: _with(t("customer"), {"cik": "lpad(string(c_custkey % 40), 10, '0')", "entity_name": "concat('Trust ', c_custkey % 40)", "series_id": "CASE WHEN c_custkey % 17 = 0 THEN '' ELSE concat('S', c_custkey DIV 3) END", "series_name": "concat('Series ', c_custkey DIV 3)", "class_id": "CASE WHEN c_custkey % 19 <> 0 THEN concat('C', c_custkey) END", "class_name": "concat('Class ', c_custkey % 3)", "class_ticker": "CASE WHEN c_custkey % 4 <> 0 THEN concat('tk', c_custkey % 100) END"})
    figi = lambda: _with(t("part"), {
        "cusip": "lpad(string(p_partkey % 400), 9, '0')", "mapping_rank": "int(p_partkey DIV 400 + 1)", "figi": "CASE WHEN p_partkey % 400 < 390 THEN concat('F', p_partkey) END", "name": "p_name", "ticker": "CASE WHEN p_partkey % 6 <> 0 THEN concat('t', p_partkey % 400) END", "exchange_code": "CASE WHEN p_partkey % 3 = 0 THEN 'US' ELSE 'LN' END", "market_sector": "'Equity'",
        "security_type": "'Common'", "security_type_2": "'Common'", "share_class_figi": "CASE WHEN p_partkey % 400 < 200 THEN concat('SC', p_partkey % 400) WHEN p_partkey % 400 < 300 THEN concat('SC', p_partkey % 800) END", "composite_figi": "CASE WHEN p_partkey % 2 = 0 THEN concat('CF', p_partkey % 1200) END", "error": "CASE WHEN p_partkey % 400 >= 390 THEN 'No identifier found.' END",
    })
    xbrl = lambda: _with(t("events"), {
        "cik": "lpad(string(user_id % 20), 10, '0')", "entity_name": "concat('Issuer ', user_id % 20)", "tag": "CASE event_type WHEN 'click' THEN 'Assets' WHEN 'view' THEN 'LiabilitiesAndStockholdersEquity' WHEN 'error' THEN 'AssetsCurrent' ELSE 'LiabilitiesCurrent' END", "unit": "'USD'", "period_start": "CAST(NULL AS STRING)",
        "period_end": "date_format(date_trunc('WEEK', ts), 'yyyy-MM-dd')", "fiscal_year": "2024L", "fiscal_period": "'Q1'", "form": "'10-Q'", "filed": "date_format(date_add(ts, int(event_id % 10)), 'yyyy-MM-dd')", "accession_number": "concat('X', lpad(string(event_id), 8, '0'))", "frame": "CAST(NULL AS STRING)", "value": "value",
    })
    crosswalk = lambda: _with(t("customer"), {
        "filer_name": "concat('Filer ', c_custkey)", "cik": "lpad(string(c_custkey), 10, '0')", "lei": "CASE WHEN c_custkey % 8 <> 0 THEN concat('LEI', lpad(string(c_custkey), 15, '0'), '00') END", "decision": "CASE WHEN c_custkey % 8 = 0 THEN 'UNMATCHED' WHEN c_custkey % 3 = 0 THEN 'REVIEW' ELSE 'AUTO_MATCH' END", "score": "double(100 + c_custkey % 150)",
        "gap": "CASE WHEN c_custkey % 4 <> 0 THEN double(c_custkey % 60) END", "reason": "CAST(NULL AS STRING)", "runner_up_lei": "CASE WHEN c_custkey % 4 <> 0 THEN concat('LEI', lpad(string(c_custkey + 1), 15, '0'), '00') END", "runner_up_score": "double(50)",
        "feature_contributions": "concat('{\"name_exact\":', 100 + c_custkey % 5, '.0,\"name_ratio\":', c_custkey % 40, '.5}')", "config_hash": "'abc'",
    })
    reviews = lambda: t("orders").where("o_orderkey % 10 = 0").selectExpr("concat('cik:', lpad(string(o_custkey), 10, '0')) AS node_id", "concat('LEI', lpad(string(o_custkey), 15, '0'), '00') AS lei", "CASE o_orderkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'Rejected' ELSE 'UNSURE' END AS outcome", "concat('r', o_orderkey % 7) AS reviewer", "date_format(o_orderdate, 'yyyy-MM-dd') AS reviewed_at", "CASE WHEN o_orderkey % 4 = 0 THEN 'looked' END AS rationale", "int(o_orderkey) AS line_no")
    return Catalog(spark, tables={
        "sec_13f_filings": filings, "sec_13f_holdings": holdings, "sec_13f_summaries": summaries, "sec_13dg_ownership": ownership, "gleif_entities": lambda: register(spark, sf_dir), "gleif_relationships": relationships, "gleif_relationship_exceptions": exceptions, "isin_lei": isins, "nport_funds": funds,
        "nport_holdings": fund_holdings, "sec_series_classes": series, "openfigi_mappings": figi, "sec_xbrl_facts": xbrl, "crosswalk_sec_13f_gleif": crosswalk, "match_reviews": reviews,
    })


_SUFFIX_SQL = "[" + ", ".join(f"'{s}'" for s in SUFFIXES) + "]"
_LEI = "'LEI' || lpad({}::VARCHAR, 15, '0') || '00'"
#: The same tables as common table expressions; name normalisation is spelled out in SQL as well.
_NORM = "trim(regexp_replace(replace(regexp_replace(regexp_replace(lower(strip_accents(replace(name, 'ß', 'ss'))), '[.''’]', '', 'g'), '[,()\\[\\]/\\\\-]', ' ', 'g'), '&', ' and '), '\\s+', ' ', 'g'))"
_FORMS = "|".join(names.LEGAL_SUFFIXES)
SQL = {
    "raw_names": f"SELECT p_partkey, (SELECT string_agg(upper(w[1]) || w[2:], ' ') FROM (SELECT unnest(string_split(p_name, ' ')) AS w)) || ' ' || p_brand || ' ' || {_SUFFIX_SQL}[p_partkey % 10 + 1] AS name, p_size, p_retailprice FROM part",
    "norms": f"SELECT *, {_NORM} AS norm FROM raw_names",
    "cores": f"SELECT *, regexp_replace(norm, '((^| )({_FORMS}))+$', '') AS core, string_split(norm, ' ') AS tokens FROM norms",
    "register": f"""SELECT {_LEI.format('p_partkey')} AS lei, p_partkey, name AS legal_name, norm AS legal_name_norm, core AS legal_name_core,
      CASE WHEN regexp_extract(core, '[^ ]+$') SIMILAR TO '[0-9]{{1,3}}' THEN regexp_extract(core, '[^ ]+$')::INT ELSE nullif(coalesce(list_position([{', '.join(f"'{r}'" for r in names.ROMAN)}], regexp_extract(core, '[^ ]+$')), 0), 0) END AS fund_number,
      list_contains(tokens, 'master') AS is_master, list_contains(tokens, 'feeder') AS is_feeder, CASE WHEN p_partkey % 4 = 0 THEN 'alias ' || norm ELSE '' END AS aliases,
      CASE p_partkey % 5 WHEN 0 THEN 'GB' WHEN 1 THEN 'US-DE' WHEN 2 THEN 'KY' WHEN 3 THEN 'GB-ENG' END AS jurisdiction, CASE p_partkey % 5 WHEN 0 THEN 'GB' WHEN 1 THEN 'US' WHEN 2 THEN 'KY' WHEN 3 THEN 'GB' END AS legal_country,
      CASE WHEN p_partkey % 7 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS entity_status, CASE WHEN p_partkey % 50 = 0 THEN {_LEI.format('(p_partkey + 1)')} END AS successor_lei FROM cores""",
    "filings": "SELECT o_orderkey, 'A' || o_orderkey AS accession_number, (o_orderdate + INTERVAL 312 MONTH)::DATE + (o_orderkey % 40)::INT AS filed, lpad(o_custkey::VARCHAR, 10, '0') AS cik, last_day((date_trunc('quarter', o_orderdate + INTERVAL 312 MONTH) + INTERVAL 2 MONTH)::DATE) AS period, o_orderkey % 3 <> 0 AS is_amendment, o_orderkey % 6 AS k, 'Filer ' || o_custkey || ' v' || o_orderkey % 3 AS filer_name, o_custkey FROM orders",
    "holdings": "SELECT l_orderkey, 'A' || l_orderkey AS accession_number, l_linenumber::VARCHAR AS infotable_sk, 'Issuer ' || l_partkey AS name_of_issuer, lpad((l_partkey % 400)::VARCHAR, 9, '0') AS cusip, round(l_extendedprice / CASE WHEN l_orderkey % 97 = 0 THEN 1000 ELSE 1 END)::BIGINT AS value, l_quantity AS shares, CASE WHEN l_linenumber = 6 THEN 'PRN' ELSE 'SH' END AS kind, CASE WHEN l_linenumber = 7 THEN 'PUT' END AS put_call FROM lineitem",
    "observed": "SELECT accession_number, l_orderkey, count(*) AS n, sum(value)::BIGINT AS v FROM holdings GROUP BY ALL",
    "validations": """SELECT o.accession_number, CASE WHEN o.l_orderkey % 23 = 0 THEN NULL ELSE n END AS declared_entry_total, n AS observed_entry_total, CASE WHEN o.l_orderkey % 29 = 0 THEN v + 1 ELSE v END AS declared_value_total, v AS observed_value_total,
      CASE WHEN f.filed >= DATE '2023-01-03' THEN 'USD' ELSE 'USD_THOUSANDS' END AS value_unit, CASE WHEN NOT coalesce(is_amendment, false) THEN 'ORIGINAL' WHEN k IN (1, 4) THEN 'REPLACE' WHEN k = 2 THEN 'APPEND' ELSE 'UNKNOWN' END AS action, f.filed
      FROM observed o LEFT JOIN filings f ON o.accession_number = f.accession_number WHERE o.l_orderkey % 41 <> 0""",
    "checked": """SELECT *, array_to_string(list_filter([CASE WHEN declared_entry_total IS DISTINCT FROM observed_entry_total THEN 'TABLE_ENTRY_TOTAL_MISMATCH' END, CASE WHEN declared_value_total IS DISTINCT FROM observed_value_total THEN 'TABLE_VALUE_TOTAL_MISMATCH' END,
      CASE WHEN action = 'UNKNOWN' THEN 'UNKNOWN_AMENDMENT_TYPE' END, CASE WHEN filed IS NULL THEN 'UNPARSEABLE_FILING_DATE' END], lambda x: x IS NOT NULL), ',') AS errors FROM validations""",
    "accepted": "SELECT f.*, c.action, c.value_unit FROM filings f JOIN checked c ON f.accession_number = c.accession_number WHERE c.errors = ''",
    "anchors": "SELECT cik, period, arg_max(accession_number, struct_pack(a := filed, b := accession_number)) AS anchor, max(filed) AS day FROM accepted WHERE action IN ('ORIGINAL', 'REPLACE') GROUP BY ALL",
    "included": "SELECT a.accession_number, a.cik, a.period, a.value_unit FROM accepted a JOIN anchors n ON a.cik = n.cik AND a.period = n.period WHERE a.accession_number = n.anchor OR a.action = 'APPEND' AND a.filed >= n.day",
    "effective": "SELECT h.*, i.cik, i.period, i.value_unit, CASE WHEN i.value_unit = 'USD' THEN h.value ELSE h.value * 1000 END AS value_usd FROM holdings h JOIN included i ON h.accession_number = i.accession_number",
    "relationships": f"SELECT {_LEI.format('p_partkey')} AS s, {_LEI.format('(p_partkey // 7)')} AS e, CASE p_partkey % 4 WHEN 0 THEN 'IS_DIRECTLY_CONSOLIDATED_BY' WHEN 1 THEN 'IS_FUND-MANAGED_BY' WHEN 2 THEN 'IS_SUBFUND_OF' ELSE 'IS_SPECIAL' END AS t, CASE WHEN p_partkey % 9 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status FROM part",
    "ownership": "SELECT o_orderkey, 'G' || o_orderkey AS accession_number, o_orderkey % 2 = 0 AS long, (o_orderdate + INTERVAL 312 MONTH)::DATE + (o_orderkey % 40)::INT AS filed, strftime(o_orderdate + INTERVAL 312 MONTH, '%Y-%m-%d') AS event_date, lpad((o_custkey % 50)::VARCHAR, 10, '0') AS issuer_cik, 'Issuer ' || o_custkey % 50 AS issuer_name, CASE WHEN o_orderkey % 3 = 0 THEN lpad((o_custkey % 50)::VARCHAR, 9, '0') END AS cusip, (o_orderkey % 3 + 1)::INT AS person_index, CASE WHEN o_orderkey % 11 <> 0 THEN lpad(o_custkey::VARCHAR, 10, '0') END AS person_cik, 'Person ' || o_custkey AS person, o_custkey % 2 = 0 AS individual, (o_orderkey * 10)::DOUBLE AS shares, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 400)::DOUBLE / 20 END AS pct FROM orders WHERE o_orderkey % 5 = 0",
    "funds": "SELECT 'N' || o_orderkey AS accession_number, (o_orderdate + INTERVAL 312 MONTH)::DATE + (o_orderkey % 40)::INT AS filed, last_day((date_trunc('quarter', o_orderdate + INTERVAL 312 MONTH) + INTERVAL 2 MONTH)::DATE) AS report, CASE WHEN o_custkey % 40 <> 7 THEN 'T' || o_custkey % 40 END AS registrant_lei, 'S' || o_custkey AS series_id, CASE WHEN o_custkey % 3 <> 0 THEN 'SL' || o_custkey END AS series_lei, o_totalprice FROM orders",
    "fund_holdings": "SELECT 'N' || l_orderkey AS accession_number, l_orderkey || '-' || l_linenumber AS holding_id, CASE WHEN l_partkey % 5 <> 0 THEN lpad((l_partkey % 400)::VARCHAR, 9, '0') END AS cusip, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS v, l_quantity AS balance, l_discount AS pct FROM lineitem",
    "crosswalk": f"SELECT c_custkey, lpad(c_custkey::VARCHAR, 10, '0') AS cik, CASE WHEN c_custkey % 8 <> 0 THEN {_LEI.format('c_custkey')} END AS lei, CASE WHEN c_custkey % 8 = 0 THEN 'UNMATCHED' WHEN c_custkey % 3 = 0 THEN 'REVIEW' ELSE 'AUTO_MATCH' END AS decision, (100 + c_custkey % 150)::DOUBLE AS score, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 60)::DOUBLE END AS gap FROM customer",
    "reviews": f"SELECT 'cik:' || lpad(o_custkey::VARCHAR, 10, '0') AS node_id, {_LEI.format('o_custkey')} AS lei, CASE o_orderkey % 3 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'REJECTED' ELSE 'UNSURE' END AS outcome, 'r' || o_orderkey % 7 AS reviewer, strftime(o_orderdate, '%Y-%m-%d') AS reviewed_at, CASE WHEN o_orderkey % 4 = 0 THEN 'looked' END AS rationale, o_orderkey AS line_no FROM orders WHERE o_orderkey % 10 = 0",
    "last_reviews": "SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY node_id, lei ORDER BY reviewed_at DESC, line_no DESC) = 1",
    "xbrl": "SELECT lpad((user_id % 20)::VARCHAR, 10, '0') AS cik, CASE event_type WHEN 'click' THEN 'Assets' WHEN 'view' THEN 'LiabilitiesAndStockholdersEquity' WHEN 'error' THEN 'AssetsCurrent' ELSE 'LiabilitiesCurrent' END AS tag, strftime(date_trunc('week', ts), '%Y-%m-%d') AS period_end, strftime(ts::DATE + (event_id % 10)::INT, '%Y-%m-%d') AS filed, 'X' || lpad(event_id::VARCHAR, 8, '0') AS accession_number, value FROM events",
    "series": "SELECT c_custkey, lpad((c_custkey % 40)::VARCHAR, 10, '0') AS cik, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'S' || c_custkey // 3 END AS series_id, CASE WHEN c_custkey % 19 <> 0 THEN 'C' || c_custkey END AS class_id, CASE WHEN c_custkey % 4 <> 0 THEN 'tk' || c_custkey % 100 END AS ticker FROM customer",
    "figi": "SELECT lpad((p_partkey % 400)::VARCHAR, 9, '0') AS cusip, CASE WHEN p_partkey % 400 < 390 THEN 'F' || p_partkey END AS figi, CASE WHEN p_partkey % 6 <> 0 THEN 't' || p_partkey % 400 END AS ticker, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'US' ELSE 'LN' END AS exchange, CASE WHEN p_partkey % 400 < 200 THEN 'SC' || p_partkey % 400 WHEN p_partkey % 400 < 300 THEN 'SC' || p_partkey % 800 END AS share_class, CASE WHEN p_partkey % 2 = 0 THEN 'CF' || p_partkey % 1200 END AS composite FROM part",
    "listed": "SELECT *, coalesce(share_class, composite, figi) AS k FROM figi WHERE figi IS NOT NULL",
}


def with_tables(sql: str) -> str:
    """sql with the tables that it needs in front."""
    import re

    need: list[str] = []

    def add(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text) and name not in need:
                add(SQL[name])
                need.append(name)

    add(sql)
    tables = ", ".join(f"{n} AS ({SQL[n]})" for n in need)
    if not need:
        return sql
    return f"WITH {tables}, {sql.strip()[5:]}" if sql.strip().upper().startswith("WITH ") else f"WITH {tables} {sql}"
