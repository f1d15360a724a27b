"""Quarterly data sets of tab-separated tables: holdings reports, fund reports, insiders' forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.catalog import with_provenance
from kinfold.functions import names
from kinfold.functions.columns import as_bigint, filing_date, yes
from kinfold.operators.filings import validate
from kinfold.operators.relational import union_by_name

from .common import pick, read_tsv, require

FUND_MEMBERS = ["SUBMISSION.tsv", "REGISTRANT.tsv", "FUND_REPORTED_INFO.tsv", "FUND_REPORTED_HOLDING.tsv", "IDENTIFIERS.tsv"]
#: Columns of a holdings report's cover page by ours.
COVER = {
    "is_amendment": "ISAMENDMENT", "amendment_no": "AMENDMENTNO", "amendment_type": "AMENDMENTTYPE", "filer_name": "FILINGMANAGER_NAME", "filer_street1": "FILINGMANAGER_STREET1", "filer_street2": "FILINGMANAGER_STREET2",
    "filer_city": "FILINGMANAGER_CITY", "filer_state_or_country": "FILINGMANAGER_STATEORCOUNTRY", "filer_zipcode": "FILINGMANAGER_ZIPCODE", "report_type": "REPORTTYPE", "form13f_file_number": "FORM13FFILENUMBER", "crd_number": "CRDNUMBER", "sec_file_number": "SECFILENUMBER",
}


def snapshot_of(submissions: DataFrame, otherwise: str) -> str:
    """The first filing day of a data set, else the name of its file."""
    day = submissions.agg(F.min(filing_date("FILING_DATE"))).first()[0]
    return str(day) if day else otherwise


def holdings_filings(spark: SparkSession, folder: str) -> DataFrame:
    head = pick(read_tsv(spark, f"{folder}/SUBMISSION.tsv"), {"accession_number": "ACCESSION_NUMBER", "filing_date": "FILING_DATE", "submission_type": "SUBMISSIONTYPE", "cik": "CIK", "period_of_report": "PERIODOFREPORT"})
    cover = pick(read_tsv(spark, f"{folder}/COVERPAGE.tsv"), {"accession_number": "ACCESSION_NUMBER", **COVER})
    rows = head.join(cover, "accession_number", "left").withColumns({"is_amendment": yes("is_amendment"), "filer_name": F.coalesce("filer_name", F.lit(""))})
    derived = names.name_fields("filer_name")
    return require(rows.withColumns({"filer_name_norm": derived["legal_name_norm"], "filer_name_core": derived["legal_name_core"]}), ["accession_number", "cik"])


def reported_holdings(spark: SparkSession, folder: str) -> DataFrame:
    t = read_tsv(spark, f"{folder}/INFOTABLE.tsv")
    number = {n: as_bigint(c) for n, c in (("value", "VALUE"), ("voting_auth_sole", "VOTING_AUTH_SOLE"), ("voting_auth_shared", "VOTING_AUTH_SHARED"), ("voting_auth_none", "VOTING_AUTH_NONE"))}
    return require(pick(t, {
        "accession_number": "ACCESSION_NUMBER", "infotable_sk": "INFOTABLE_SK", "name_of_issuer": "NAMEOFISSUER", "title_of_class": "TITLEOFCLASS", "cusip": "CUSIP", "figi": "FIGI", "value": number["value"],
        "shares_or_principal_amount": F.col("SSHPRNAMT").try_cast("double"), "shares_or_principal_type": "SSHPRNAMTTYPE", "put_call": "PUTCALL", "investment_discretion": "INVESTMENTDISCRETION", "other_manager": "OTHERMANAGER",
        **{n: c for n, c in number.items() if n != "value"},
    }), ["name_of_issuer"])


def holdings_validations(spark: SparkSession, folder: str, filings: DataFrame, holdings: DataFrame) -> DataFrame:
    t = read_tsv(spark, f"{folder}/SUMMARYPAGE.tsv")
    summaries = pick(t, {"accession_number": "ACCESSION_NUMBER", "declared_entry_total": as_bigint("TABLEENTRYTOTAL"), "declared_value_total": as_bigint("TABLEVALUETOTAL")})
    return validate(filings, summaries, holdings)


def other_managers(spark: SparkSession, folder: str) -> DataFrame:
    return pick(read_tsv(spark, f"{folder}/OTHERMANAGER.tsv"), {"accession_number": "ACCESSION_NUMBER", "other_manager_sk": "OTHERMANAGER_SK", "cik": "CIK", "form13f_file_number": "FORM13FFILENUMBER", "crd_number": "CRDNUMBER", "sec_file_number": "SECFILENUMBER", "name": "NAME"})


def holdings_reports(spark: SparkSession, folder: str, source_file: str, ingested_at: str) -> dict[str, DataFrame]:
    """All tables of a holdings data set, by name, with provenance."""
    from kinfold.operators.filings import effective_holdings, quarantine, scale_checks

    snapshot = snapshot_of(read_tsv(spark, f"{folder}/SUBMISSION.tsv"), source_file.rsplit(".", 1)[0])
    mark = lambda t: with_provenance(t, source_file, snapshot, ingested_at)
    filings, holdings = mark(holdings_filings(spark, folder)), mark(reported_holdings(spark, folder))
    checked = mark(holdings_validations(spark, folder, filings, holdings))
    effective = effective_holdings(filings, holdings, checked)
    return {
        "sec_13f_filings": filings, "sec_13f_holdings": holdings, "sec_13f_validations": checked, "sec_13f_quarantine": quarantine(checked), "sec_13f_other_managers": mark(other_managers(spark, folder)),
        "sec_13f_effective_holdings": effective, "sec_13f_scale_checks": scale_checks(effective),
    }


def fund_reports(spark: SparkSession, folder: str) -> DataFrame:
    number = lambda c: F.col(c).try_cast("double")
    head = pick(read_tsv(spark, f"{folder}/SUBMISSION.tsv"), {"accession_number": "ACCESSION_NUMBER", "filing_date": "FILING_DATE", "report_date": "REPORT_DATE"})
    registrant = pick(read_tsv(spark, f"{folder}/REGISTRANT.tsv"), {"accession_number": "ACCESSION_NUMBER", "cik": "CIK", "registrant_name": "REGISTRANT_NAME", "registrant_lei": "LEI"})
    info = pick(read_tsv(spark, f"{folder}/FUND_REPORTED_INFO.tsv"), {"accession_number": "ACCESSION_NUMBER", "series_id": "SERIES_ID", "series_name": "SERIES_NAME", "series_lei": "SERIES_LEI", "total_assets": number("TOTAL_ASSETS"), "total_liabilities": number("TOTAL_LIABILITIES"), "net_assets": number("NET_ASSETS")})
    return head.join(registrant, "accession_number", "left").join(info, "accession_number", "left")


def fund_holdings(spark: SparkSession, folder: str) -> DataFrame:
    """Holdings with their greatest ISIN and ticker, reduced before the join; rows alike in all columns are one."""
    number = lambda c: F.col(c).try_cast("double")
    ids = pick(read_tsv(spark, f"{folder}/IDENTIFIERS.tsv"), {"holding_id": "HOLDING_ID", "isin": "IDENTIFIER_ISIN", "ticker": "IDENTIFIER_TICKER"}).groupBy("holding_id").agg(F.max("isin").alias("isin"), F.max("ticker").alias("ticker"))
    rows = pick(read_tsv(spark, f"{folder}/FUND_REPORTED_HOLDING.tsv"), {
        "accession_number": "ACCESSION_NUMBER", "holding_id": "HOLDING_ID", "issuer_name": "ISSUER_NAME", "issuer_lei": "ISSUER_LEI", "issuer_title": "ISSUER_TITLE", "issuer_cusip": "ISSUER_CUSIP", "balance": number("BALANCE"), "unit": "UNIT", "currency_code": "CURRENCY_CODE",
        "currency_value": number("CURRENCY_VALUE"), "exchange_rate": number("EXCHANGE_RATE"), "percentage": number("PERCENTAGE"), "payoff_profile": "PAYOFF_PROFILE", "asset_category": "ASSET_CAT", "issuer_type": "ISSUER_TYPE", "investment_country": "INVESTMENT_COUNTRY", "fair_value_level": "FAIR_VALUE_LEVEL", "derivative_category": "DERIVATIVE_CAT",
    })
    return rows.distinct().join(ids, "holding_id", "left")


def observed_issuers(holdings: DataFrame) -> DataFrame:
    """Distinct links of a security to its issuer's LEI, where the identifiers have their proper shape."""
    shaped = holdings.where("issuer_lei RLIKE '^[A-Z0-9]{20}$' AND (issuer_cusip RLIKE '^[A-Z0-9]{9}$' OR isin RLIKE '^[A-Z0-9]{12}$')")
    return shaped.select(F.col("issuer_cusip").alias("cusip"), "isin", "issuer_lei", "issuer_name", "source_file", "snapshot_date", "ingested_at").distinct()


def _insider_heads(spark: SparkSession, folder: str) -> DataFrame:
    head = pick(read_tsv(spark, f"{folder}/SUBMISSION.tsv"), {"accession_number": "ACCESSION_NUMBER", "filing_date": "FILING_DATE", "period_of_report": "PERIOD_OF_REPORT", "document_type": "DOCUMENT_TYPE", "issuer_cik": "ISSUERCIK", "issuer_name": "ISSUERNAME", "issuer_ticker": "ISSUERTRADINGSYMBOL"})
    owner = pick(read_tsv(spark, f"{folder}/REPORTINGOWNER.tsv"), {"accession_number": "ACCESSION_NUMBER", "owner_cik": "RPTOWNERCIK", "owner_name": "RPTOWNERNAME", "relationship": "RPTOWNER_RELATIONSHIP", "owner_title": "RPTOWNER_TITLE"})
    return head.join(owner, "accession_number")


def insider_relationships(spark: SparkSession, folder: str) -> DataFrame:
    return _insider_heads(spark, folder)


def insider_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions in shares and in derivatives, once for each owner of the filing."""
    number = lambda c: F.col(c).try_cast("double")
    parts = []
    for table, key, derivative in (("NONDERIV_TRANS", "NONDERIV_TRANS_SK", False), ("DERIV_TRANS", "DERIV_TRANS_SK", True)):
        parts.append(pick(read_tsv(spark, f"{folder}/{table}.tsv"), {
            "accession_number": "ACCESSION_NUMBER", "transaction_id": key, "security_title": "SECURITY_TITLE", "transaction_date": "TRANS_DATE", "transaction_code": "TRANS_CODE", "acquired_disposed": "TRANS_ACQUIRED_DISP_CD", "shares": number("TRANS_SHARES"),
            "price_per_share": number("TRANS_PRICEPERSHARE"), "shares_following": number("SHRS_OWND_FOLWNG_TRANS"), "direct_indirect": "DIRECT_INDIRECT_OWNERSHIP", "derivative": F.lit(derivative),
        }))
    return union_by_name(parts).join(_insider_heads(spark, folder).select("accession_number", "owner_cik", "issuer_cik"), "accession_number")
