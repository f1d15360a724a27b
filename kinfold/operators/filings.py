"""Accounting of holdings reports: reconciliation, quarantine, amendments and the scale of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.config import ScaleCheck
from kinfold.functions.columns import any_date, col, filing_date, latest_value, same_or_both_null, some_value

#: Reports filed from this day on state values in dollars, earlier ones in thousands.
DOLLARS_SINCE = "2023-01-03"


def amendment_action(is_amendment: Column | str, amendment_type: Column | str) -> Column:
    kind = F.upper(F.trim(F.coalesce(col(amendment_type), F.lit(""))))
    return F.when(~F.coalesce(col(is_amendment), F.lit(False)), "ORIGINAL").when(kind == "RESTATEMENT", "REPLACE").when(kind == "NEW HOLDINGS", "APPEND").otherwise("UNKNOWN")


def value_unit(filed: Column | str) -> Column:
    return F.when(any_date(filed) >= F.lit(DOLLARS_SINCE).cast("date"), "USD").otherwise("USD_THOUSANDS")


def validate(filings: DataFrame, summaries: DataFrame, holdings: DataFrame) -> DataFrame:
    """A row for each summary: totals declared and observed, unit, amendment action, errors, valid.

    Two missing totals agree. Sums are made in decimals, so large filings cannot overflow before the comparison.
    """
    observed = holdings.groupBy("accession_number").agg(F.count("*").alias("observed_entry_total"), F.coalesce(F.sum(F.col("value").cast("decimal(38,0)")), F.lit(0)).cast("bigint").alias("observed_value_total"))
    rows = summaries.join(filings.select("accession_number", "filing_date", "is_amendment", "amendment_type"), "accession_number", "left").join(observed, "accession_number", "left")
    rows = rows.fillna(0, ["observed_entry_total", "observed_value_total"])
    rows = rows.withColumns({
        "row_count_matches": same_or_both_null("declared_entry_total", "observed_entry_total"),
        "value_total_matches": same_or_both_null("declared_value_total", "observed_value_total"),
        "amendment_action": amendment_action("is_amendment", "amendment_type"),
        "value_unit": value_unit("filing_date"),
    })
    rules = [
        (~F.col("row_count_matches"), "TABLE_ENTRY_TOTAL_MISMATCH"),
        (~F.col("value_total_matches"), "TABLE_VALUE_TOTAL_MISMATCH"),
        (F.col("amendment_action") == "UNKNOWN", "UNKNOWN_AMENDMENT_TYPE"),
        (any_date("filing_date").isNull(), "UNPARSEABLE_FILING_DATE"),
    ]
    errors = F.filter(F.array(*[F.when(broken, F.lit(code)) for broken, code in rules]), lambda e: e.isNotNull())
    return rows.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0).drop("filing_date", "is_amendment", "amendment_type")


def quarantine(validations: DataFrame) -> DataFrame:
    return validations.where(~F.col("valid"))


def effective_holdings(filings: DataFrame, holdings: DataFrame, validations: DataFrame) -> DataFrame:
    """Holdings that stand for each filer and period, with value_usd.

    The newest valid original or restatement is the anchor; valid additions filed on its day or later join it. Without
    an anchor, or without a summary, nothing counts. Filings are few beside holdings, which are shuffled once.
    """
    accepted = filings.join(validations.where("valid").select("accession_number", "amendment_action", "value_unit"), "accession_number")
    accepted = accepted.select("accession_number", "cik", "period_of_report", "amendment_action", "value_unit", filing_date("filing_date").alias("filed"))
    anchors = accepted.where("amendment_action IN ('ORIGINAL', 'REPLACE')").groupBy("cik", "period_of_report").agg(
        F.max_by("accession_number", F.struct("filed", "accession_number")).alias("anchor"), F.max("filed").alias("anchor_date")
    )
    included = accepted.join(anchors, ["cik", "period_of_report"]).where("accession_number = anchor OR amendment_action = 'APPEND' AND filed >= anchor_date")
    included = included.select("accession_number", "cik", "period_of_report", "value_unit")
    usd = F.when(F.col("value_unit") == "USD_THOUSANDS", F.col("value") * 1000).otherwise(F.col("value"))
    return holdings.join(included, "accession_number").withColumn("value_usd", usd)


def scale_checks(effective: DataFrame, cfg: ScaleCheck | None = None) -> DataFrame:
    """Filings stated in dollars whose prices sit near a thousandth of other filers'; nothing is rescaled.

    A security's price is the exact median over filers of the period, if there are enough of them.
    """
    cfg = cfg or ScaleCheck()
    shares = F.col("shares_or_principal_amount")
    counted = effective.where("value_unit = 'USD' AND put_call IS NULL AND shares_or_principal_type = 'SH' AND shares_or_principal_amount > 0 AND value_usd > 0")
    priced = counted.select("accession_number", "cik", "period_of_report", "cusip", (F.col("value_usd") / shares).alias("price"))
    consensus = priced.groupBy("period_of_report", "cusip").agg(F.median("price").alias("usual"), F.countDistinct("cik").alias("filers")).where(F.col("filers") >= cfg.min_filers)
    ratios = priced.join(consensus, ["period_of_report", "cusip"]).withColumn("ratio", F.col("price") / F.col("usual"))
    checked = ratios.groupBy("accession_number").agg(some_value("cik").alias("cik"), some_value("period_of_report").alias("period_of_report"), F.count("*").alias("compared_rows"), F.median("ratio").alias("median_price_ratio"))
    return checked.withColumn("looks_like_thousands", (F.col("compared_rows") >= cfg.min_rows) & F.col("median_price_ratio").between(cfg.low, cfg.high))


def newest_name(filings: DataFrame) -> DataFrame:
    """(cik, filer_name) by the latest filing."""
    return filings.groupBy("cik").agg(latest_value("filer_name", filing_date("filing_date")).alias("filer_name"))
