"""Sources of documents: ownership schedules, XBRL facts, security mappings, brochures and their pages, reviews."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions.columns import blank_to_null, us_date
from kinfold.functions.places import clean_cusip, pad_cik_or_null
from kinfold.operators.relational import first_per_key, top_values

from .common import pick, read_csv

#: Concepts that are kept of a company's facts.
XBRL_TAGS = "Assets AssetsCurrent Liabilities LiabilitiesCurrent LiabilitiesAndStockholdersEquity StockholdersEquity CashAndCashEquivalentsAtCarryingValue Revenues RevenueFromContractWithCustomerExcludingAssessedTax NetIncomeLoss OperatingIncomeLoss GrossProfit EarningsPerShareBasic EarningsPerShareDiluted LongTermDebt EntityCommonStockSharesOutstanding".split()
TAXONOMIES = ["us-gaap", "ifrs-full", "dei"]


def form_index(spark: SparkSession, path: str) -> DataFrame:
    """Ownership schedules in a fixed-width index, the first line of each accession."""
    line = r"^(SCHEDULE 13[DG](?:/A)?)\s+.*?\s+(\d+)\s+(\d{4}-\d{2}-\d{2})\s+(edgar/data/\S+)\s*$"
    t = spark.read.option("encoding", "ISO-8859-1").text(path).where(F.col("value").rlike(line))
    part = lambda i: F.regexp_extract("value", line, i)
    t = t.select(part(1).alias("form_type"), part(3).alias("filing_date"), part(4).alias("path"))
    number = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    url = F.concat(F.lit("https://www.sec.gov/Archives/"), F.regexp_extract("path", r"^(.*)/", 1), F.lit("/"), F.replace(number, F.lit("-"), F.lit("")), F.lit("/primary_doc.xml"))
    t = t.select(number.alias("accession_number"), "form_type", "filing_date", url.alias("document_url"), "path")
    return first_per_key(t, ["accession_number"], [F.col("path")]).drop("path")


def _local(tag: str) -> str:
    return f"*[local-name()='{tag}']"


def _texts(document: Column | str, *tags: str) -> Column:
    """Text of the first element by any of these names, anywhere below."""
    found = [F.try_element_at(F.xpath(F.col(document) if isinstance(document, str) else document, F.lit(f"//{_local(t)}/text()")), F.lit(1)) for t in tags]
    return F.coalesce(*[blank_to_null(f) for f in found])


def ownership(documents: DataFrame) -> DataFrame:
    """A row for each reporting person of XML schedules.

    documents: accession_number, form_type, filing_date, document_url and content (text). A document without an issuer
    stops the job. The filer stands for the person only where there is one person.
    """
    long = F.col("form_type").startswith("SCHEDULE 13D")
    t = documents.withColumns({
        "filer_cik": pad_cik_or_null(_texts("content", "cik")),
        "issuer_cik": pad_cik_or_null(_texts("content", "issuerCIK", "issuerCik")),
        "issuer_name": _texts("content", "issuerName"),
        "issuer_cusip": clean_cusip(_texts("content", "issuerCusipNumber")),
        "security_class": _texts("content", "securitiesClassTitle"),
        "event_date": us_date(_texts("content", "dateOfEvent", "eventDateRequiresFilingThisStatement")),
        "rule_designation": F.nullif(F.array_join(F.xpath("content", F.lit(f"//{_local('designateRulePursuantThisScheduleFiled')}/text()")), "; "), F.lit("")),
        "filing_intent": F.when(long, "ACTIVE").otherwise("PASSIVE"),
        "content_hash": F.sha2("content", 256),
        "tag": F.when(long, "reportingPersonInfo").otherwise("coverPageHeaderReportingPersonDetails"),
    }).withColumn("issuer_cik", F.when(F.col("issuer_cik").isNull(), F.raise_error(F.concat("accession_number", F.lit(" has no issuer")))).otherwise(F.col("issuer_cik")))
    people = F.regexp_extract_all("content", F.concat(F.lit(r"(?s)<(?:[A-Za-z0-9]+:)?"), "tag", F.lit(r"[\s>].*?</(?:[A-Za-z0-9]+:)?"), "tag", F.lit(">")), F.lit(0))
    # a part of a document may use name-space prefixes declared above it, so they go
    bare = F.transform(people, lambda p: F.regexp_replace(p, r"(</?)[A-Za-z0-9]+:", "$1"))
    t = t.withColumn("n", F.size(bare)).select("*", F.posexplode(bare).alias("i", "person"))
    number = lambda *tags: F.replace(_texts("person", *tags), F.lit(","), F.lit("")).try_cast("double")
    own = pad_cik_or_null(_texts("person", "reportingPersonCIK", "reportingPersonCik"))
    return t.select(
        "accession_number", "form_type", "filing_intent", "filing_date", "event_date", "filer_cik", "issuer_cik", "issuer_name", "issuer_cusip", "security_class", "rule_designation", (F.col("i") + 1).alias("person_index"),
        F.coalesce(own, F.when(F.col("n") == 1, F.col("filer_cik"))).alias("reporting_person_cik"), F.coalesce(_texts("person", "reportingPersonName"), F.lit("")).alias("reporting_person_name"), _texts("person", "typeOfReportingPerson").alias("reporting_person_type"),
        _texts("person", "citizenshipOrOrganization").alias("citizenship_or_organization"), number("aggregateAmountOwned", "reportingPersonBeneficiallyOwnedAggregateNumberOfShares").alias("aggregate_shares"), number("percentOfClass", "classPercent").alias("percent_of_class"),
        number("soleVotingPower").alias("sole_voting_power"), number("sharedVotingPower").alias("shared_voting_power"), number("soleDispositivePower").alias("sole_dispositive_power"), number("sharedDispositivePower").alias("shared_dispositive_power"), "document_url", "content_hash",
    )


def company_facts(payloads: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Observations of the wanted concepts; payloads has cik and content, a JSON text of facts by taxonomy, tag and unit."""
    entry = "struct<val:string,start:string,end:string,fy:bigint,fp:string,form:string,filed:string,accn:string,frame:string>"
    schema = f"entityName string, facts map<string,map<string,struct<label:string,units:map<string,array<{entry}>>>>>"
    t = payloads.select("cik", F.from_json("content", schema).alias("p"))
    t = t.select("cik", F.trim("p.entityName").alias("entity_name"), F.explode("p.facts").alias("taxonomy", "concepts")).where(F.col("taxonomy").isin(TAXONOMIES))
    t = t.select("cik", "entity_name", "taxonomy", F.explode("concepts").alias("tag", "concept")).where(F.col("tag").isin(tags or XBRL_TAGS))
    t = t.select("cik", "entity_name", "taxonomy", "tag", F.col("concept.label").alias("label"), F.explode("concept.units").alias("unit", "entries"))
    t = t.select("cik", "entity_name", "taxonomy", "tag", "label", "unit", F.explode("entries").alias("e")).withColumn("value", F.col("e.val").try_cast("double"))
    t = t.where("value IS NOT NULL AND coalesce(e.end, '') <> '' AND coalesce(e.filed, '') <> ''")
    return t.select("cik", "entity_name", "taxonomy", "tag", "label", "unit", "value", F.col("e.start").alias("period_start"), F.col("e.end").alias("period_end"), F.col("e.fy").alias("fiscal_year"), F.col("e.fp").alias("fiscal_period"), F.col("e.form").alias("form"), F.col("e.filed").alias("filed"), F.col("e.accn").alias("accession_number"), F.col("e.frame").alias("frame"))


def issuer_work_list(tables: list[DataFrame], size: int) -> DataFrame:
    """The issuers that occur most often over several tables of issuer_cik."""
    return top_values([t.select("issuer_cik").where("issuer_cik IS NOT NULL") for t in tables], "issuer_cik", size)


def security_mappings(spark: SparkSession, path: str) -> DataFrame:
    """Cached responses: of each CUSIP the one asked for last, its candidates ranked; one row without data if there is none."""
    candidate = "struct<figi:string,name:string,ticker:string,exchCode:string,marketSector:string,securityType:string,securityType2:string,shareClassFIGI:string,compositeFIGI:string>"
    t = spark.read.schema(f"requested_at string, jobs array<struct<idType:string,idValue:string>>, responses array<struct<data:array<{candidate}>,error:string,warning:string>>").json(path, multiLine=True)
    t = t.select("requested_at", F.col("_metadata.file_name").alias("source_file"), F.explode(F.arrays_zip("jobs", "responses")).alias("z"))
    t = t.select(F.col("z.jobs.idValue").alias("cusip"), "requested_at", "source_file", F.col("z.responses").alias("r"))
    t = first_per_key(t, ["cusip"], [F.col("requested_at").desc(), F.col("source_file")])
    some = F.when(F.size(F.coalesce("r.data", F.array().cast(f"array<{candidate}>"))) > 0, F.col("r.data"))
    t = t.select("*", F.posexplode_outer(some).alias("i", "d"))
    fields = {"figi": "figi", "name": "name", "ticker": "ticker", "exchange_code": "exchCode", "market_sector": "marketSector", "security_type": "securityType", "security_type_2": "securityType2", "share_class_figi": "shareClassFIGI", "composite_figi": "compositeFIGI"}
    return t.select("cusip", (F.coalesce("i", F.lit(0)) + 1).alias("mapping_rank"), *[F.col(f"d.{f}").alias(n) for n, f in fields.items()], F.coalesce("r.error", "r.warning").alias("error"), "source_file", F.substring("requested_at", 1, 10).alias("snapshot_date"))


def cusip_work_list(holdings: DataFrame) -> DataFrame:
    return holdings.select(F.upper(F.trim("cusip")).alias("cusip")).where("length(cusip) = 9").distinct()


def brochures(spark: SparkSession, path: str) -> DataFrame:
    """Brochures by file name; the first listing of a file counts, in the order of listing files and of their lines."""
    rows = pick(read_csv(spark, path), {"firm_name": "FirmName", "sec_number": "SECNumber", "crd_number": "CRDNumber", "filing_id": "FilingID", "brochure_name": "BrochureName", "brochure_id": "BrochureID", "brochure_version": "BrochureVersion", "date_filed": us_date("DateFiled"), "pdf_file_name": "PDFFileName"})
    order = Window.partitionBy("pdf_file_name").orderBy("_line")
    # numbers grow within a partition, and the parts of a file by their offsets, however files are split and packed
    return rows.withColumn("_line", F.struct(F.input_file_name(), F.input_file_block_start(), F.monotonically_increasing_id())).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_line", "_n")


def page_texts(spark: SparkSession, path: str, read_pages: Callable[[bytes], list[str]]) -> DataFrame:
    """(pdf_file_name, content_hash, page_number, text, extraction_error) of binary documents.

    read_pages turns a file into the texts of its pages. What it raises becomes a row without page, not a failed job.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("pdf_file_name"), F.sha2("content", 256).alias("content_hash"), "content")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, digest, content in zip(batch["pdf_file_name"], batch["content_hash"], batch["content"], strict=True):
                try:
                    rows += [(name, digest, i, text, None) for i, text in enumerate(read_pages(content), 1)]
                except Exception as e:  # any parser's error is recorded
                    rows.append((name, digest, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["pdf_file_name", "content_hash", "page_number", "text", "extraction_error"])
            yield out.astype({"page_number": "Int32"})

    return files.mapInPandas(extract, "pdf_file_name string, content_hash string, page_number int, text string, extraction_error string")


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """Human reviews with their line numbers. The file is written by people, a line each, and read on the driver."""
    columns = ["node_id", "lei", "outcome", "reviewer", "reviewed_at", "rationale"]
    with open(path, encoding="utf-8", newline="") as f:
        rows = [(*[r.get(c) or None for c in columns], i) for i, r in enumerate(csv.DictReader(f), 2)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns) + ", line_no int")
