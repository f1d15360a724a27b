"""Registers of entities: LEI data in XML and CSV, the British company register, banks, fund series, EDGAR submissions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import names, places
from kinfold.functions.columns import blank_to_null, compact_date
from kinfold.operators.relational import dedupe_latest, union_by_name

from .common import SourceError, pick, read_csv

_ADDRESS = "struct<FirstAddressLine:string,City:string,Region:string,PostalCode:string,Country:string>"
LEI_RECORD = f"""
LEI string,
Entity struct<LegalName:string,OtherEntityNames:struct<OtherEntityName:array<string>>,LegalAddress:{_ADDRESS},HeadquartersAddress:{_ADDRESS},
  RegistrationAuthority:struct<RegistrationAuthorityID:string,RegistrationAuthorityEntityID:string>,LegalJurisdiction:string,EntityCategory:string,
  LegalForm:struct<EntityLegalFormCode:string,OtherLegalForm:string>,EntityStatus:string,EntityCreationDate:string,SuccessorEntity:struct<SuccessorLEI:string>>,
Registration struct<InitialRegistrationDate:string,LastUpdateDate:string,RegistrationStatus:string,NextRenewalDate:string>
"""
RELATIONSHIP_RECORD = """
Relationship struct<StartNode:struct<NodeID:string,NodeIDType:string>,EndNode:struct<NodeID:string,NodeIDType:string>,RelationshipType:string,RelationshipStatus:string,
  RelationshipPeriods:struct<RelationshipPeriod:array<struct<StartDate:string,EndDate:string,PeriodType:string>>>>
"""


def _xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    """Elements of a large file as rows; Spark splits the file, so none is parsed in one go. Names count without their name-space prefix."""
    return spark.read.format("xml").option("rowTag", row).option("ignoreNamespace", "true").schema(schema).load(path)


def content_day(spark: SparkSession, path: str) -> str | None:
    """The day of a file's first ContentDate, read from its header alone."""
    head = spark.read.text(path, wholetext=False).where(F.col("value").contains("ContentDate")).limit(1).select(F.regexp_extract("value", r"ContentDate>\s*([0-9-]{10})", 1)).first()
    return head[0] if head and head[0] else None


def _address(side: str, prefix: str) -> dict[str, Column]:
    c = lambda f: blank_to_null(F.col(f"Entity.{side}.{f}"))
    return {
        f"{prefix}_address_line1": c("FirstAddressLine"), f"{prefix}_city": places.normalize_city(c("City")), f"{prefix}_region": c("Region"), f"{prefix}_postcode": places.normalize_postcode(c("PostalCode")), f"{prefix}_country": places.normalize_country(c("Country")),
        f"{prefix}_address_norm": places.address_line(*[c(f) for f in ("FirstAddressLine", "City", "Region", "PostalCode", "Country")]),
    }


def lei_entities(spark: SparkSession, path: str) -> DataFrame:
    """The LEI register, the newest record of each LEI."""
    t = _xml(spark, path, "LEIRecord", LEI_RECORD)
    text = lambda f: blank_to_null(F.col(f))
    aliases = F.filter(F.transform(F.coalesce("Entity.OtherEntityNames.OtherEntityName", F.array().cast("array<string>")), F.trim), lambda n: n.isNotNull() & (n != ""))
    registration = text("Entity.RegistrationAuthority.RegistrationAuthorityEntityID")
    rows = t.select(
        text("LEI").alias("lei"), text("Entity.LegalName").alias("legal_name"), aliases.alias("aliases"), text("Entity.EntityStatus").alias("entity_status"), text("Entity.EntityCategory").alias("entity_category"), text("Entity.LegalJurisdiction").alias("jurisdiction"),
        text("Entity.LegalForm.EntityLegalFormCode").alias("legal_form_code"), text("Entity.LegalForm.OtherLegalForm").alias("legal_form_other"), text("Entity.RegistrationAuthority.RegistrationAuthorityID").alias("registration_authority_id"),
        registration.alias("registration_id"), places.normalize_identifier(registration).alias("registration_id_norm"), text("Registration.RegistrationStatus").alias("registration_status"),
        *[c.alias(n) for side, p in (("LegalAddress", "legal"), ("HeadquartersAddress", "hq")) for n, c in _address(side, p).items()],
        text("Entity.EntityCreationDate").alias("entity_creation_date"), text("Registration.InitialRegistrationDate").alias("initial_registration_date"), text("Registration.LastUpdateDate").alias("last_update_date"),
        text("Registration.NextRenewalDate").alias("next_renewal_date"), text("Entity.SuccessorEntity.SuccessorLEI").alias("successor_lei"),
    )
    rows = rows.withColumns({**names.name_fields("legal_name"), "aliases_norm": F.transform("aliases", names.normalize_name), "postcode_prefix": places.postcode_outward("legal_postcode")})
    return dedupe_latest(rows.where("lei IS NOT NULL"), ["lei"], by="last_update_date", ties=["legal_name"])


def lei_relationships(spark: SparkSession, path: str) -> DataFrame:
    """Relationships with their own period: the first of type RELATIONSHIP_PERIOD, else the first."""
    t = _xml(spark, path, "RelationshipRecord", RELATIONSHIP_RECORD)
    periods = F.coalesce(F.col("Relationship.RelationshipPeriods.RelationshipPeriod"), F.array().cast("array<struct<StartDate:string,EndDate:string,PeriodType:string>>"))
    own = F.coalesce(F.try_element_at(F.filter(periods, lambda p: p["PeriodType"] == "RELATIONSHIP_PERIOD"), F.lit(1)), F.try_element_at(periods, F.lit(1)))
    return t.select(
        F.col("Relationship.StartNode.NodeID").alias("start_node_id"), F.col("Relationship.StartNode.NodeIDType").alias("start_node_id_type"), F.col("Relationship.EndNode.NodeID").alias("end_node_id"), F.col("Relationship.EndNode.NodeIDType").alias("end_node_id_type"),
        F.col("Relationship.RelationshipType").alias("relationship_type"), F.col("Relationship.RelationshipStatus").alias("relationship_status"), own["StartDate"].alias("start_date"), own["EndDate"].alias("end_date"),
    )


def lei_exceptions(spark: SparkSession, path: str) -> DataFrame:
    t = _xml(spark, path, "Exception", "LEI string, ExceptionCategory string, ExceptionReason array<string>")
    return t.select(F.col("LEI").alias("lei"), F.col("ExceptionCategory").alias("exception_category"), F.try_element_at("ExceptionReason", F.lit(1)).alias("exception_reason"))


def isin_links(spark: SparkSession, path: str) -> DataFrame:
    t = read_csv(spark, path)
    if t.columns[:2] != ["LEI", "ISIN"]:
        raise SourceError(f"{path}: the header is {t.columns}")
    day = re.search(r"(20\d\d)-?(\d\d)-?(\d\d)", path.rsplit("/", 1)[-1])
    return pick(t, {"isin": "ISIN", "lei": "LEI"}).withColumn("snapshot_date", F.lit("-".join(day.groups()) if day else None).cast("string"))


def external_identifiers(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Mapping files by type (BIC, MIC, OPENCORPORATES): the LEI column and the other one."""
    parts = []
    for kind, path in paths.items():
        t = read_csv(spark, path)
        value = next(c for c in t.columns if c.upper() != "LEI")
        parts.append(pick(t, {"lei": "LEI", "identifier_value": value}).withColumn("identifier_type", F.lit(kind)))
    return union_by_name(parts).where("lei IS NOT NULL AND identifier_value IS NOT NULL").select("lei", "identifier_type", "identifier_value")


def companies(spark: SparkSession, path: str) -> DataFrame:
    """The British register of companies, plain or gzipped; trade codes and former names as arrays."""
    t = read_csv(spark, path)
    listed = lambda form, n: F.filter(F.array(*[blank_to_null(F.col(f"`{form.format(i)}`")) if form.format(i) in t.columns else F.lit(None).cast("string") for i in range(1, n + 1)]), lambda x: x.isNotNull())
    return pick(t, {
        "company_number": "CompanyNumber", "company_name": "CompanyName", "company_status": "CompanyStatus", "company_category": "CompanyCategory", "country_of_origin": "CountryOfOrigin", "incorporation_date": "IncorporationDate", "dissolution_date": "DissolutionDate",
        "address_line1": "RegAddress.AddressLine1", "locality": "RegAddress.PostTown", "region": "RegAddress.County", "postal_code": "RegAddress.PostCode", "sic_codes": listed("SICCode.SicText_{}", 4), "previous_names": listed("PreviousName_{}.CompanyName", 10),
    })


_PERSON = "company_number string, kind string, name string, country_of_residence string, nationality string, identification struct<legal_name:string,registration_number:string,legal_authority:string,legal_form:string>, natures_of_control array<string>, notified_on string, ceased_on string, links struct<self:string>"


def controllers(spark: SparkSession, path: str) -> DataFrame:
    """Persons with significant control, one JSON object a line, with or without an envelope called data."""
    inner = f"struct<{','.join(f.strip().replace(' ', ':', 1) for f in re.split(r', (?![^<]*>)', _PERSON))}>"
    t = spark.read.schema(f"{_PERSON}, data {inner}").json(path)
    p = lambda f: F.coalesce(F.col(f"data.{f}"), F.col(f))
    number = F.coalesce(blank_to_null(F.col("company_number")), blank_to_null(F.col("data.company_number")), F.lit(""))
    name = F.coalesce(blank_to_null(p("name")), blank_to_null(p("identification.legal_name")), F.lit("Unknown"))
    key = F.coalesce(p("links.self"), F.to_json(F.array(number, F.coalesce(p("kind"), F.lit(None)), name, p("notified_on"))))
    return t.select(
        F.substring(F.sha2(key, 256), 1, 24).alias("psc_id"), number.alias("company_number"), F.coalesce(p("kind"), F.lit("unknown")).alias("psc_type"), name.alias("name"), blank_to_null(p("country_of_residence")).alias("country_of_residence"), blank_to_null(p("nationality")).alias("nationality"),
        blank_to_null(p("identification.registration_number")).alias("registration_number"), blank_to_null(p("identification.legal_authority")).alias("legal_authority"), blank_to_null(p("identification.legal_form")).alias("legal_form"),
        F.coalesce(p("natures_of_control"), F.array().cast("array<string>")).alias("natures_of_control"), blank_to_null(p("notified_on")).alias("notified_on"), blank_to_null(p("ceased_on")).alias("ceased_on"),
    )


def _bank_table(spark: SparkSession, path: str) -> DataFrame:
    t = read_csv(spark, path, encoding="ISO-8859-1")
    return t.toDF(*[c.upper() for c in t.columns])


def _bank_id(c: str) -> Column:
    plain = blank_to_null(F.col(c))
    return F.when(plain != "0", plain)


def bank_institutions(spark: SparkSession, path: str) -> DataFrame:
    t = _bank_table(spark, path)
    lei = F.upper(F.trim("ID_LEI"))
    rows = pick(t, {"rssd_id": _bank_id("ID_RSSD"), "legal_name": "NM_LGL", "short_name": "NM_SHORT", "entity_type": "ENTITY_TYPE", "lei": F.when(F.length(lei) == 20, lei), "city": "CITY", "state": "STATE_ABBR_NM", "country": "CNTRY_NM", "opened_on": compact_date("DT_OPEN"), "closed_on": compact_date("DT_END")})
    return rows.where("rssd_id IS NOT NULL AND legal_name IS NOT NULL")


def bank_relationships(spark: SparkSession, path: str) -> DataFrame:
    t = _bank_table(spark, path)
    rows = pick(t, {"parent_rssd_id": _bank_id("ID_RSSD_PARENT"), "offspring_rssd_id": _bank_id("ID_RSSD_OFFSPRING"), "controlled": F.coalesce(F.trim("CTRL_IND") == "1", F.lit(False)), "regulatory_level": "RELN_LVL", "equity_percent": F.col("PCT_EQUITY").try_cast("double"), "start_date": compact_date("DT_START"), "end_date": compact_date("DT_END")})
    return rows.where("parent_rssd_id IS NOT NULL AND offspring_rssd_id IS NOT NULL")


def bank_transformations(spark: SparkSession, path: str) -> DataFrame:
    t = _bank_table(spark, path)
    rows = pick(t, {"predecessor_rssd_id": _bank_id("ID_RSSD_PREDECESSOR"), "successor_rssd_id": _bank_id("ID_RSSD_SUCCESSOR"), "transformation_code": "TRNSFM_CD", "transformation_date": compact_date("DT_TRANS")})
    return rows.where("predecessor_rssd_id IS NOT NULL AND successor_rssd_id IS NOT NULL")


def series_classes(spark: SparkSession, path: str) -> DataFrame:
    """The register of fund series and classes; its snapshot is the end of the year in the file's name."""
    year = re.search(r"(20\d\d)", path.rsplit("/", 1)[-1])
    rows = pick(read_csv(spark, path), {
        "reporting_file_number": "Reporting File Number", "cik": "CIK Number", "entity_name": "Entity Name", "entity_org_type": "Entity Org Type", "series_id": "Series ID", "series_name": "Series Name", "class_id": "Class ID", "class_name": "Class Name", "class_ticker": "Class Ticker",
        "address_1": "Address_1", "address_2": "Address_2", "city": "City", "state": "State", "zip_code": "Zip Code",
    })
    return rows.withColumn("snapshot_date", F.lit(f"{year[1]}-12-31" if year else None).cast("string"))


_PLACE = "struct<street1:string,street2:string,city:string,stateOrCountry:string,zipCode:string>"


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """One entity for each JSON file in a folder."""
    schema = f"cik string, name string, entityType string, sic string, sicDescription string, ein string, stateOfIncorporation string, fiscalYearEnd string, formerNames array<struct<name:string>>, tickers array<string>, exchanges array<string>, addresses struct<business:{_PLACE},mailing:{_PLACE}>"
    t = spark.read.schema(schema).json(path, multiLine=True)
    none = F.array().cast("array<string>")
    former = F.filter(F.transform(F.coalesce("formerNames", F.array().cast("array<struct<name:string>>")), lambda x: F.nullif(F.trim(x["name"]), F.lit(""))), lambda x: x.isNotNull())
    place = [(f"{k}_{n}", f"addresses.{k}.{f}") for k in ("business", "mailing") for n, f in (("street1", "street1"), ("street2", "street2"), ("city", "city"), ("state_or_country", "stateOrCountry"), ("zip_code", "zipCode"))]
    plain = [("entity_type", "entityType"), ("sic", "sic"), ("sic_description", "sicDescription"), ("ein", "ein"), ("state_of_incorporation", "stateOfIncorporation"), ("fiscal_year_end", "fiscalYearEnd")]
    return t.select(F.lpad("cik", 10, "0").alias("cik"), F.trim("name").alias("name"), *[blank_to_null(F.col(c)).alias(n) for n, c in plain], former.alias("former_names"), F.coalesce("tickers", none).alias("tickers"), F.coalesce("exchanges", none).alias("exchanges"), *[blank_to_null(F.col(c)).alias(n) for n, c in place])
