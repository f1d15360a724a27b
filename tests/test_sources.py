from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from kinfold.sources import common, documents, filings, registers
from kinfold.streaming.latest import keep_latest, windowed_totals


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_lei_register(spark, tmp_path):
    record = "<lei:LEIRecord><lei:LEI>{lei}</lei:LEI><lei:Entity><lei:LegalName xml:lang='en'>{name}</lei:LegalName><lei:OtherEntityNames><lei:OtherEntityName>Old Name Ltd</lei:OtherEntityName></lei:OtherEntityNames><lei:LegalAddress><lei:FirstAddressLine>1 Road</lei:FirstAddressLine><lei:City> New  York </lei:City><lei:Country>us</lei:Country><lei:PostalCode>ec2n 4ag</lei:PostalCode></lei:LegalAddress><lei:RegistrationAuthority><lei:RegistrationAuthorityEntityID>ab-1</lei:RegistrationAuthorityEntityID></lei:RegistrationAuthority><lei:EntityStatus>ACTIVE</lei:EntityStatus></lei:Entity><lei:Registration><lei:LastUpdateDate>{day}</lei:LastUpdateDate></lei:Registration></lei:LEIRecord>"
    path = put(tmp_path / "lei.xml", "<lei:LEIData xmlns:lei='x'>\n<lei:LEIHeader><lei:ContentDate>2024-05-06T00:00:00Z</lei:ContentDate></lei:LEIHeader>\n<lei:LEIRecords>" + record.format(lei="A1", name="Alpha Fund II LP", day="2024-01-01") + record.format(lei="A1", name="Alpha Fund III LP", day="2024-02-01") + "</lei:LEIRecords></lei:LEIData>")
    rows = registers.lei_entities(spark, path).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["legal_name"], r["legal_name_core"], r["fund_number"], r["aliases_norm"], r["legal_city"], r["legal_country"], r["legal_postcode"], r["postcode_prefix"], r["registration_id_norm"]) == ("Alpha Fund III LP", "alpha fund iii", 3, ["old name ltd"], "new york", "US", "EC2N4AG", "EC2N", "AB1")
    assert registers.content_day(spark, path) == "2024-05-06"


def test_relationships_take_their_own_period(spark, tmp_path):
    period = "<rr:RelationshipPeriod><rr:StartDate>{d}</rr:StartDate><rr:PeriodType>{t}</rr:PeriodType></rr:RelationshipPeriod>"
    record = "<rr:RelationshipRecord><rr:Relationship><rr:StartNode><rr:NodeID>A</rr:NodeID></rr:StartNode><rr:EndNode><rr:NodeID>B</rr:NodeID></rr:EndNode><rr:RelationshipType>IS_SUBFUND_OF</rr:RelationshipType><rr:RelationshipPeriods>{p}</rr:RelationshipPeriods><rr:RelationshipStatus>ACTIVE</rr:RelationshipStatus></rr:Relationship></rr:RelationshipRecord>"
    path = put(tmp_path / "rr.xml", "<rr:R xmlns:rr='x'>" + record.format(p=period.format(d="2001", t="ACCOUNTING_PERIOD") + period.format(d="2002", t="RELATIONSHIP_PERIOD")) + record.format(p=period.format(d="2003", t="ACCOUNTING_PERIOD")) + "</rr:R>")
    assert sorted(r["start_date"] for r in registers.lei_relationships(spark, path).collect()) == ["2002", "2003"]


def test_isins_and_mappings(spark, tmp_path):
    path = put(tmp_path / "isin-lei-20240301.csv", "LEI,ISIN\nL1,US1\n")
    assert tuple(registers.isin_links(spark, path).first()) == ("US1", "L1", "2024-03-01")
    with pytest.raises(common.SourceError):
        registers.isin_links(spark, put(tmp_path / "bad.csv", "A,B\n1,2\n"))
    mapped = registers.external_identifiers(spark, {"BIC": put(tmp_path / "bic.csv", "LEI,BIC\nL1,B1\n"), "MIC": put(tmp_path / "mic.csv", "MIC,LEI\nM1,L2\n")})
    assert {tuple(r) for r in mapped.collect()} == {("L1", "BIC", "B1"), ("L2", "MIC", "M1")}


def test_holdings_reports(spark, tmp_path):
    put(tmp_path / "SUBMISSION.tsv", "ACCESSION_NUMBER\tFILING_DATE\tSUBMISSIONTYPE\tCIK\tPERIODOFREPORT\nA1\t14-FEB-2024\t13F-HR\t0001\t31-DEC-2023\n")
    put(tmp_path / "COVERPAGE.tsv", 'ACCESSION_NUMBER\tISAMENDMENT\tAMENDMENTTYPE\tFILINGMANAGER_NAME\nA1\tn\t\tAcme "Best" Ltd.\n')
    put(tmp_path / "INFOTABLE.tsv", "ACCESSION_NUMBER\tINFOTABLE_SK\tNAMEOFISSUER\tTITLEOFCLASS\tCUSIP\tFIGI\tVALUE\tSSHPRNAMT\tSSHPRNAMTTYPE\tPUTCALL\tINVESTMENTDISCRETION\tOTHERMANAGER\tVOTING_AUTH_SOLE\tVOTING_AUTH_SHARED\tVOTING_AUTH_NONE\nA1\t1\tX\tCOM\t123456789\t\t12.7\t5\tSH\t\tSOLE\t\t1\tx\t\n")
    put(tmp_path / "SUMMARYPAGE.tsv", "ACCESSION_NUMBER\tTABLEENTRYTOTAL\tTABLEVALUETOTAL\nA1\t1\t13\n")
    put(tmp_path / "OTHERMANAGER.tsv", "ACCESSION_NUMBER\tOTHERMANAGER_SK\tCIK\tFORM13FFILENUMBER\tCRDNUMBER\tSECFILENUMBER\tNAME\nA1\t7\t\t\t\t\tOther\n")
    out = filings.holdings_reports(spark, str(tmp_path), "q.zip", "now")
    f = out["sec_13f_filings"].first()
    assert (f["filer_name"], f["filer_name_core"], f["is_amendment"], f["snapshot_date"]) == ('Acme "Best" Ltd.', 'acme "best"', False, "2024-02-14")
    h = out["sec_13f_effective_holdings"].first()
    assert (h["value"], h["value_usd"], h["voting_auth_sole"], h["voting_auth_shared"], h["put_call"]) == (13, 13, 1, None, None)
    assert out["sec_13f_validations"].first()["valid"] and out["sec_13f_quarantine"].count() == 0 and out["sec_13f_other_managers"].first()["name"] == "Other"


def test_fund_reports_and_insiders(spark, tmp_path):
    put(tmp_path / "SUBMISSION.tsv", "ACCESSION_NUMBER\tFILING_DATE\tREPORT_DATE\tPERIOD_OF_REPORT\tDOCUMENT_TYPE\tISSUERCIK\tISSUERNAME\tISSUERTRADINGSYMBOL\nA\t01-MAR-2024\t31-JAN-2024\tp\t4\t9\tIss\tI\n")
    put(tmp_path / "REGISTRANT.tsv", "ACCESSION_NUMBER\tCIK\tREGISTRANT_NAME\tLEI\nA\t1\tTrust\tTL\n")
    put(tmp_path / "FUND_REPORTED_INFO.tsv", "ACCESSION_NUMBER\tSERIES_ID\tSERIES_NAME\tSERIES_LEI\tTOTAL_ASSETS\tTOTAL_LIABILITIES\tNET_ASSETS\nA\tS\tSer\tSL\t10\tx\t9.5\n")
    cols = "ACCESSION_NUMBER HOLDING_ID ISSUER_NAME ISSUER_LEI ISSUER_TITLE ISSUER_CUSIP BALANCE UNIT CURRENCY_CODE CURRENCY_VALUE EXCHANGE_RATE PERCENTAGE PAYOFF_PROFILE ASSET_CAT ISSUER_TYPE INVESTMENT_COUNTRY FAIR_VALUE_LEVEL DERIVATIVE_CAT".split()
    row = ["A", "H1", "N", "A" * 20, "", "123456789", "1", "NS", "USD", "2", "", "3", "Long", "EC", "", "US", "1", ""]
    put(tmp_path / "FUND_REPORTED_HOLDING.tsv", "\n".join("\t".join(x) for x in (cols, row, row)) + "\n")
    put(tmp_path / "IDENTIFIERS.tsv", "HOLDING_ID\tIDENTIFIER_ISIN\tIDENTIFIER_TICKER\nH1\tUS0000000001\t\nH1\tUS0000000002\tT\n")
    fund = filings.fund_reports(spark, str(tmp_path)).first()
    assert (fund["series_lei"], fund["total_liabilities"], fund["net_assets"]) == ("SL", None, 9.5)
    held = filings.fund_holdings(spark, str(tmp_path))
    assert held.count() == 1 and held.first()["isin"] == "US0000000002"
    marked = held.withColumns({"source_file": F.lit("f"), "snapshot_date": F.lit("d"), "ingested_at": F.lit("t")})
    assert filings.observed_issuers(marked).count() == 1
    put(tmp_path / "REPORTINGOWNER.tsv", "ACCESSION_NUMBER\tRPTOWNERCIK\tRPTOWNERNAME\tRPTOWNER_RELATIONSHIP\tRPTOWNER_TITLE\nA\t7\tP\tDirector\t\nA\t8\tQ\tOfficer\tCEO\n")
    head = "ACCESSION_NUMBER\t{k}\tSECURITY_TITLE\tTRANS_DATE\tTRANS_CODE\tTRANS_ACQUIRED_DISP_CD\tTRANS_SHARES\tTRANS_PRICEPERSHARE\tSHRS_OWND_FOLWNG_TRANS\tDIRECT_INDIRECT_OWNERSHIP\nA\t5\tCom\t2024\tP\tA\t10\t1.5\t20\tD\n"
    put(tmp_path / "NONDERIV_TRANS.tsv", head.format(k="NONDERIV_TRANS_SK"))
    put(tmp_path / "DERIV_TRANS.tsv", head.format(k="DERIV_TRANS_SK"))
    assert filings.insider_relationships(spark, str(tmp_path)).count() == 2
    assert sorted((r["owner_cik"], r["derivative"], r["shares"]) for r in filings.insider_transactions(spark, str(tmp_path)).collect()) == [("7", False, 10.0), ("7", True, 10.0), ("8", False, 10.0), ("8", True, 10.0)]


def test_companies_controllers_banks(spark, tmp_path):
    r = registers.companies(spark, put(tmp_path / "c.csv", 'CompanyName, CompanyNumber,SICCode.SicText_1,SICCode.SicText_2,PreviousName_1.CompanyName\n"A, Ltd",01,"1 - x",,Old\n')).first()
    assert (r["company_number"], r["company_name"], r["sic_codes"], r["previous_names"]) == ("01", "A, Ltd", ["1 - x"], ["Old"])
    lines = [{"company_number": "1", "data": {"kind": "k", "name": "N", "links": {"self": "/x"}, "natures_of_control": ["a"]}}, {"company_number": "2", "identification": {"legal_name": "Corp"}}]
    got = {r["company_number"]: r for r in registers.controllers(spark, put(tmp_path / "p.json", "\n".join(map(json.dumps, lines)))).collect()}
    assert got["1"]["name"] == "N" and got["2"]["name"] == "Corp" and got["2"]["psc_type"] == "unknown" and len(got["1"]["psc_id"]) == 24
    bank = registers.bank_institutions(spark, put(tmp_path / "b.csv", '"#ID_RSSD","NM_LGL","NM_SHORT","ENTITY_TYPE","ID_LEI","CITY","STATE_ABBR_NM","CNTRY_NM","DT_OPEN","DT_END"\n1,Bank,,,0,,,,20200101,99991231\n0,None,,,,,,,,\n')).collect()
    assert len(bank) == 1 and (bank[0]["lei"], bank[0]["opened_on"], bank[0]["closed_on"]) == (None, "2020-01-01", None)
    rel = registers.bank_relationships(spark, put(tmp_path / "r.csv", "#ID_RSSD_PARENT,ID_RSSD_OFFSPRING,CTRL_IND,RELN_LVL,PCT_EQUITY,DT_START,DT_END\n1,2,1,1,50.5,20200101,99991231\n1,0,1,,,,\n")).collect()
    assert [(x["controlled"], x["equity_percent"], x["end_date"]) for x in rel] == [(True, 50.5, None)]


def test_submissions_series_mappings(spark, tmp_path):
    put(tmp_path / "s" / "CIK1.json", json.dumps({"cik": "12", "name": " A ", "formerNames": [{"name": "B"}, {"name": " "}], "tickers": ["T"], "addresses": {"business": {"city": "X"}}}))
    r = registers.submissions(spark, str(tmp_path / "s")).first()
    assert (r["cik"], r["name"], r["former_names"], r["tickers"], r["exchanges"], r["business_city"]) == ("0000000012", "A", ["B"], ["T"], [], "X")
    assert registers.series_classes(spark, put(tmp_path / "sc-2023.csv", "Reporting File Number,CIK Number,Entity Name,Entity Org Type,Series ID,Series Name,Class ID,Class Name,Class Ticker\nx,1,E,,S1,Ser,,,\n")).first()["snapshot_date"] == "2023-12-31"
    job = lambda day, data: {"requested_at": day, "jobs": [{"idType": "ID_CUSIP", "idValue": "X"}, {"idType": "ID_CUSIP", "idValue": "Y"}], "responses": [data, {"warning": "No identifier found."}]}
    put(tmp_path / "m" / "mapping-1.json", json.dumps(job("2024-01-01", {"data": [{"figi": "F0"}]})))
    put(tmp_path / "m" / "mapping-2.json", json.dumps(job("2024-01-02", {"data": [{"figi": "F1"}, {"figi": "F2"}]})))
    got = sorted((r["cusip"], r["mapping_rank"], r["figi"], r["error"]) for r in documents.security_mappings(spark, str(tmp_path / "m")).collect())
    assert got == [("X", 1, "F1", None), ("X", 2, "F2", None), ("Y", 1, None, "No identifier found.")]


def test_ownership_and_index(spark, tmp_path):
    idx = put(tmp_path / "form.idx", "SCHEDULE 13G     Acme Inc    123   2024-02-01  edgar/data/123/0001-24-000001.txt\nSCHEDULE 13G     Other       456   2024-02-01  edgar/data/123/0001-24-000001.txt\n10-K  X 1 2024-02-01 edgar/data/1/a.txt\n")
    filing = documents.form_index(spark, idx).collect()
    assert len(filing) == 1 and filing[0]["document_url"].endswith("edgar/data/123/000124000001/primary_doc.xml")
    one = "<e:doc xmlns:e='u'><e:cik>77</e:cik><e:issuerCik>5</e:issuerCik><e:issuerName>Iss</e:issuerName><e:issuerCusipNumber>000000000</e:issuerCusipNumber><e:eventDateRequiresFilingThisStatement>12/31/2023</e:eventDateRequiresFilingThisStatement><e:coverPageHeaderReportingPersonDetails><e:reportingPersonName>P</e:reportingPersonName><e:classPercent>4.9</e:classPercent></e:coverPageHeaderReportingPersonDetails></e:doc>"
    two = "<doc><cik>77</cik><issuerCIK>5</issuerCIK>" + "".join(f"<reportingPersonInfo><reportingPersonName>{n}</reportingPersonName><aggregateAmountOwned>1,000</aggregateAmountOwned></reportingPersonInfo>" for n in "QR") + "</doc>"
    df = spark.createDataFrame([("A", "SCHEDULE 13G", "2024-02-01", "u", one), ("B", "SCHEDULE 13D/A", "2024-02-01", "u", two)], "accession_number string, form_type string, filing_date string, document_url string, content string")
    got = {(r["accession_number"], r["person_index"]): r for r in documents.ownership(df).collect()}
    assert len(got) == 3
    assert (got["A", 1]["reporting_person_cik"], got["A", 1]["percent_of_class"], got["A", 1]["issuer_cusip"], got["A", 1]["event_date"], got["A", 1]["filing_intent"]) == ("0000000077", 4.9, None, "2023-12-31", "PASSIVE")
    assert got["B", 2]["reporting_person_cik"] is None and got["B", 2]["aggregate_shares"] == 1000.0


def test_facts_brochures_pages_reviews(spark, tmp_path):
    payload = {"entityName": "E", "facts": {"us-gaap": {"Assets": {"label": "A", "units": {"USD": [{"val": 5, "end": "2023-12-31", "filed": "2024-02-01", "accn": "x", "fy": 2023}, {"val": None, "end": "e", "filed": "f"}, {"val": 1, "end": "e"}]}}, "Odd": {"units": {"USD": [{"val": 1, "end": "e", "filed": "f"}]}}}}}
    rows = documents.company_facts(spark.createDataFrame([("1", json.dumps(payload))], "cik string, content string")).collect()
    assert [(r["tag"], r["value"], r["fiscal_year"]) for r in rows] == [("Assets", 5.0, 2023)]
    b = documents.brochures(spark, put(tmp_path / "b.csv", "FirmName,DateFiled,PDFFileName\nA,1/2/2024,x.pdf\nB,1/3/2024,x.pdf\n")).collect()
    assert [(r["firm_name"], r["date_filed"]) for r in b] == [("A", "2024-01-02")]
    put(tmp_path / "d" / "a.bin", "one|two")
    put(tmp_path / "d" / "b.bin", "bad")

    def pages(content):
        text = bytes(content).decode()
        if text == "bad":
            raise ValueError("no pages")
        return text.split("|")

    got = sorted((r["pdf_file_name"], r["page_number"], r["text"], r["extraction_error"]) for r in documents.page_texts(spark, str(tmp_path / "d"), pages).collect())
    assert got == [("a.bin", 1, "one", None), ("a.bin", 2, "two", None), ("b.bin", None, None, "ValueError: no pages")]
    reviews = documents.reviews(spark, put(tmp_path / "r.csv", 'node_id,lei,outcome,reviewer,reviewed_at,rationale\na,b,CONFIRMED,r,2024,"x, y"\n')).first()
    assert (reviews["line_no"], reviews["rationale"]) == (2, "x, y")


def test_archives_and_required_columns(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.tsv", "A\n1\n")
    assert common.unpack(str(tmp_path / "a.zip"), str(tmp_path / "o"), ["x.tsv"])["x.tsv"].endswith("x.tsv")
    with pytest.raises(common.SourceError, match="lacks"):
        common.unpack(str(tmp_path / "a.zip"), str(tmp_path / "o"), ["y.tsv"])
    with pytest.raises(Exception, match="is required"):
        common.require(spark.createDataFrame([(None,)], "a string"), ["a"]).collect()


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00", 1.0), (1, "b", "2024-01-02 00:00:00", 2.0), (2, "c", "2024-01-01 00:30:00", 3.0)], "k int, event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = keep_latest(stream, str(tmp_path / "out"), ["k"], "ts", str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted((r["k"], r["event_type"]) for r in spark.read.parquet(str(tmp_path / "out" / "v0")).collect()) == [(1, "b"), (2, "c")]
    assert windowed_totals(rows).count() == 3
