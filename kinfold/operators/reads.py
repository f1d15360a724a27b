"""Reads over documents and tables: positions, owners, funds, securities, financial series, pages, reviews, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.columns import any_date
from kinfold.functions.formulas import balances, percent_change, ratio
from kinfold.functions.places import pad_cik

from .relational import find, first_per_key, snippet, top_per_key


def recent_positions(holdings: DataFrame, cik: str, cusip: str, periods: int = 4) -> DataFrame:
    """All long rows of a filer's position in its last periods; options are left out."""
    rows = holdings.where((F.col("cik") == cik) & (F.col("cusip") == cusip) & F.col("put_call").isNull())
    return rows.withColumn("_n", F.dense_rank().over(Window.partitionBy("cik", "cusip").orderBy(F.col("period_date").desc()))).where(F.col("_n") <= periods).drop("_n")


def position_history(holdings: DataFrame, keys: tuple[str, ...] = ("cik", "cusip"), periods: int = 4) -> DataFrame:
    """Per key and period, newest first: total value and its change against the period before, absolute and in percent."""
    totals = holdings.where("put_call IS NULL").groupBy(*keys, "period_date").agg(F.sum("value_usd").alias("total"), F.sum("shares").alias("shares"))
    order = Window.partitionBy(*keys).orderBy(F.col("period_date").desc())
    out = totals.withColumns({"previous": F.lead("total").over(order), "n": F.row_number().over(order)}).where(F.col("n") <= periods)
    return out.withColumns({"change": F.col("total") - F.col("previous"), "percent_change": percent_change("total", "previous")}).drop("n")


def beneficial_owners(ownership: DataFrame, issuer_cik: str | None = None, size: int = 10) -> DataFrame:
    """The newest filing of each person at an issuer, largest stakes first; unknown stakes last."""
    rows = ownership if issuer_cik is None else ownership.where(F.col("issuer_cik") == issuer_cik)
    person = F.coalesce("reporting_person_cik", "reporting_person_name")
    rows = first_per_key(rows.withColumn("_person", person), ["issuer_cik", "_person"], [any_date("filing_date").desc_nulls_last(), F.col("accession_number").desc(), F.col("person_index")]).drop("_person")
    return top_per_key(rows, ["issuer_cik"], [F.coalesce("percent_of_class", F.lit(-1.0)).desc(), F.col("reporting_person_name").asc_nulls_last()], size, "rank")


def fund_structure(series: DataFrame, *, lei: str | None = None, cik: str | None = None, series_id: str | None = None, class_id: str | None = None, ticker: str | None = None) -> DataFrame:
    """Series of a fund given by one of its identifiers; tickers compare without case."""
    if lei:
        return find(series, either=[{"series_lei": lei}, {"registrant_lei": lei}], sort=[("series_id", "asc")])
    given = {"cik": cik, "series_id": series_id, "class_ids": class_id, "tickers": ticker and ticker.upper()}
    where = {k: v for k, v in given.items() if v}
    if not where:
        raise ValueError("give one identifier")
    return find(series, where, sort=[("series_id", "asc")])


def security(securities: DataFrame, *, cusip: str | None = None, ticker: str | None = None, figi: str | None = None) -> DataFrame:
    where = {k: v for k, v in {"cusip": cusip and cusip.upper(), "tickers": ticker and ticker.upper(), "figis": figi}.items() if v}
    if not where:
        raise ValueError("give one identifier")
    return find(securities, where, sort=[("cusip", "asc")])


def known_on(observations: DataFrame, as_of: str, keys: tuple[str, ...] = ("cik", "tag", "unit"), ties: str = "accession_number") -> DataFrame:
    """What was known on a day: of each period that had ended, the value filed last by then."""
    seen = observations.where((F.col("filed") <= as_of) & (F.col("period_end") <= as_of))
    return first_per_key(seen, [*keys, "period_start", "period_end"], [F.col("filed").desc(), F.col(ties).desc()])


def series_change(observations: DataFrame, keys: tuple[str, ...] = ("cik", "tag", "unit")) -> DataFrame:
    """The last observation of each series and its change against the one before."""
    order = Window.partitionBy(*keys).orderBy(F.col("period_end").desc(), F.col("filed").desc())
    out = observations.withColumns({"previous": F.lead("value").over(order), "_n": F.row_number().over(order)}).where("_n = 1").drop("_n")
    return out.withColumn("percent_change", percent_change("value", "previous"))


def balance_checks(observations: DataFrame) -> DataFrame:
    """Per issuer and period end with both sides: whether assets balance, and the current ratio."""
    tag = lambda name: F.max(F.when(F.col("tag") == name, F.col("value")))
    sides = observations.groupBy("cik", "period_end").agg(tag("Assets").alias("assets"), tag("LiabilitiesAndStockholdersEquity").alias("others"), tag("AssetsCurrent").alias("current_assets"), tag("LiabilitiesCurrent").alias("current_liabilities"))
    return sides.withColumns({"balances": balances("assets", "others"), "current_ratio": ratio("current_assets", "current_liabilities")})


def resolve_issuer(issuers: DataFrame, text: str) -> DataFrame:
    """Issuers by CIK, ticker, or present or former name."""
    plain = text.strip()
    former = F.exists(F.coalesce("former_names", F.array().cast("array<string>")), lambda n: F.lower(n) == plain.lower())
    return issuers.where((F.col("cik") == pad_cik(F.lit(plain))) | F.array_contains(F.coalesce("tickers", F.array().cast("array<string>")), plain.upper()) | (F.lower("entity_name") == plain.lower()) | former)


def search_pages(pages: DataFrame, phrase: str, size: int = 10) -> DataFrame:
    """Pages that hold a phrase, with the text around its first place and the numbers in it."""
    found = pages.where(F.contains(F.lower(F.col("text")), F.lit(phrase.lower()))).withColumn("found", snippet("text", phrase))
    out = found.select(*[c for c in pages.columns if c != "text"], "found.*").withColumn("numbers", F.regexp_extract_all("snippet", F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0)))
    return out.orderBy("pdf_file_name", "page_number").limit(size) if {"pdf_file_name", "page_number"} <= set(pages.columns) else out.limit(size)


def reviewed_decisions(decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Decisions with all reviews of the same record and LEI, oldest first."""
    grouped = reviews.groupBy("node_id", "lei").agg(F.sort_array(F.collect_list(F.struct("reviewed_at", "line_no", "outcome", "reviewer", "rationale"))).alias("reviews"))
    return decisions.join(grouped, ["node_id", "lei"], "left")


def review_queue(decisions: DataFrame, reviews: DataFrame, decision: str = "REVIEW", offset: int = 0, limit: int = 25) -> DataFrame:
    """A page of the decisions that wait for a person, best scores first."""
    done = reviews.select("node_id", "lei").distinct()
    return decisions.where(F.col("decision") == decision).join(done, ["node_id", "lei"], "left_anti").orderBy(F.col("score").desc_nulls_last(), "node_id").offset(offset).limit(limit)


def cusip_holders(holdings: DataFrame, filers: DataFrame, cusip: str, size: int = 25) -> DataFrame:
    """Filers that hold a security, each by its newest and largest row."""
    rows = first_per_key(holdings.where(F.col("cusip") == cusip), ["cik"], [F.col("period_date").desc_nulls_last(), F.col("value_usd").desc_nulls_last()])
    return rows.select("cik", "cusip", "period_date", "value_usd").join(filers.select("cik", "filer_name", "lei"), "cik", "left").orderBy(F.col("value_usd").desc_nulls_last(), "cik").limit(size)


def entity_profile(documents: DataFrame, filers: DataFrame | None = None, funds: DataFrame | None = None, lei: str | None = None) -> DataFrame:
    """Entities with the summaries of their filings and fund reports; all of them, or one."""
    out = documents if lei is None else documents.where(F.col("entity_id") == lei)
    for side, key, name in ((filers, "lei", "filings"), (funds, "series_lei", "fund")):
        if side is not None:
            nested = side.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("entity_id")).agg(F.sort_array(F.collect_list(F.to_json(F.struct(*side.columns)))).alias(name))
            out = out.join(nested, "entity_id", "left")
    return out


def search_entities(text: str, kind: str, register: DataFrame, holdings: DataFrame | None = None, filers: DataFrame | None = None, country: str | None = None, size: int = 10) -> DataFrame:
    """Entities by LEI, by a security they hold, or by name."""
    from .matching import build_index, build_queries, search

    if kind == "lei":
        return register.where(F.col("lei") == text.strip().upper()).select("lei", "legal_name", "jurisdiction")
    if kind == "cusip":
        return cusip_holders(holdings, filers, text.strip().upper(), size)
    if kind != "name":
        raise ValueError(f"kind is lei, cusip or name, not {kind}")
    spark = register.sparkSession
    asked = build_queries(spark.createDataFrame([("q", text, country)], "query_id string, name string, country string"), "name", "country")
    return search(asked, register, build_index(register), size).select("lei", "legal_name", "jurisdiction", "retrieval_score", "retrieval_rank").orderBy("retrieval_rank")


def record_review(reviews: DataFrame, node_id: str, lei: str, outcome: str, reviewer: str, reviewed_at: str, rationale: str | None = None) -> DataFrame:
    """reviews and a new one at the end."""
    if outcome.upper() not in ("CONFIRMED", "REJECTED", "UNSURE"):
        raise ValueError(f"no such outcome: {outcome}")
    line = (reviews.agg(F.max("line_no")).first()[0] or 1) + 1
    row = reviews.sparkSession.createDataFrame([(node_id, lei, outcome.upper(), reviewer, reviewed_at, rationale, line)], "node_id string, lei string, outcome string, reviewer string, reviewed_at string, rationale string, line_no int")
    return reviews.unionByName(row)
