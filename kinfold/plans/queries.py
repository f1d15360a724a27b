"""Every registered query of the library, each beside the SQL that another engine checks it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.config import Benchmark, Matching, ScaleCheck, Serving
from kinfold.functions import formulas, names, places
from kinfold.functions.columns import as_bigint, compact_date, double_text, filing_date, latest_value, nested_list, us_date
from kinfold.functions.fuzzy import token_set_ratio
from kinfold.operators import entities, evaluation, family, filings, gates, graph, hierarchy, matching, reads, relational, serving
from kinfold.streaming.latest import windowed_totals

from .base import catalog, raw_names, register, stored_register, table, with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_tables(sql)
        return f

    return keep


# --- latest rows, top rows, nested lists ---

_MONTHLY = """
WITH m AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, l_partkey, sum(l_extendedprice) AS v, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
last AS (SELECT o_custkey, max(month) AS month FROM m GROUP BY 1),
r AS (SELECT m.*, row_number() OVER (PARTITION BY m.o_custkey ORDER BY round(v, 2) DESC, l_partkey) AS rn FROM m JOIN last ON m.o_custkey = last.o_custkey AND m.month = last.month)
SELECT r.o_custkey, c_name, r.month, count(*) AS n_parts, sum(n)::BIGINT AS n_lines, max(CASE WHEN rn = 1 THEN p_name END) AS top_part, round(sum(CASE WHEN rn <= 10 THEN v END), 2) AS top_value
FROM r JOIN customer ON r.o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL
"""


def latest_month_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: the latest month, its number of parts and lines, and the ten parts of most value as a nested list."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    parts = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "month", "l_partkey").agg(F.sum("l_extendedprice").alias("value"), F.count("*").alias("n"))
    parts = parts.withColumn("newest", F.max("month").over(Window.partitionBy("o_custkey"))).where("month = newest")
    parts = parts.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    totals = parts.groupBy("o_custkey", "month").agg(F.count("*").alias("n_parts"), F.sum("n").alias("n_lines"))
    top = relational.top_per_key(parts, ["o_custkey"], [F.round("value", 2).desc(), F.col("l_partkey")], Serving().top_holdings, "rank")
    top = top.groupBy("o_custkey").agg(nested_list([F.col("rank")], F.struct("p_name", "value", "l_partkey")).alias("top"))
    return totals.join(top, "o_custkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")


@query(_MONTHLY)
def latest_period_top_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = latest_month_holdings(spark, sf_dir)
    return df.select("o_custkey", "c_name", "month", "n_parts", "n_lines", F.col("top")[0]["p_name"].alias("top_part"), F.round(F.aggregate("top", F.lit(0.0), lambda a, t: a + t["value"]), 2).alias("top_value"))


@query("""
WITH u AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS snapshot_date, o_orderkey, NULL AS note FROM orders
  UNION ALL BY NAME SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') END AS snapshot_date, o_orderkey + 10000000 AS o_orderkey, 'copy' AS note FROM orders WHERE o_orderkey % 2 = 0)
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY snapshot_date DESC NULLS LAST, o_orderkey) = 1
""")
def dedupe_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    one = orders.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("snapshot_date"), "o_orderkey")
    two = orders.where("o_orderkey % 2 = 0").selectExpr("o_custkey", "CASE WHEN o_orderkey % 3 <> 0 THEN date_format(date_add(o_orderdate, 1), 'yyyy-MM-dd') END AS snapshot_date", "o_orderkey + 10000000 AS o_orderkey", "'copy' AS note")
    return relational.dedupe_latest(relational.union_by_name([one, two]), ["o_custkey"], ties=["o_orderkey"])


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, strftime(o_orderdate, '%d-%b-%Y').upper() AS filed FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def distinct_on_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy")).alias("filed"))
    return relational.first_per_key(orders, ["o_custkey"], [filing_date("filed").desc_nulls_last(), F.col("o_orderkey")])


@query("SELECT o_custkey, arg_max(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS newest FROM orders GROUP BY o_custkey")
def arg_max_latest_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey", "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS v", "concat(date_format(o_orderdate, 'yyyy-MM-dd'), lpad(string(o_orderkey), 12, '0')) AS d")
    return orders.groupBy("o_custkey").agg(latest_value("v", "d").alias("newest"))


@query("""
WITH r AS (SELECT l_suppkey, l_returnflag, l_partkey, l_orderkey, l_linenumber, l_quantity, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS total, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS rank FROM lineitem)
SELECT l_suppkey, l_returnflag, total, rank, l_partkey, l_quantity FROM r WHERE rank <= 5
""")
def holding_rank_and_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    group = ["l_suppkey", "l_returnflag"]
    totals = lines.groupBy(*group).agg(F.count("*").alias("total"))
    top = relational.top_per_key(lines, group, [F.col("l_quantity").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 5, "rank")
    return top.join(totals, group).select(*group, "total", "rank", "l_partkey", "l_quantity")


@query("""
WITH r AS (SELECT l_suppkey, l_shipdate, l_orderkey || ':' || l_linenumber AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey || ':' || l_linenumber) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS identifier_total FROM lineitem)
SELECT l_suppkey, any_value(identifier_total) AS identifier_total, count(*) AS kept, min(v) AS first_value, max(v) AS last_value FROM r WHERE rn <= 20 GROUP BY l_suppkey
""")
def identifier_cap_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "concat(l_orderkey, ':', l_linenumber) AS v")
    kept = relational.top_per_key(ids, ["l_suppkey"], [F.col("v")], 20).groupBy("l_suppkey").agg(nested_list([F.col("v")], F.struct("v")).alias("ids"))
    totals = ids.groupBy("l_suppkey").agg(F.count("*").alias("identifier_total"))
    return totals.join(kept, "l_suppkey").select("l_suppkey", "identifier_total", F.size("ids").cast("long").alias("kept"), F.col("ids")[0]["v"].alias("first_value"), F.element_at("ids", -1)["v"].alias("last_value"))


# --- reports and their amendments ---


@query("SELECT accession_number, cik, value_unit, count(*) AS n, sum(value_usd)::BIGINT AS value_usd FROM effective GROUP BY ALL")
def amendment_effective_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    checked = filings.validate(c["sec_13f_filings"], c["sec_13f_summaries"], c["sec_13f_holdings"])
    out = filings.effective_holdings(c["sec_13f_filings"], c["sec_13f_holdings"], checked)
    return out.groupBy("accession_number", "cik", "value_unit").agg(F.count("*").alias("n"), F.sum("value_usd").alias("value_usd"))


@query("SELECT accession_number, declared_entry_total, observed_entry_total, declared_value_total::BIGINT AS declared_value_total, observed_value_total, value_unit, action AS amendment_action, errors, errors = '' AS valid FROM checked")
def summary_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    out = filings.validate(c["sec_13f_filings"], c["sec_13f_summaries"], c["sec_13f_holdings"])
    return out.select("accession_number", "declared_entry_total", "observed_entry_total", "declared_value_total", "observed_value_total", "value_unit", "amendment_action", F.array_join("errors", ",").alias("errors"), "valid")


@query("SELECT accession_number, errors FROM checked WHERE errors <> ''")
def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    out = filings.quarantine(filings.validate(c["sec_13f_filings"], c["sec_13f_summaries"], c["sec_13f_holdings"]))
    return out.select("accession_number", F.array_join("errors", ",").alias("errors"))


_SCALE = ScaleCheck(min_filers=2, min_rows=1, low=0.0002, high=0.01)


@query("""
WITH p AS (SELECT accession_number, cik, period, cusip, value_usd / shares AS price FROM effective WHERE value_unit = 'USD' AND put_call IS NULL AND kind = 'SH' AND shares > 0 AND value_usd > 0),
c AS (SELECT period, cusip, median(price) AS usual FROM p GROUP BY ALL HAVING count(DISTINCT cik) >= 2)
SELECT accession_number, any_value(cik) AS cik, count(*) AS compared_rows, round(median(price / usual), 6) AS median_price_ratio, count(*) >= 1 AND median(price / usual) BETWEEN 0.0002 AND 0.01 AS looks_like_thousands
FROM p JOIN c ON p.period = c.period AND p.cusip = c.cusip GROUP BY accession_number
""")
def value_scale_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    checked = filings.validate(c["sec_13f_filings"], c["sec_13f_summaries"], c["sec_13f_holdings"])
    out = filings.scale_checks(filings.effective_holdings(c["sec_13f_filings"], c["sec_13f_holdings"], checked), _SCALE)
    return out.select("accession_number", "cik", "compared_rows", F.round("median_price_ratio", 6).alias("median_price_ratio"), "looks_like_thousands")


# --- validation and profiles ---


@query("""
WITH t AS (SELECT nullif(c_mktsegment, 'BUILDING') AS segment, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS name, c_acctbal AS balance FROM customer)
SELECT 'segment' AS column_name, round(avg((segment IS NULL)::INT), 4) AS null_rate FROM t UNION ALL SELECT 'name', round(avg((name IS NULL)::INT), 4) FROM t UNION ALL SELECT 'balance', round(avg((balance IS NULL)::INT), 4) FROM t
""")
def null_rate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.null_rates(table(spark, sf_dir, "customer").selectExpr("nullif(c_mktsegment, 'BUILDING') AS segment", "CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS name", "c_acctbal AS balance"))


@query("SELECT sum(n - 1)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey)")
def duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.surplus_rows(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("""
WITH bad AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN lower(lei) ELSE lei END AS lei, CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE legal_name END AS legal_name FROM register)
SELECT 'rows' AS "check", count(*)::DOUBLE AS value FROM bad UNION ALL SELECT 'malformed_lei', count(*) FILTER (WHERE NOT regexp_full_match(lei, '[0-9A-Z]{18}[0-9]{2}')) FROM bad
UNION ALL SELECT 'missing_name', count(*) FILTER (WHERE trim(coalesce(legal_name, '')) = '') FROM bad UNION ALL SELECT 'distinct_lei', count(DISTINCT lei) FROM bad UNION ALL SELECT 'duplicate_lei', 0
UNION ALL SELECT 'null_rate:lei', 0 UNION ALL SELECT 'null_rate:legal_name', 0
""")
def validate_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = register(spark, sf_dir).withColumn("k", F.substring("lei", 4, 15).cast("long")).selectExpr("CASE WHEN k % 11 = 0 THEN lower(lei) ELSE lei END AS lei", "CASE WHEN k % 13 = 0 THEN ' ' ELSE legal_name END AS legal_name")
    return evaluation.validate_entities(bad)


@query("""
WITH ends AS (SELECT s AS lei FROM relationships UNION ALL SELECT e FROM relationships), known AS (SELECT lei FROM register WHERE p_partkey % 3 <> 0)
SELECT count(*) AS total, count(*) FILTER (WHERE lei IN (SELECT lei FROM known)) AS known, round(count(*) FILTER (WHERE lei IN (SELECT lei FROM known)) / count(*), 6) AS coverage, 0::BIGINT AS duplicates FROM ends
""")
def referential_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = register(spark, sf_dir).where("bigint(substring(lei, 4, 15)) % 3 <> 0")
    return evaluation.validate_relationships(catalog(spark, sf_dir)["gleif_relationships"], known)


@query("""
SELECT 'orders' AS table_name, count(*) AS row_count, strftime(max(o_orderdate), '%Y-%m-%d') AS latest_snapshot, 'o_custkey,o_orderkey,snapshot_date' AS columns FROM orders
UNION ALL SELECT 'part', count(*), NULL, 'p_name,p_partkey' FROM part
""")
def coverage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy"))).alias("snapshot_date"))
    out = serving.coverage({"orders": orders, "part": table(spark, sf_dir, "part").select("p_partkey", "p_name")})
    return out.withColumn("latest_snapshot", F.col("latest_snapshot").cast("string"))


@query("SELECT k, count(*) AS n FROM (SELECT l_suppkey AS k FROM lineitem UNION ALL SELECT o_custkey FROM orders) GROUP BY k ORDER BY n DESC, k LIMIT 20")
def top_frequency_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.top_values([table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))], "k", 20)


@query("""
WITH o AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders),
f AS (SELECT * FROM o WHERE o_orderstatus IN ('O', 'P') AND (o_custkey % 2 = 0 OR o_custkey % 3 = 0) AND priority IS NULL),
one AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) = 1)
SELECT o_custkey, o_orderkey, o_totalprice FROM one ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 5
""")
def store_find_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumns({"priority": F.expr("CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END"), "even": F.expr("o_custkey % 2 = 0"), "third": F.expr("o_custkey % 3 = 0")})
    return relational.find(orders, where={"o_orderstatus": ["O", "P"]}, either=[{"even": True}, {"third": True}], missing=["priority"], sort=[("o_totalprice", "desc"), ("o_orderkey", "asc")], collapse="o_custkey", size=25, offset=5, fields=["o_custkey", "o_orderkey", "o_totalprice"])


# --- names, places, dates, numbers ---


@query("""
SELECT p_partkey, norm, core, CASE WHEN regexp_extract(core, '[^ ]+$') SIMILAR TO '[0-9]{1,3}' THEN regexp_extract(core, '[^ ]+$')::INT ELSE (CASE regexp_extract(core, '[^ ]+$') WHEN 'ii' THEN 2 WHEN 'iii' THEN 3 END) END AS fund_number,
  list_contains(tokens, 'master') AS is_master, list_contains(tokens, 'feeder') AS is_feeder, replace(norm, ' ', '') AS compact,
  trim(regexp_replace(trim(regexp_replace(regexp_replace(core, '\\b(master|feeder|offshore|domestic|umbrella)\\b', '', 'g'), '\\s+', ' ', 'g')), '\\s(i|ii|iii|iv|v|vi|vii|viii|ix|x|[0-9]{1,3})$', '')) AS aggressive
FROM cores
""")
def normalise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = raw_names(spark, sf_dir)
    fields = names.name_fields("name")
    core = fields["legal_name_core"]
    return df.select("p_partkey", fields["legal_name_norm"].alias("norm"), core.alias("core"), fields["fund_number"].alias("fund_number"), fields["is_master"].alias("is_master"), fields["is_feeder"].alias("is_feeder"), names.compact(fields["legal_name_norm"]).alias("compact"), names.aggressive_core(core).alias("aggressive"))


_TAIL = "|".join(dict.fromkeys([*names.BUSINESS_WORDS, *names.PLACE_WORDS]))
_ANY = "|".join(dict.fromkeys([*names.BUSINESS_WORDS, *names.PLACE_WORDS, *names.LEGAL_SUFFIXES]))


@query(rf"""
WITH b AS (SELECT p_partkey, core, CASE WHEN regexp_full_match(core, '.+ ({_TAIL})') THEN regexp_replace(core, '( ({_ANY}))*( ({_TAIL}))$', '') ELSE core END AS brand FROM cores)
SELECT p_partkey, brand, CASE WHEN brand = 'red widget brand#17' THEN 'high' WHEN starts_with(brand, 'red widget brand#17 ') THEN 'possible' END AS tier FROM b
""")
def brand_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = raw_names(spark, sf_dir).select("p_partkey", names.brand_core("name").alias("brand"))
    return df.select("p_partkey", "brand", names.brand_tier(F.lit("red widget brand#17"), "brand").alias("tier"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'EC2N4AG' WHEN 1 THEN '12345' WHEN 2 THEN NULL ELSE 'SW1A1AA' END AS postcode, CASE c_custkey % 4 WHEN 0 THEN 'EC2N' WHEN 3 THEN 'SW1A' END AS outward,
  CASE c_custkey % 5 WHEN 0 THEN 'GB' WHEN 1 THEN 'GB' WHEN 2 THEN 'KY' WHEN 3 THEN 'US' END AS country, CASE c_custkey % 5 WHEN 0 THEN 'GB' WHEN 1 THEN 'GB-ENG' WHEN 2 THEN 'KY' WHEN 3 THEN 'US' END AS code,
  lpad(c_custkey::VARCHAR, 10, '0') AS cik, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'ABC' || c_custkey END AS cusip, 'new york' AS city, regexp_full_match('LEI' || lpad(c_custkey::VARCHAR, 15, '0') || CASE WHEN c_custkey % 2 = 0 THEN '00' ELSE 'x0' END, '[0-9A-Z]{18}[0-9]{2}') AS is_lei
FROM customer
""")
def places_and_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "CASE c_custkey % 4 WHEN 0 THEN 'ec2n 4ag' WHEN 1 THEN '12345' WHEN 2 THEN ' - ' ELSE 'SW1A-1AA' END AS postcode", "CASE c_custkey % 5 WHEN 0 THEN ' uk ' WHEN 1 THEN 'GB-ENG' WHEN 2 THEN 'Cayman Islands' WHEN 3 THEN 'usa' ELSE '' END AS country",
        "concat('000', c_custkey) AS cik", "CASE WHEN c_custkey % 3 = 0 THEN '000000000' ELSE concat(' abc', c_custkey) END AS cusip", "' New   York ' AS city", "concat('LEI', lpad(string(c_custkey), 15, '0'), CASE WHEN c_custkey % 2 = 0 THEN '00' ELSE 'x0' END) AS lei",
    )
    zip_ = places.normalize_postcode("postcode")
    return df.select("c_custkey", zip_.alias("postcode"), places.postcode_outward(zip_).alias("outward"), places.country_of_jurisdiction("country").alias("country"), places.country_code("country").alias("code"), F.when(F.col("c_custkey") == 0, "0" * 10).otherwise(places.pad_cik("cik")).alias("cik"), places.clean_cusip("cusip").alias("cusip"), places.normalize_city("city").alias("city"), places.is_lei("lei").alias("is_lei"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS filed, strftime(o_orderdate, '%Y-%m-%d') AS us, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS compact,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice)::BIGINT END AS whole, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey || '.0' ELSE o_orderkey || '.5' END AS text
FROM orders
""")
def dates_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "upper(date_format(o_orderdate, 'd-MMM-yyyy')) AS a", "date_format(o_orderdate, 'M/d/yyyy') AS b", "CASE WHEN o_orderkey % 5 <> 0 THEN date_format(o_orderdate, 'yyyyMMdd') ELSE '99991231' END AS c", "CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE string(o_totalprice) END AS d", "o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 0D ELSE 0.5D END AS e"
    )
    return df.select("o_orderkey", filing_date("a").cast("string").alias("filed"), us_date("b").alias("us"), compact_date("c").alias("compact"), as_bigint("d").alias("whole"), double_text("e").alias("text"))


@query("""
SELECT l_orderkey, l_linenumber, round(l_extendedprice + l_tax, 2) AS total, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 4) END AS ratio, CASE WHEN l_discount = 0 THEN NULL ELSE round((l_tax - l_discount) * 100 / l_discount, 2) END AS change, round(l_tax * 100 / l_quantity, 2) AS share, abs(l_tax - l_discount) <= 0.005 * greatest(l_tax, l_discount, 1) AS balances
FROM lineitem
""")
def derived_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = {k: v.compute for k, v in formulas.FORMULAS.items()}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(f["sum"]("l_extendedprice", "l_tax"), 2).alias("total"), f["ratio"]("l_tax", "l_discount").alias("ratio"), f["percent_change"]("l_tax", "l_discount").alias("change"), f["percent_of"]("l_tax", "l_quantity").alias("share"), formulas.balances("l_tax", "l_discount").alias("balances"))


#: A CRC-32 checksum of lei, bit by bit.
_CRC32 = """xor(list_reduce(list_transform(string_split(lei, ''), lambda c: ascii(c)::BIGINT),
  lambda c, x: list_reduce(range(8)::BIGINT[], lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, x)), 4294967295::BIGINT), 4294967295::BIGINT)"""
_VARIANTS = f"variants AS (SELECT *, CASE bucket WHEN 0 THEN legal_name WHEN 1 THEN legal_name_core ELSE replace(legal_name_core, ' ', '') END AS query_name, CASE bucket WHEN 0 THEN 'easy' ELSE 'medium' END AS difficulty FROM (SELECT *, {_CRC32} % 3 AS bucket FROM register))"


@query(f"WITH {_VARIANTS} SELECT lei, query_name, difficulty FROM variants")
def name_variant_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    query_, difficulty = evaluation.name_variant("lei", "legal_name", "legal_name_core")
    return register(spark, sf_dir).select("lei", query_.alias("query_name"), difficulty.alias("difficulty"))


#: Length of the longest common subsequence of da and db: a row of the table for each character of da.
_LCS = """list_reduce(list_transform(string_split(da, ''), lambda c: [unicode(c)]),
  lambda p, x: list_reduce(list_transform(range(1, length(db) + 1), lambda j: [j]), lambda r, j: list_append(r, CASE WHEN unicode(db[j[1]]) = x[1] THEN p[j[1]] + 1 ELSE greatest(p[j[1] + 1], r[j[1]]) END), [0::BIGINT]),
  list_transform(range(length(db) + 1), lambda z: 0::BIGINT))[-1]"""
#: ratios (a, b, ratio) of the rows of pairs (a, b).
_RATIOS = f"""
sets AS (SELECT DISTINCT a, b, list_sort(list_distinct(list_filter(string_split(coalesce(a, ''), ' '), lambda w: w <> ''))) AS x, list_sort(list_distinct(list_filter(string_split(coalesce(b, ''), ' '), lambda w: w <> ''))) AS y FROM pairs),
parts AS (SELECT a, b, len(x) AS nx, len(y) AS ny, array_to_string(list_filter(x, lambda w: list_contains(y, w)), ' ') AS i, array_to_string(list_filter(x, lambda w: NOT list_contains(y, w)), ' ') AS da, array_to_string(list_filter(y, lambda w: NOT list_contains(x, w)), ' ') AS db FROM sets),
lengths AS (SELECT *, length(i)::DOUBLE AS s, (i <> '')::INT AS sep, length(da)::DOUBLE AS m, length(db)::DOUBLE AS n, {_LCS} AS lcs FROM parts),
ratios AS (SELECT a, b, CASE WHEN nx = 0 OR ny = 0 THEN 0 WHEN i <> '' AND (da = '' OR db = '') THEN 1
  ELSE greatest(CASE WHEN i = '' THEN 0 ELSE greatest(1 - (sep + m) / (2 * s + sep + m), 1 - (sep + n) / (2 * s + sep + n)) END, 1 - (m + n - 2 * lcs) / greatest(2 * (s + sep) + m + n, 1)) END::DOUBLE AS ratio FROM lengths)
"""


@query(f"WITH pairs AS (SELECT x.legal_name_norm AS a, y.legal_name_norm AS b FROM register x JOIN register y ON x.p_partkey + 64 = y.p_partkey), {_RATIOS} SELECT x.lei, a, b, round(ratio, 6) AS ratio FROM register x JOIN register y ON x.p_partkey + 64 = y.p_partkey JOIN ratios ON a = x.legal_name_norm AND b = y.legal_name_norm")
def token_set_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = register(spark, sf_dir).select("lei", F.col("legal_name_norm").alias("a"), (F.substring("lei", 4, 15).cast("long") + 64).alias("k"))
    b = register(spark, sf_dir).select(F.substring("lei", 4, 15).cast("long").alias("k"), F.col("legal_name_norm").alias("b"))
    return a.join(b, "k").select("lei", "a", "b", F.round(token_set_ratio("a", "b"), 6).alias("ratio"))


# --- retrieval and matching ---


def _queries(entries: DataFrame) -> DataFrame:
    rows = entries.where("bigint(substring(lei, 4, 15)) % 20 = 0").selectExpr("lei AS query_id", "legal_name AS name", "CASE WHEN bigint(substring(lei, 4, 15)) % 40 = 0 THEN 'UK' ELSE 'Cayman' END AS country", "legal_postcode AS postcode", "legal_city AS city", "registration_id")
    return matching.build_queries(rows, "name", "country", "postcode", "city", "registration_id")


_BM25 = """
WITH rows AS (SELECT lei, 'norm' AS field, string_split(legal_name_norm, ' ') AS w FROM register UNION ALL SELECT lei, 'core', string_split(legal_name_core, ' ') FROM register WHERE legal_name_core <> '' UNION ALL SELECT lei, 'alias', string_split(aliases, ' ') FROM register WHERE aliases <> ''),
stats AS (SELECT field, count(*) AS docs, avg(len(w)) AS mean FROM rows GROUP BY 1),
tf AS (SELECT field, lei, len(w) AS length, t, count(*) AS tf FROM (SELECT field, lei, w, unnest(w) AS t FROM rows) GROUP BY ALL),
df AS (SELECT field, t, count(*) AS df FROM tf GROUP BY 1, 2),
idx AS (SELECT t, tf.field, lei, (CASE tf.field WHEN 'norm' THEN 5 WHEN 'core' THEN 3 ELSE 2 END) * ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS weight
  FROM tf JOIN df USING (field, t) JOIN stats USING (field)),
{asking},
q AS (SELECT query_id, q_norm AS norm, q_country AS country FROM asking),
asked AS (SELECT DISTINCT query_id, unnest(string_split(norm, ' ')) AS t FROM q),
hits AS (SELECT query_id, lei, weight AS hit FROM asked JOIN idx USING (t)
  UNION ALL SELECT query_id, lei, 4.0 FROM q JOIN register r ON replace(q.norm, ' ', '') = replace(r.legal_name_norm, ' ', '')),
total AS (SELECT query_id, lei, sum(hit) AS hit FROM hits GROUP BY ALL),
scored AS (SELECT t.query_id, t.lei, {score} AS score FROM total t JOIN q ON t.query_id = q.query_id JOIN register r ON t.lei = r.lei {where}),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, lei) AS retrieval_rank FROM scored)
"""
_OF_KEY = """CASE WHEN {k} % 3 = 0 THEN 'EC' || {k} % 9 || 'N4AG' END AS {p}postcode, CASE WHEN {k} % 3 = 0 THEN 'EC' || {k} % 9 || 'N' END AS {p}outward, CASE WHEN {k} % 2 = 0 THEN 'london' END AS {p}city, CASE WHEN {k} % 6 = 0 THEN 'R' || {k} END AS {p}reg"""
#: The queries asked: every 20th entity, with its own data and a country that is often wrong.
_EACH_20TH = f"""asking AS (SELECT lei AS query_id, legal_name AS q_name, legal_name_norm AS q_norm, legal_name_core AS q_core, fund_number AS q_number, is_master AS q_master, is_feeder AS q_feeder, CASE WHEN p_partkey % 40 = 0 THEN 'GB' ELSE 'KY' END AS q_country,
  {_OF_KEY.format(k='p_partkey', p='q_')} FROM register WHERE p_partkey % 20 = 0)"""


def _soft(asking: str) -> str:
    return _BM25.format(asking=asking, score="CASE WHEN q.country IS NULL THEN hit WHEN r.legal_country = q.country THEN hit + 8 ELSE hit * 0.3 END", where="")


_SEARCHED = "SELECT query_id, retrieval_rank, round(score, 4) AS score FROM found WHERE retrieval_rank <= 20"


def _scored(most: int, asking: str = _EACH_20TH) -> str:
    """CTEs up to scores: candidates of each query with every feature, its points and the score."""
    worth = {
        "name_exact": "100", "name_core_exact": "60", "country_exact": "15", "jurisdiction_exact": "25", "postcode_exact": "35", "postcode_prefix_exact": "15", "city_exact": "10", "registration_id_exact": "250",
        "fund_number_exact": "20", "fund_number_conflict": "-100", "master_conflict": "-80", "feeder_conflict": "-80", "registration_id_conflict": "-250",
    }
    shown = {f: f"CASE WHEN {f} THEN {w}.0 ELSE 0.0 END::DOUBLE" for f, w in worth.items()}
    shown = {"name_exact": shown.pop("name_exact"), "name_core_exact": shown.pop("name_core_exact"), "name_ratio": "40 * name_ratio", **shown}
    listed = ", ".join(f"""CASE WHEN round({x}, 2) <> 0 THEN '"{f}":' || round({x}, 2)::DOUBLE::VARCHAR END""" for f, x in shown.items())
    return f"""{_soft(asking)},
given AS (SELECT *, {_OF_KEY.format(k='p_partkey', p='')} FROM register),
pairs AS (SELECT DISTINCT q_norm AS a, legal_name_norm AS b FROM found f JOIN asking USING (query_id) JOIN given g ON f.lei = g.lei WHERE retrieval_rank <= {most}),
{_RATIOS},
features AS (SELECT f.query_id, q_name, f.lei, retrieval_rank, q_master, q_feeder, is_master, is_feeder, q_country, q_postcode, q_reg,
  q_norm = legal_name_norm AS name_exact, q_core <> '' AND q_core = legal_name_core AS name_core_exact, ratio AS name_ratio, CASE WHEN q_country IS NOT NULL AND legal_country IS NOT NULL THEN split_part(q_country, '-', 1) = legal_country END AS country_exact, CASE WHEN q_country IS NOT NULL THEN q_country = coalesce(jurisdiction, '') END AS jurisdiction_exact,
  CASE WHEN q_postcode IS NOT NULL THEN coalesce(q_postcode = postcode, false) END AS postcode_exact, CASE WHEN q_outward IS NOT NULL AND outward IS NOT NULL THEN q_outward = outward END AS postcode_prefix_exact, CASE WHEN q_city IS NOT NULL THEN coalesce(lower(q_city) = city, false) END AS city_exact,
  CASE WHEN q_reg IS NOT NULL THEN coalesce(q_reg = reg, false) END AS registration_id_exact, q_number = fund_number AS fund_number_exact, coalesce(q_number <> fund_number, false) AS fund_number_conflict,
  (q_master OR q_feeder) AND q_master <> is_master AS master_conflict, (q_master OR q_feeder) AND q_feeder <> is_feeder AS feeder_conflict, coalesce(q_reg <> reg, false) AS registration_id_conflict
  FROM found f JOIN asking USING (query_id) JOIN given g ON f.lei = g.lei JOIN ratios ON a = q_norm AND b = legal_name_norm WHERE retrieval_rank <= {most}),
scores AS (SELECT *, 0.0::DOUBLE + {' + '.join(shown.values())} AS points, '{{{{' || array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), ',') || '}}}}' AS evidence FROM features)
""".replace("{{", "{").replace("}}", "}")


def _searched(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    entries = stored_register(spark, sf_dir)
    found = matching.search(_queries(entries), entries, matching.build_index(entries), 20, mode)
    return found.select("query_id", "retrieval_rank", F.round("retrieval_score", 4).alias("score"))


@query(_soft(_EACH_20TH) + _SEARCHED)
def soft_country_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "soft")


@query(_BM25.format(asking=_EACH_20TH, score="hit", where="WHERE r.legal_country = q.country") + _SEARCHED)
def strict_country_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "strict")


@query("""
WITH s AS (SELECT l_orderkey AS query_id, l_partkey AS lei, l_linenumber AS rank0, (l_quantity * 5)::DOUBLE AS score, l_partkey % 5 = 0 AS is_master, l_partkey % 7 = 0 AS is_feeder FROM lineitem),
r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS other, lead(lei) OVER w AS runner, lead(is_master) OVER w AS om, lead(is_feeder) OVER w AS orf, max(score) OVER (PARTITION BY query_id) AS top FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, rank0, lei)),
c AS (SELECT *, sum((top - score <= 5)::INT) OVER (PARTITION BY query_id) AS close FROM r),
d AS (SELECT *, score >= 140 AND (other IS NULL OR score - other >= 30) AS auto, runner IS NOT NULL AND query_id % 3 <> 0 AND (is_master <> om OR is_feeder <> orf) AS unclear FROM c WHERE rank = 1)
SELECT query_id, CASE WHEN auto AND NOT unclear THEN 'AUTO_MATCH' WHEN auto OR score >= 90 THEN 'REVIEW' ELSE 'UNMATCHED' END AS decision, CASE WHEN auto OR score >= 90 THEN lei END AS lei, score - other AS gap, runner AS runner_up_lei,
  CASE WHEN NOT (auto AND NOT unclear) AND close > 1 THEN close ELSE 0 END::INT AS n_competing FROM d
""")
def match_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS query_id", "l_partkey AS lei", "l_linenumber AS retrieval_rank", "double(l_quantity * 5) AS score", "l_partkey % 5 = 0 AS is_master", "l_partkey % 7 = 0 AS is_feeder", "l_orderkey % 3 = 0 AS q_is_master", "false AS q_is_feeder",
        "'GB' AS q_country", "'' AS q_postcode", "CAST(NULL AS STRING) AS q_registration_id", "map('x', 1D) AS evidence",
    )
    return matching.decide(rows).select("query_id", "decision", "lei", "gap", "runner_up_lei", F.col("n_competing").cast("int").alias("n_competing"))


#: Of each query the best candidate and what is decided, from scores.
_DECIDED = """best AS (SELECT *, row_number() OVER w AS rank, lead(lei) OVER w AS runner, lead(points) OVER w AS other, lead(is_master) OVER w AS om, lead(is_feeder) OVER w AS orf, max(points) OVER (PARTITION BY query_id) AS top FROM scores WINDOW w AS (PARTITION BY query_id ORDER BY points DESC, retrieval_rank, lei)),
near AS (SELECT *, sum((top - points <= 5)::INT) OVER (PARTITION BY query_id) AS close FROM best),
judged AS (SELECT *, points >= 140 AND (other IS NULL OR points - other >= 30) AS auto, runner IS NOT NULL AND NOT q_master AND NOT q_feeder AND (is_master <> om OR is_feeder <> orf) AS unclear FROM near WHERE rank = 1),
decided AS (SELECT *, CASE WHEN auto AND NOT unclear THEN 'AUTO_MATCH' WHEN auto OR points >= 90 THEN 'REVIEW' ELSE 'UNMATCHED' END AS d FROM judged)"""


@query(f"""{_scored(20)},
{_DECIDED}
SELECT a.query_id, coalesce(d, 'UNMATCHED') AS decision, CASE WHEN d <> 'UNMATCHED' THEN lei END AS lei, CASE WHEN d <> 'UNMATCHED' THEN round(points, 4) END AS score, round(points - other, 4) AS gap, runner AS runner_up_lei,
  CASE WHEN d <> 'AUTO_MATCH' AND close > 1 THEN close WHEN d IS NOT NULL THEN 0 END::BIGINT AS n_competing, CASE WHEN d <> 'UNMATCHED' THEN evidence END AS evidence,
  CASE WHEN d = 'AUTO_MATCH' THEN NULL WHEN close > 1 THEN close || ' candidates lie within 5 points; the query cannot tell them apart' WHEN auto AND unclear THEN 'the best candidates differ in master or feeder status, of which the query says nothing'
    WHEN d = 'REVIEW' THEN 'the best score, ' || round(points)::INT || ', is plausible but not enough to act on' WHEN d IS NOT NULL THEN 'the best score, ' || round(points)::INT || ', is too low' END AS reason,
  CASE WHEN d = 'AUTO_MATCH' THEN '' WHEN d IS NOT NULL THEN concat_ws(',', CASE WHEN decided.q_postcode IS NULL THEN 'postcode' END, CASE WHEN decided.q_reg IS NULL THEN 'registration identifier' END) END AS missing_evidence
FROM asking a LEFT JOIN decided ON a.query_id = decided.query_id
""")
def match_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = stored_register(spark, sf_dir)
    out = matching.match_batch(_queries(entries), entries)
    return out.select("query_id", "decision", "lei", F.round("score", 4).alias("score"), F.round("gap", 4).alias("gap"), "runner_up_lei", "n_competing", F.to_json("evidence").alias("evidence"), "reason", F.array_join("missing_evidence", ",").alias("missing_evidence"))


@query(f"{_scored(5)} SELECT query_id, lei, name_exact, name_core_exact, country_exact, jurisdiction_exact, postcode_exact, postcode_prefix_exact, city_exact, registration_id_exact, fund_number_exact, fund_number_conflict, master_conflict, feeder_conflict, registration_id_conflict, round(name_ratio, 6) AS name_ratio, round(points, 6) AS score, evidence FROM scores")
def match_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = stored_register(spark, sf_dir)
    asked = relational.cut_lineage(_queries(entries))
    scored = matching.score(matching.search(asked, entries, matching.build_index(entries), 5).join(asked, "query_id"))
    return scored.select("query_id", "lei", *[f for f in matching.features() if f != "name_ratio"], F.round("name_ratio", 6).alias("name_ratio"), F.round("score", 6).alias("score"), F.to_json("evidence").alias("evidence"))


_QUERY_FIELDS = f"""q_core, CASE WHEN regexp_extract(q_core, '[^ ]+$') SIMILAR TO '[0-9]{{1,3}}' THEN regexp_extract(q_core, '[^ ]+$')::INT ELSE nullif(coalesce(list_position([{', '.join(f"'{r}'" for r in names.ROMAN)}], regexp_extract(q_core, '[^ ]+$')), 0), 0) END AS q_number,
  list_contains(string_split(q_norm, ' '), 'master') AS q_master, list_contains(string_split(q_norm, ' '), 'feeder') AS q_feeder"""
_CORE = f"regexp_replace(q_norm, '((^| )({'|'.join(names.LEGAL_SUFFIXES)}))+$', '')"
_FILERS = f"""latest AS (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY cik ORDER BY filed DESC, accession_number DESC) = 1),
filers AS (SELECT cik AS query_id, filer_name AS q_name, lower(filer_name) AS q_norm, CASE o_custkey % 3 WHEN 1 THEN 'X0' ELSE 'US' END AS q_country FROM latest),
asking AS (SELECT query_id, q_name, q_norm, q_country, {_QUERY_FIELDS}, '10001' AS q_postcode, NULL AS q_outward, 'London' AS q_city, NULL AS q_reg FROM (SELECT *, {_CORE} AS q_core FROM filers))"""


@query(f"""{_scored(20, _FILERS)},
{_DECIDED}
SELECT a.query_id AS cik, a.q_name AS filer_name, a.q_country AS resolved_country, CASE WHEN d <> 'UNMATCHED' THEN lei END AS lei, coalesce(d, 'UNMATCHED') AS decision, CASE WHEN d <> 'UNMATCHED' THEN round(points, 4) END AS score, '{Matching().fingerprint()}' AS config_hash
FROM asking a LEFT JOIN decided ON a.query_id = decided.query_id
""")
def crosswalk_filers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.crosswalk(catalog(spark, sf_dir)["sec_13f_filings"], stored_register(spark, sf_dir), Matching())
    return out.select("cik", "filer_name", "resolved_country", "lei", "decision", F.round("score", 4).alias("score"), "config_hash")


_BRANDED = f"""branded AS (SELECT *, CASE WHEN regexp_full_match(legal_name_core, '.+ ({_TAIL})') THEN regexp_replace(legal_name_core, '( ({_ANY}))*( ({_TAIL}))$', '') ELSE legal_name_core END AS brand,
  CASE WHEN fund_number IS NOT NULL OR is_master OR is_feeder OR list_has_any(string_split(legal_name_norm, ' '), [{', '.join(f"'{w}'" for w in names.FUND_WORDS)}]) THEN 'fund' ELSE 'management' END AS role FROM register),
asking AS (SELECT lei AS query_id, brand AS q_norm, legal_country AS q_country FROM branded WHERE p_partkey % 100 = 0)"""


@query(f"""{_soft(_BRANDED)},
members AS (SELECT f.query_id, b.lei, CASE WHEN b.brand = o.brand THEN 'high' WHEN starts_with(b.brand, o.brand || ' ') THEN 'possible' END AS tier, b.role FROM found f JOIN branded b ON f.lei = b.lei JOIN branded o ON o.lei = f.query_id WHERE retrieval_rank <= 100 AND o.brand <> '' AND b.brand <> ''),
family AS (SELECT * FROM members WHERE tier IS NOT NULL),
tied AS (SELECT x.query_id, s, e FROM relationships JOIN family x ON x.lei = s JOIN family y ON y.lei = e AND x.query_id = y.query_id WHERE status = 'ACTIVE'),
sure AS (SELECT query_id, s AS lei FROM tied UNION SELECT query_id, e FROM tied)
SELECT f.query_id, f.lei, tier, role, sure.lei IS NOT NULL AS graph_confirmed FROM family f LEFT JOIN sure ON f.query_id = sure.query_id AND f.lei = sure.lei
""")
def family_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = stored_register(spark, sf_dir)
    asked = entries.where("bigint(substring(lei, 4, 15)) % 100 = 0").select(F.col("lei").alias("query_id"), F.col("legal_name").alias("name"), F.col("legal_country").alias("country"))
    return family.discover_family(asked, entries, catalog(spark, sf_dir)["gleif_relationships"]).select("query_id", "lei", "tier", "role", "graph_confirmed")


# --- benchmark and metrics ---


@query("""
WITH h AS (SELECT 'LEI' || lpad(l_partkey::VARCHAR, 15, '0') || '00' AS lei, 'US' || lpad(l_orderkey::VARCHAR, 9, '0') || l_linenumber AS isin FROM lineitem WHERE l_linenumber <= 2)
SELECT r.lei, legal_name_core, min(isin) AS sample_isin, count(*) AS isin_count FROM register r JOIN h ON r.lei = h.lei GROUP BY ALL
""")
def positives_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.positives(register(spark, sf_dir), catalog(spark, sf_dir)["isin_lei"]).select("lei", "legal_name_core", "sample_isin", "isin_count")


_AGGRESSIVE = "trim(regexp_replace(trim(regexp_replace(regexp_replace(legal_name_core, '\\b(master|feeder|offshore|domestic|umbrella)\\b', '', 'g'), '\\s+', ' ', 'g')), '\\s(i|ii|iii|iv|v|vi|vii|viii|ix|x|[0-9]{1,3})$', ''))"


_CONFUSABLE = f"""WITH c AS (SELECT *, {_AGGRESSIVE} AS a FROM register), f AS (SELECT * FROM c WHERE a <> '' AND length(a) - length(replace(a, ' ', '')) + 1 >= 3), g AS (SELECT a FROM f GROUP BY a HAVING count(*) BETWEEN 2 AND 10),
p AS (SELECT x.lei AS lei_a, y.lei AS lei_b, x.a AS aggressive_core, x.jurisdiction, CASE WHEN x.fund_number <> y.fund_number THEN 'fund_number' WHEN x.is_master <> y.is_master OR x.is_feeder <> y.is_feeder THEN 'master_feeder' ELSE 'other_same_core' END AS conflict_type
  FROM f x JOIN f y ON x.a = y.a AND x.lei < y.lei JOIN g ON x.a = g.a),
confusable AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM register r WHERE r.legal_name_core = p.aggressive_core AND r.lei <> p.lei_a AND r.lei <> p.lei_b))
"""


@query(f"{_CONFUSABLE} SELECT lei_a, lei_b, aggressive_core, conflict_type FROM confusable")
def confusable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusable_pairs(register(spark, sf_dir)).select("lei_a", "lei_b", "aggressive_core", "conflict_type")


@query("SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey), c_custkey) AS rn FROM customer) WHERE rn <= 30")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.sample_per_group(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 30, 42).select("c_custkey", "c_mktsegment")


_PAIRS = f"""{_CONFUSABLE}, {_VARIANTS},
isins AS (SELECT DISTINCT 'LEI' || lpad(l_partkey::VARCHAR, 15, '0') || '00' AS lei FROM lineitem WHERE l_linenumber <= 2),
held AS (SELECT v.*, md5('42:' || lei) AS h FROM variants v SEMI JOIN isins USING (lei)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY jurisdiction ORDER BY h, lei) > 5000 // (SELECT count(DISTINCT coalesce(jurisdiction, '')) FROM held) AS later FROM held),
easy AS (SELECT *, row_number() OVER (ORDER BY later, h, lei) - 1 AS i FROM ranked QUALIFY i < 5000),
tough AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || lei_a || lei_b), lei_a || lei_b) - 1 AS i FROM confusable QUALIFY i < 1000),
evaluated AS (SELECT printf('pos_%07d', i) AS pair_id, query_name, legal_country AS query_country, lei AS expected_lei, NULL::VARCHAR AS confusable_lei, 'isin_confirmed' AS case_type, difficulty, NULL::VARCHAR AS conflict_type, 'positives' AS source, CASE bucket WHEN 0 THEN legal_name_norm ELSE query_name END AS query_name_norm FROM easy
  UNION ALL SELECT printf('neg_%07d', i), aggressive_core, jurisdiction, lei_a, lei_b, 'confusable_pair', 'hard', conflict_type, 'hard_negatives', aggressive_core FROM tough)
"""


@query(f"{_PAIRS} SELECT * FROM evaluated")
def evaluation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = stored_register(spark, sf_dir)
    return evaluation.evaluation_pairs(evaluation.positives(entries, catalog(spark, sf_dir)["isin_lei"]), evaluation.confusable_pairs(entries), Benchmark())


_ASKED_PAIRS = f"""asking AS (SELECT query_id, q_name, q_norm, q_country, {_QUERY_FIELDS}, NULL::VARCHAR AS q_postcode, NULL::VARCHAR AS q_outward, NULL::VARCHAR AS q_city, NULL::VARCHAR AS q_reg
  FROM (SELECT pair_id AS query_id, query_name AS q_name, query_name_norm AS q_norm, query_country AS q_country, {_CORE.replace('q_norm', 'query_name_norm')} AS q_core FROM evaluated))"""


@query(f"""{_PAIRS}, {_scored(20, _ASKED_PAIRS).strip()[5:]},
{_DECIDED},
places AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, retrieval_rank) AS place FROM scores),
answers AS (SELECT e.*, place AS rank, coalesce(d, 'UNMATCHED') AS decision, CASE WHEN d <> 'UNMATCHED' THEN decided.lei END AS chosen FROM evaluated e LEFT JOIN places ON places.query_id = pair_id AND places.lei = expected_lei LEFT JOIN decided ON decided.query_id = pair_id),
told AS (SELECT *, decision = 'AUTO_MATCH' AS auto, coalesce(chosen = expected_lei, false) AS ok, coalesce(chosen = confusable_lei, false) AS mixed_up FROM answers)
SELECT case_type, count(*) AS n, round(avg((coalesce(rank, 99) <= 20)::INT), 4) AS recall, round(avg((coalesce(rank, 0) = 1)::INT), 4) AS top1, round(avg(coalesce(1 / rank, 0)), 4) AS mrr, round(avg(auto::INT), 4) AS auto_rate, round(avg((decision = 'REVIEW')::INT), 4) AS review_rate,
  round(avg(CASE WHEN auto THEN ok::INT END), 4) AS auto_precision, round(avg((auto AND ok)::INT), 4) AS coverage, round(avg((auto AND (mixed_up OR NOT ok))::INT), 4) AS dangerous_rate FROM told GROUP BY case_type
""")
def benchmark_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = stored_register(spark, sf_dir)
    found = evaluation.positives(entries, catalog(spark, sf_dir)["isin_lei"])
    pairs = evaluation.evaluation_pairs(found, evaluation.confusable_pairs(entries), Benchmark())
    return evaluation.metrics(evaluation.run_benchmark(pairs, entries), ["case_type"])


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(nested_list([F.col("l_linenumber")], F.col("l_partkey")).alias("ranked"))
    return lines.selectExpr("l_orderkey", "ranked", "l_orderkey % 3 AS slice", "CASE WHEN l_orderkey % 5 = 0 THEN -1L ELSE ranked[int(l_orderkey % size(ranked))] END AS expected", "CASE l_orderkey % 4 WHEN 0 THEN 'UNMATCHED' WHEN 1 THEN 'REVIEW' ELSE 'AUTO_MATCH' END AS decision", "CASE WHEN l_orderkey % 4 <> 0 THEN ranked[0] END AS chosen")


_RESULTS = """
l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ranked FROM lineitem GROUP BY 1),
o AS (SELECT *, l_orderkey % 3 AS slice, CASE WHEN l_orderkey % 5 = 0 THEN -1 ELSE ranked[l_orderkey % len(ranked) + 1] END AS expected, l_orderkey % 4 >= 2 AS auto, l_orderkey % 4 = 1 AS review, CASE WHEN l_orderkey % 4 <> 0 THEN ranked[1] END AS chosen FROM l),
m AS (SELECT *, nullif(coalesce(list_position(ranked, expected), 0), 0) AS rank, coalesce(chosen = expected, false) AS ok FROM o)
"""


@query(f"""
WITH {_RESULTS} SELECT slice, count(*) AS n, round(avg((coalesce(rank, 99) <= 3)::INT), 4) AS recall, round(avg((coalesce(rank, 0) = 1)::INT), 4) AS top1, round(avg(coalesce(1 / rank, 0)), 4) AS mrr, round(avg(auto::INT), 4) AS auto_rate, round(avg(review::INT), 4) AS review_rate,
  round(avg(CASE WHEN auto THEN ok::INT END), 4) AS auto_precision, round(avg((auto AND ok)::INT), 4) AS coverage, round(avg((auto AND NOT ok)::INT), 4) AS dangerous_rate FROM m GROUP BY slice
""")
def metrics_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.metrics(_results(spark, sf_dir), ["slice"], k=3)


@query(f"""
WITH {_RESULTS}, c AS (SELECT CASE WHEN auto AND ok THEN 'success' WHEN auto THEN 'wrong_auto' WHEN rank IS NULL THEN 'retrieval_miss' WHEN rank = 1 THEN 'under_confident' ELSE 'deferred' END AS category FROM m)
SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM c GROUP BY category
""")
def failure_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.failure_breakdown(_results(spark, sf_dir))


# --- graph ---


@query("""
WITH n AS (
  SELECT 'lei:' || lei AS node_id, 'LEGAL_ENTITY' AS node_type, legal_name AS display_name, entity_status AS status, 'gleif' AS source FROM register
  UNION ALL SELECT 'cik:' || cik, 'LEGAL_ENTITY', arg_max(filer_name, filed::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')), NULL, 'sec_13f' FROM filings GROUP BY cik)
SELECT node_id, node_type, status, source FROM n
""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    some = type(c)(spark, tables={n: c[n] for n in ("gleif_entities", "sec_13f_filings")})
    return graph.build_graph(some)["nodes"].select("node_id", "node_type", "status", "source")


@query("""
SELECT DISTINCT 'lei:' || s AS start_node_id, 'lei:' || e AS end_node_id, CASE t WHEN 'IS_DIRECTLY_CONSOLIDATED_BY' THEN 'ACCOUNTING_PARENT' WHEN 'IS_FUND-MANAGED_BY' THEN 'FUND_MANAGED_BY' WHEN 'IS_SUBFUND_OF' THEN 'SUBFUND_OF' ELSE 'GLEIF_RELATIONSHIP' END AS edge_type, 'gleif' AS source FROM relationships WHERE status = 'ACTIVE'
UNION ALL SELECT 'lei:' || lei, 'lei:' || successor_lei, 'SUCCEEDED_BY', 'gleif' FROM register WHERE successor_lei IS NOT NULL
UNION ALL SELECT DISTINCT 'cik:' || x.cik, 'lei:' || x.lei, 'SAME_AS', 'sec_13f_crosswalk' FROM crosswalk x WHERE lei IS NOT NULL AND decision = 'AUTO_MATCH' AND NOT EXISTS (SELECT 1 FROM last_reviews r WHERE r.node_id = 'cik:' || x.cik AND r.lei = x.lei AND r.outcome = 'REJECTED')
UNION ALL SELECT node_id, 'lei:' || lei, 'SAME_AS', 'human_review' FROM last_reviews WHERE outcome = 'CONFIRMED'
UNION ALL SELECT DISTINCT 'series:' || f.series_id, 'security:cusip:' || h.cusip, 'REPORTED_HOLDING', 'nport' FROM fund_holdings h JOIN funds f ON h.accession_number = f.accession_number WHERE h.cusip IS NOT NULL
UNION ALL SELECT DISTINCT CASE WHEN individual THEN 'owner-cik:' ELSE 'cik:' END || person_cik, 'cik:' || issuer_cik, 'BENEFICIAL_OWNER', 'sec_13dg' FROM ownership WHERE person_cik IS NOT NULL
UNION ALL SELECT DISTINCT 'security:cusip:' || cusip, 'cik:' || issuer_cik, 'ISSUED_BY', 'sec_13dg' FROM ownership WHERE length(cusip) = 9
UNION ALL SELECT 'security:cusip:' || cusip, 'figi:' || min(k), 'SAME_AS', 'openfigi' FROM listed GROUP BY cusip HAVING count(DISTINCT k) = 1
""")
def graph_edges_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    tables = {n: c[n] for n in ("gleif_entities", "gleif_relationships", "crosswalk_sec_13f_gleif", "match_reviews", "nport_holdings", "sec_13dg_ownership", "openfigi_mappings")}
    tables["nport_funds"] = c["nport_funds"].withColumns({"registrant_lei": F.lit(None).cast("string"), "series_lei": F.lit(None).cast("string")})
    tables["nport_holdings"] = tables["nport_holdings"].withColumn("issuer_lei", F.lit(None).cast("string"))
    return graph.build_graph(type(c)(spark, tables=tables))["edges"].select("start_node_id", "end_node_id", "edge_type", "source")


@query("SELECT 'lei:' || lei AS node_id, 'LEI' AS identifier_type, lei AS identifier_value, 'gleif' AS source FROM register UNION ALL SELECT DISTINCT 'series:' || series_id, 'SEC_SERIES_ID', series_id, 'sec_series_class' FROM series UNION ALL SELECT DISTINCT 'class:' || class_id, 'TICKER', ticker, 'sec_series_class' FROM series WHERE class_id IS NOT NULL AND ticker IS NOT NULL")
def graph_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build_graph(catalog(spark, sf_dir))["identifiers"].select("node_id", "identifier_type", "identifier_value", "source")


@query("""
WITH h AS (SELECT 'nport:' || h.holding_id || ':' AS id, 'series:' || f.series_id AS s, balance, v, pct FROM fund_holdings h JOIN funds f ON h.accession_number = f.accession_number),
o AS (SELECT 'sec-13dg:' || accession_number || ':' || person_index || ':' AS id, CASE WHEN individual THEN 'owner-cik:' ELSE 'cik:' END || person_cik AS s, pct, long FROM ownership WHERE person_cik IS NOT NULL)
SELECT DISTINCT sha256(id || 'holding.balance') AS fact_id, s AS subject_node_id, 'holding.balance' AS predicate, 'NS' AS unit FROM h WHERE balance IS NOT NULL
UNION ALL SELECT DISTINCT sha256(id || 'holding.currency_value'), s, 'holding.currency_value', 'USD' FROM h WHERE v IS NOT NULL
UNION ALL SELECT DISTINCT sha256(id || 'holding.portfolio_percentage'), s, 'holding.portfolio_percentage', 'percent' FROM h WHERE pct IS NOT NULL
UNION ALL SELECT DISTINCT sha256(id || 'ownership.percent_of_class'), s, 'ownership.percent_of_class', 'percent' FROM o WHERE pct IS NOT NULL
UNION ALL SELECT DISTINCT sha256(id || 'ownership.aggregate_shares'), s, 'ownership.aggregate_shares', 'shares' FROM o
UNION ALL SELECT DISTINCT sha256(id || 'ownership.filing_intent'), s, 'ownership.filing_intent', NULL FROM o
""")
def facts_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    some = type(c)(spark, tables={n: c[n] for n in ("nport_funds", "nport_holdings", "sec_13dg_ownership")})
    return graph.build_graph(some)["facts"].select("fact_id", "subject_node_id", "predicate", "unit")


@query("""
SELECT sha256('crosswalk:' || cik || ':feature:' || f) AS fact_id, 'match.feature.' || f AS predicate, CASE f WHEN 'name_exact' THEN (100 + c_custkey % 5) || '.0' ELSE (c_custkey % 40) || '.5' END AS value, 'points' AS unit FROM crosswalk, (VALUES ('name_exact'), ('name_ratio')) v(f)
UNION ALL SELECT sha256('crosswalk:' || cik || ':match.decision'), 'match.decision', decision, NULL FROM crosswalk
UNION ALL SELECT sha256('crosswalk:' || cik || ':match.score'), 'match.score', score::VARCHAR, 'points' FROM crosswalk
UNION ALL SELECT sha256('crosswalk:' || cik || ':match.runner_up_gap'), 'match.runner_up_gap', gap::VARCHAR, 'points' FROM crosswalk WHERE gap IS NOT NULL
UNION ALL SELECT sha256('crosswalk:' || cik || ':match.runner_up_lei'), 'match.runner_up_lei', 'LEI' || lpad((c_custkey + 1)::VARCHAR, 15, '0') || '00', NULL FROM crosswalk WHERE c_custkey % 4 <> 0
UNION ALL SELECT sha256('crosswalk:' || cik || ':match.config_hash'), 'match.config_hash', 'abc', NULL FROM crosswalk
""")
def json_facts_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return graph.build_graph(type(c)(spark, tables={"crosswalk_sec_13f_gleif": c["crosswalk_sec_13f_gleif"]}))["facts"].select("fact_id", "predicate", "value", "unit")


@query("SELECT sha256('review:' || line_no || ':review.outcome') AS fact_id, 'review.outcome' AS predicate, outcome AS value FROM reviews UNION ALL SELECT sha256('review:' || line_no || ':review.reviewer'), 'review.reviewer', reviewer FROM reviews UNION ALL SELECT sha256('review:' || line_no || ':review.rationale'), 'review.rationale', rationale FROM reviews WHERE rationale IS NOT NULL")
def review_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return graph.build_graph(type(c)(spark, tables={"match_reviews": c["match_reviews"]}))["facts"].select("fact_id", "predicate", "value")


@query("SELECT node_id, lei, outcome, line_no::INT AS line_no FROM last_reviews")
def latest_review_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.latest_reviews(catalog(spark, sf_dir)["match_reviews"]).select("node_id", "lei", F.upper("outcome").alias("outcome"), "line_no")


_EDGES = """
SELECT CASE WHEN o_custkey % 2 = 0 THEN 'lei:' || o_custkey ELSE 'cik:' || o_custkey END AS s, 'cik:' || o_orderkey % 60 AS e, CASE o_orderkey % 3 WHEN 0 THEN 'BENEFICIAL_OWNER' WHEN 1 THEN 'INSIDER_OF' ELSE 'SAME_AS' END AS t, 'sec_13dg' AS source, strftime(o_orderdate, '%Y-%m-%d') AS vf, CASE WHEN o_orderkey % 4 = 0 THEN '2002-01-01' END AS vt, o_orderkey || ':1' AS ref FROM orders
UNION ALL SELECT 'cik:' || c_custkey % 60, 'lei:' || c_custkey % 9, 'SAME_AS', 'nport', NULL, NULL, c_custkey::VARCHAR FROM customer
"""


@query(f"""
WITH edges AS ({_EDGES}), typed AS (SELECT * FROM edges WHERE t IN ('BENEFICIAL_OWNER', 'INSIDER_OF')),
mine AS (SELECT e AS lei, s AS node FROM edges WHERE t = 'SAME_AS' AND e LIKE 'lei:%' UNION SELECT n, n FROM (SELECT s AS n FROM typed UNION SELECT e FROM typed) WHERE n LIKE 'lei:%'),
touch AS (SELECT lei, 'outgoing' AS direction, e AS other, typed.* FROM typed JOIN mine ON s = node UNION ALL SELECT lei, 'incoming', s, typed.* FROM typed JOIN mine ON e = node),
ranked AS (SELECT *, count(*) OVER (PARTITION BY lei, t, direction) AS total, row_number() OVER (PARTITION BY lei, t, direction ORDER BY vt IS NOT NULL, vf DESC NULLS LAST, other, ref) AS rank FROM touch)
SELECT lei AS lei_node, t AS edge_type, direction, other AS other_node_id, total, rank FROM ranked WHERE rank <= 25
""")
def connections_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").selectExpr(
        "CASE WHEN o_custkey % 2 = 0 THEN concat('lei:', o_custkey) ELSE concat('cik:', o_custkey) END AS start_node_id", "concat('cik:', o_orderkey % 60) AS end_node_id", "CASE o_orderkey % 3 WHEN 0 THEN 'BENEFICIAL_OWNER' WHEN 1 THEN 'INSIDER_OF' ELSE 'SAME_AS' END AS edge_type", "'sec_13dg' AS source",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS valid_from", "CASE WHEN o_orderkey % 4 = 0 THEN '2002-01-01' END AS valid_to", "concat(o_orderkey, ':1') AS source_record_ref",
    )
    b = table(spark, sf_dir, "customer").selectExpr("concat('cik:', c_custkey % 60) AS start_node_id", "concat('lei:', c_custkey % 9) AS end_node_id", "'SAME_AS' AS edge_type", "'nport' AS source", "string(c_custkey) AS source_record_ref")
    nodes = spark.createDataFrame([], "node_id string, display_name string, node_type string")
    out = serving.ranked_connections(relational.union_by_name([a, b]), nodes)
    return out.select("lei_node", "edge_type", "direction", "other_node_id", "total", "rank")


@query("SELECT s AS lei, 'up' AS direction, e AS other, t AS relationship_type FROM relationships WHERE status <> 'INACTIVE' UNION ALL SELECT e, 'down', s, t FROM relationships WHERE status <> 'INACTIVE' AND s <> e")
def hierarchy_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.neighbours(catalog(spark, sf_dir)["gleif_relationships"]).select("lei", "direction", "other", "relationship_type")


@query("""
WITH x AS (SELECT 'LEI' || lpad(p_partkey::VARCHAR, 15, '0') || '00' AS lei, CASE WHEN p_partkey % 2 = 0 THEN 'DIRECT_ACCOUNTING_CONSOLIDATION_PARENT' ELSE 'ULTIMATE_ACCOUNTING_CONSOLIDATION_PARENT' END AS c, CASE WHEN p_partkey % 5 = 0 THEN 'parent is a natural person, not a legal entity' ELSE 'OTHER' END AS reason_text FROM part WHERE p_partkey % 3 = 0)
SELECT lei, c AS exception_category, CASE WHEN c LIKE 'DIRECT%' THEN 'Direct parent' ELSE 'Ultimate parent' END AS label, reason_text FROM x
WHERE NOT EXISTS (SELECT 1 FROM relationships r WHERE r.s = x.lei AND r.status <> 'INACTIVE' AND r.t = CASE WHEN c LIKE 'DIRECT%' THEN 'IS_DIRECTLY_CONSOLIDATED_BY' ELSE 'IS_ULTIMATELY_CONSOLIDATED_BY' END)
""")
def hierarchy_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return hierarchy.open_exceptions(c["gleif_relationship_exceptions"], c["gleif_relationships"]).select("lei", "exception_category", "label", "reason_text")


@query("""
WITH walk(root, node, hops) AS (SELECT lei, lei, 0 FROM register UNION SELECT root, e, hops + 1 FROM walk JOIN relationships ON s = node WHERE status = 'ACTIVE' AND hops < 4)
SELECT root, node, min(hops)::INT AS hops FROM walk GROUP BY ALL
""")
def recursive_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every entity."""
    c = catalog(spark, sf_dir)
    edges = c["gleif_relationships"].where("relationship_status = 'ACTIVE'").selectExpr("start_node_id AS a", "end_node_id AS b")
    return hierarchy.reachable(edges, c["gleif_entities"].select(F.col("lei").alias("node")), 4)


ORACLES["recursive_reachability"] = ORACLES["recursive_reachability"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("SELECT lei AS entity_id, legal_name AS canonical_name, jurisdiction, entity_status, 'GENERAL' AS entity_type FROM register")
def canonical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.build_entities(register(spark, sf_dir)).select("entity_id", "canonical_name", "jurisdiction", "entity_status", "entity_type")


@query("""
SELECT 'LEI' || lpad(l_partkey::VARCHAR, 15, '0') || '00' AS entity_id, 'ISIN' AS identifier_type, 'US' || lpad(l_orderkey::VARCHAR, 9, '0') || l_linenumber AS identifier_value, 'SOURCE' AS confidence FROM lineitem WHERE l_linenumber <= 2
UNION ALL SELECT lei, 'CIK', cik, decision FROM crosswalk WHERE lei IS NOT NULL AND decision <> 'UNMATCHED'
""")
def entity_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.build_identifiers(catalog(spark, sf_dir)).select("entity_id", "identifier_type", "identifier_value", "confidence")


# --- documents ---


@query("""
WITH latest AS (SELECT * FROM funds WHERE series_lei IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_lei ORDER BY report DESC, filed DESC, accession_number DESC) = 1),
r AS (SELECT h.*, row_number() OVER (PARTITION BY h.accession_number ORDER BY v DESC NULLS LAST, holding_id) AS rank FROM fund_holdings h JOIN latest l ON h.accession_number = l.accession_number)
SELECT l.series_lei, l.accession_number, count(r.holding_id) AS holding_count, max(CASE WHEN rank = 1 THEN holding_id END) AS first_holding, round(coalesce(sum(CASE WHEN rank <= 10 THEN v END), 0), 2) AS top_value FROM latest l LEFT JOIN r ON l.accession_number = r.accession_number GROUP BY ALL
""")
def nport_fund_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = serving.nport_fund_documents(catalog(spark, sf_dir))
    return out.select("series_lei", "accession_number", "holding_count", F.try_element_at("top_holdings", F.lit(1))["holding_id"].alias("first_holding"), F.round(F.aggregate("top_holdings", F.lit(0.0), lambda a, h: a + F.coalesce(h["value_usd"], F.lit(0.0))), 2).alias("top_value"))


@query("""
WITH leis AS (SELECT series_id, arg_max(series_lei, report) AS series_lei, arg_max(registrant_lei, report) AS registrant_lei FROM funds GROUP BY series_id),
reg AS (SELECT s.cik, min(l.registrant_lei) AS registrant_lei FROM series s JOIN leis l ON s.series_id = l.series_id WHERE l.registrant_lei IS NOT NULL GROUP BY s.cik)
SELECT s.series_id, min(s.cik) AS cik, min(l.series_lei) AS series_lei, min(r.registrant_lei) AS registrant_lei, count(*) AS n_classes, count(DISTINCT s.class_id) AS n_class_ids, coalesce(array_to_string(list_sort(list(DISTINCT upper(s.ticker)) FILTER (WHERE s.ticker IS NOT NULL)), ','), '') AS tickers
FROM series s LEFT JOIN leis l ON s.series_id = l.series_id LEFT JOIN reg r ON s.cik = r.cik WHERE s.series_id <> '' GROUP BY s.series_id
""")
def fund_series_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = serving.fund_series_documents(catalog(spark, sf_dir))
    return out.select("series_id", "cik", "series_lei", "registrant_lei", F.size("classes").cast("long").alias("n_classes"), F.size("class_ids").cast("long").alias("n_class_ids"), F.array_join("tickers", ",").alias("tickers"))


@query("""
WITH per AS (SELECT cusip, k, coalesce(min(ticker) FILTER (WHERE exchange = 'US'), min(ticker)) AS ticker, count(*) AS n, count(DISTINCT composite) AS nc FROM listed GROUP BY ALL),
g AS (SELECT cusip, count(*) AS securities, arg_min(k, struct_pack(a := -n, b := k)) AS first_key, array_to_string(list_sort(list(DISTINCT upper(ticker)) FILTER (WHERE ticker IS NOT NULL)), ',') AS tickers, (count(*) + sum(nc))::BIGINT AS n_figis FROM per GROUP BY cusip)
SELECT c.cusip, coalesce(securities, 0) AS n_securities, first_key, coalesce(tickers, '') AS tickers, coalesce(n_figis, 0) AS n_figis, CASE WHEN securities IS NULL THEN 'no_match' WHEN securities = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM (SELECT DISTINCT cusip FROM figi) c LEFT JOIN g ON c.cusip = g.cusip
""")
def security_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = serving.security_documents(catalog(spark, sf_dir))
    return out.select("cusip", F.size("securities").cast("long").alias("n_securities"), F.try_element_at("securities", F.lit(1))["security_key"].alias("first_key"), F.array_join("tickers", ",").alias("tickers"), F.size("figis").cast("long").alias("n_figis"), "status")


@query("SELECT cusip, min(k) AS security_key FROM listed GROUP BY cusip HAVING count(DISTINCT k) = 1")
def share_class_unambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    edges = graph.build_graph(type(c)(spark, tables={"openfigi_mappings": c["openfigi_mappings"]}))["edges"]
    return edges.select(F.col("source_record_ref").alias("cusip"), F.substring("end_node_id", 6, 100).alias("security_key"))


def _with_effective(spark: SparkSession, sf_dir: str):
    c = catalog(spark, sf_dir)
    checked = filings.validate(c["sec_13f_filings"], c["sec_13f_summaries"], c["sec_13f_holdings"])
    c.put("sec_13f_quarantine", filings.quarantine(checked))
    c.put("sec_13f_effective_holdings", filings.effective_holdings(c["sec_13f_filings"], c["sec_13f_holdings"], checked))
    c.put("sec_13f_scale_checks", filings.scale_checks(c["sec_13f_effective_holdings"], _SCALE))
    return c


@query("""
WITH periods AS (SELECT e.cik, e.period, max(f.filed) AS filed, count(*) AS reported FROM effective e JOIN filings f ON e.accession_number = f.accession_number GROUP BY ALL),
latest AS (SELECT * FROM periods QUALIFY row_number() OVER (PARTITION BY cik ORDER BY period DESC) = 1),
sums AS (SELECT e.cik, cusip, sum(value_usd)::BIGINT AS v FROM effective e JOIN latest l ON e.cik = l.cik AND e.period = l.period WHERE put_call IS NULL GROUP BY ALL),
top AS (SELECT cik, count(*) AS n, max(CASE WHEN rank = 1 THEN cusip END) AS first_cusip FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY v DESC NULLS LAST, cusip) AS rank FROM sums) WHERE rank <= 10 GROUP BY cik),
q AS (SELECT cik, count(*) AS n FROM checked c JOIN filings f ON c.accession_number = f.accession_number WHERE errors <> '' GROUP BY cik),
names AS (SELECT cik, count(*) AS c FROM filings GROUP BY cik)
SELECT n.cik, upper(strftime(l.period, '%d-%b-%Y')) AS latest_period_of_report, upper(strftime(l.filed, '%d-%b-%Y')) AS latest_filing_date, coalesce(l.reported, 0) AS reported_security_count, coalesce(t.n, 0) AS n_top, first_cusip, coalesce(q.n, 0) AS n_quarantined, x.lei, x.decision
FROM names n LEFT JOIN latest l ON n.cik = l.cik LEFT JOIN top t ON n.cik = t.cik LEFT JOIN q ON n.cik = q.cik LEFT JOIN crosswalk x ON n.cik = x.cik
""")
def filer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = serving.filer_documents(_with_effective(spark, sf_dir))
    return out.select("cik", "latest_period_of_report", "latest_filing_date", "reported_security_count", F.size("top_reported_holdings").cast("long").alias("n_top"), F.try_element_at("top_reported_holdings", F.lit(1))["cusip"].alias("first_cusip"), F.size("quarantined_filings").cast("long").alias("n_quarantined"), "lei", "decision")


@query("""
WITH p AS (SELECT accession_number, cik, period, cusip, value_usd / shares AS price FROM effective WHERE value_unit = 'USD' AND put_call IS NULL AND kind = 'SH' AND shares > 0 AND value_usd > 0), c AS (SELECT period, cusip, median(price) AS usual FROM p GROUP BY ALL HAVING count(DISTINCT cik) >= 2),
bad AS (SELECT accession_number FROM p JOIN c ON p.period = c.period AND p.cusip = c.cusip GROUP BY 1 HAVING median(price / usual) BETWEEN 0.0002 AND 0.01)
SELECT accession_number, infotable_sk, strftime(period, '%Y-%m-%d') AS period_date, value_usd, accession_number IN (SELECT accession_number FROM bad) AS scale_suspect FROM effective
""")
def holding_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.holding_documents(_with_effective(spark, sf_dir)).select("accession_number", "infotable_sk", "period_date", "value_usd", "scale_suspect")


@query("""
WITH ids AS (SELECT 'LEI' || lpad(l_partkey::VARCHAR, 15, '0') || '00' AS lei, 'ISIN' AS t FROM lineitem WHERE l_linenumber <= 2 UNION ALL SELECT lei, 'CIK' FROM crosswalk WHERE lei IS NOT NULL AND decision <> 'UNMATCHED'),
i AS (SELECT lei, count(*) AS n, count(*) FILTER (WHERE t = 'CIK') AS ciks, least(3, count(*) FILTER (WHERE t = 'CIK')) + least(3, count(*) FILTER (WHERE t = 'ISIN')) AS kept FROM ids GROUP BY lei),
d AS (SELECT lei, count(*) AS n FROM crosswalk WHERE lei IS NOT NULL GROUP BY lei)
SELECT r.lei AS entity_id, coalesce(i.n, 0) AS identifier_total, coalesce(i.kept, 0) AS identifiers_kept, coalesce(i.ciks, 0) AS n_ciks, (p_partkey % 3 = 0)::BIGINT AS n_exceptions, coalesce(d.n, 0) AS n_decisions, successor_lei FROM register r LEFT JOIN i ON r.lei = i.lei LEFT JOIN d ON r.lei = d.lei
""")
def entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    c.put("entities", entities.build_entities(c["gleif_entities"]))
    c.put("entity_identifiers", entities.build_identifiers(c))
    out = serving.entity_documents(c, Serving(identifiers_per_type=3))
    size = lambda n: F.size(n).cast("long")
    return out.select("entity_id", "identifier_total", size("identifiers").alias("identifiers_kept"), size("ciks").alias("n_ciks"), size("exceptions").alias("n_exceptions"), size("match_decisions").alias("n_decisions"), "successor_lei")


# --- lookups and plain documents ---

_LINES = "lpad(l_suppkey::VARCHAR, 10, '0') AS cik, lpad((l_partkey % 5)::VARCHAR, 9, '0') AS cusip, strftime(l_shipdate, '%Y-%m') AS period_date, round(l_extendedprice)::BIGINT AS value_usd, l_orderkey, l_linenumber"


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "lpad(string(l_suppkey), 10, '0') AS cik", "lpad(string(l_partkey % 5), 9, '0') AS cusip", "date_format(l_shipdate, 'yyyy-MM') AS period_date", "bigint(round(l_extendedprice)) AS value_usd", "CASE WHEN l_linenumber = 7 THEN 'PUT' END AS put_call", "l_orderkey", "l_linenumber"
    )


@query(f"SELECT l_orderkey, l_linenumber, period_date, value_usd FROM (SELECT {_LINES} FROM lineitem WHERE l_linenumber <> 7) WHERE cik = '0000000003' AND cusip = '000000002' QUALIFY dense_rank() OVER (ORDER BY period_date DESC) <= 4")
def recent_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.recent_positions(_positions(spark, sf_dir), "0000000003", "000000002").select("l_orderkey", "l_linenumber", "period_date", "value_usd")


@query(f"""
WITH h AS (SELECT * FROM (SELECT {_LINES} FROM lineitem) WHERE cusip = '000000004' QUALIFY row_number() OVER (PARTITION BY cik ORDER BY period_date DESC, value_usd DESC) = 1)
SELECT h.cik, period_date, value_usd, s_name AS filer_name FROM h LEFT JOIN supplier ON h.cik = lpad(s_suppkey::VARCHAR, 10, '0') ORDER BY value_usd DESC, h.cik LIMIT 25
""")
def cusip_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    filers = table(spark, sf_dir, "supplier").selectExpr("lpad(string(s_suppkey), 10, '0') AS cik", "s_name AS filer_name", "CAST(NULL AS STRING) AS lei")
    found = reads.search_entities("000000004", "cusip", None, _positions(spark, sf_dir), filers, size=25)
    return found.select("cik", "period_date", "value_usd", "filer_name")


@query("SELECT lei, legal_name, jurisdiction FROM register WHERE lei = 'LEI00000000000000700'")
def search_by_lei(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.search_entities(" lei00000000000000700", "lei", register(spark, sf_dir))


@query("""
WITH f AS (SELECT lei, count(*) AS n, min(cik) AS first_cik FROM crosswalk WHERE lei IS NOT NULL GROUP BY lei), u AS (SELECT series_lei, count(*) AS n FROM funds WHERE series_lei IS NOT NULL GROUP BY series_lei)
SELECT r.lei AS entity_id, f.n AS n_filings, first_cik, u.n AS n_fund_reports FROM register r LEFT JOIN f ON r.lei = f.lei LEFT JOIN u ON r.lei = u.series_lei
""")
def entity_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    documents = c["gleif_entities"].select(F.col("lei").alias("entity_id"), "legal_name")
    out = reads.entity_profile(documents, c["crosswalk_sec_13f_gleif"].select("cik", "lei"), c["nport_funds"].select("series_lei", "accession_number"))
    size = lambda n: F.when(F.col(n).isNotNull(), F.size(n).cast("long"))
    return out.select("entity_id", size("filings").alias("n_filings"), F.get_json_object(F.try_element_at("filings", F.lit(1)), "$.cik").alias("first_cik"), size("fund").alias("n_fund_reports"))


@query("""
WITH leis AS (SELECT series_id, arg_max(series_lei, report) AS series_lei, arg_max(registrant_lei, report) AS registrant_lei FROM funds GROUP BY series_id),
reg AS (SELECT s.cik, min(l.registrant_lei) AS registrant_lei FROM series s JOIN leis l ON s.series_id = l.series_id WHERE l.registrant_lei IS NOT NULL GROUP BY s.cik),
d AS (SELECT s.series_id, min(s.cik) AS cik, min(l.series_lei) AS series_lei, min(r.registrant_lei) AS registrant_lei, bool_or(s.class_id = 'C35') AS class, bool_or(upper(s.ticker) = 'TK7') AS ticker FROM series s LEFT JOIN leis l ON s.series_id = l.series_id LEFT JOIN reg r ON s.cik = r.cik WHERE s.series_id <> '' GROUP BY s.series_id)
SELECT 'lei' AS given, series_id, cik FROM d WHERE series_lei = 'SL5' OR registrant_lei = 'SL5' UNION ALL SELECT 'cik', series_id, cik FROM d WHERE cik = '0000000009' UNION ALL SELECT 'series', series_id, cik FROM d WHERE series_id = 'S12'
UNION ALL SELECT 'class', series_id, cik FROM d WHERE class UNION ALL SELECT 'ticker', series_id, cik FROM d WHERE ticker
""")
def fund_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = serving.fund_series_documents(catalog(spark, sf_dir))
    asked = {"lei": {"lei": "SL5"}, "cik": {"cik": "0000000009"}, "series": {"series_id": "S12"}, "class": {"class_id": "C35"}, "ticker": {"ticker": "tk7"}}
    return relational.union_by_name([reads.fund_structure(series, **by).select(F.lit(given).alias("given"), "series_id", "cik") for given, by in asked.items()])


@query("""
WITH g AS (SELECT cusip, list(DISTINCT upper(ticker)) AS tickers, list(DISTINCT k) AS keys, list(DISTINCT composite) AS composites FROM (SELECT cusip, k, coalesce(min(ticker) FILTER (WHERE exchange = 'US'), min(ticker)) AS ticker FROM listed GROUP BY ALL) JOIN (SELECT cusip, k, composite FROM listed) USING (cusip, k) GROUP BY cusip)
SELECT 'cusip' AS given, cusip FROM (SELECT DISTINCT cusip FROM figi) WHERE cusip = '000000395' UNION ALL SELECT 'ticker', cusip FROM g WHERE list_contains(tickers, 'T17') UNION ALL SELECT 'figi', cusip FROM g WHERE list_contains(keys, 'SC42') OR list_contains(composites, 'SC42')
""")
def security_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = serving.security_documents(catalog(spark, sf_dir))
    asked = {"cusip": "000000395", "ticker": "t17", "figi": "SC42"}
    return relational.union_by_name([reads.security(found, **{by: value}).select(F.lit(by).alias("given"), "cusip") for by, value in asked.items()])


@query("SELECT s AS start_node_id, e AS end_node_id, t AS relationship_type, status AS relationship_status FROM relationships")
def relationship_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.BUILDERS["relationships"](catalog(spark, sf_dir)).select("start_node_id", "end_node_id", "relationship_type", "relationship_status")


@query("SELECT accession_number, person_index::INT AS person_index, issuer_cik, person_cik AS reporting_person_cik, pct AS percent_of_class FROM ownership")
def ownership_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.BUILDERS["ownership"](catalog(spark, sf_dir)).select("accession_number", "person_index", "issuer_cik", "reporting_person_cik", "percent_of_class")


@query("SELECT 'uk-company: r' || p_partkey || ' ' AS start_node_id, 'lei:' || lei AS end_node_id, ' r' || p_partkey || ' :' || lei AS source_record_ref FROM register WHERE p_partkey % 12 = 0 AND jurisdiction LIKE 'GB%'")
def company_register_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    companies = table(spark, sf_dir, "part").where("p_partkey % 12 = 0").selectExpr("concat(' r', p_partkey, ' ') AS company_number", "p_name AS company_name", "'active' AS company_status", "'ch.zip' AS source_file", "'2024-06-30' AS snapshot_date", "'2024-07-01' AS ingested_at")
    edges = graph.build_graph(type(c)(spark, tables={"gleif_entities": c["gleif_entities"], "companies_house_companies": companies}))["edges"]
    return edges.where("source = 'gleif_registration_id'").select("start_node_id", "end_node_id", "source_record_ref")


# --- reads ---


@query("""
WITH t AS (SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS period_date, sum(round(l_extendedprice))::BIGINT AS total FROM lineitem WHERE l_linenumber <> 7 GROUP BY ALL),
r AS (SELECT *, lead(total) OVER w AS previous, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY l_suppkey ORDER BY period_date DESC))
SELECT l_suppkey, period_date, total, previous, total - previous AS change, round((total - previous) * 100 / abs(previous), 2) AS percent_change FROM r WHERE n <= 4
""")
def position_history_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "date_format(l_shipdate, 'yyyy-MM') AS period_date", "bigint(round(l_extendedprice)) AS value_usd", "l_quantity AS shares", "CASE WHEN l_linenumber = 7 THEN 'PUT' END AS put_call")
    return reads.position_history(rows, ("l_suppkey",)).select("l_suppkey", "period_date", "total", "previous", "change", "percent_change")


@query("""
WITH last AS (SELECT *, coalesce(person_cik, person) AS p FROM ownership QUALIFY row_number() OVER (PARTITION BY issuer_cik, coalesce(person_cik, person) ORDER BY filed DESC, accession_number DESC, person_index) = 1)
SELECT issuer_cik, person AS reporting_person_name, pct AS percent_of_class, rank FROM (SELECT *, row_number() OVER (PARTITION BY issuer_cik ORDER BY coalesce(pct, -1) DESC, person) AS rank FROM last) WHERE rank <= 5
""")
def beneficial_owner_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.beneficial_owners(catalog(spark, sf_dir)["sec_13dg_ownership"], size=5).select("issuer_cik", "reporting_person_name", "percent_of_class", "rank")


@query("SELECT cik, tag, period_end, filed, value FROM xbrl WHERE filed <= '2024-01-20' AND period_end <= '2024-01-20' QUALIFY row_number() OVER (PARTITION BY cik, tag, period_end ORDER BY filed DESC, accession_number DESC) = 1")
def xbrl_known_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.known_on(catalog(spark, sf_dir)["sec_xbrl_facts"], "2024-01-20").select("cik", "tag", "period_end", "filed", "value")


@query("""
WITH k AS (SELECT * FROM xbrl WHERE filed <= '2024-02-20' AND period_end <= '2024-02-20' QUALIFY row_number() OVER (PARTITION BY cik, tag, period_end ORDER BY filed DESC, accession_number DESC) = 1),
p AS (SELECT cik, period_end, max(value) FILTER (WHERE tag = 'Assets') AS a, max(value) FILTER (WHERE tag = 'LiabilitiesAndStockholdersEquity') AS b, max(value) FILTER (WHERE tag = 'AssetsCurrent') AS c, max(value) FILTER (WHERE tag = 'LiabilitiesCurrent') AS d FROM k GROUP BY ALL)
SELECT cik, period_end, a AS assets, b AS others, abs(a - b) <= 0.005 * greatest(abs(a), abs(b), 1) AS balances, CASE WHEN d <> 0 THEN round(c / d, 4) END AS current_ratio FROM p
""")
def xbrl_balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = reads.known_on(catalog(spark, sf_dir)["sec_xbrl_facts"], "2024-02-20")
    return reads.balance_checks(known).select("cik", "period_end", "assets", "others", "balances", "current_ratio")


@query("SELECT cik, tag, count(*) AS n, arg_min(value, period_end || filed || accession_number) AS first_value, arg_max(value, period_end || filed || accession_number) AS last_value FROM (SELECT DISTINCT * FROM xbrl) GROUP BY cik, tag")
def xbrl_series_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    c.put("sec_xbrl_facts", c["sec_xbrl_facts"].unionByName(c["sec_xbrl_facts"]))
    out = serving.xbrl_series_documents(c)
    return out.select("cik", "tag", F.size("observations").cast("long").alias("n"), F.col("observations")[0]["value"].alias("first_value"), F.element_at("observations", -1)["value"].alias("last_value"))


@query("""
WITH f AS (SELECT doc_id, text, instr(lower(text), 'licensed under') - 1 AS p FROM documents), g AS (SELECT doc_id, greatest(0, p - 180) AS s, least(length(text), p + 900) AS e, text FROM f WHERE p >= 0)
SELECT doc_id, s::INT AS "start", e::INT AS "end", substring(text, s + 1, e - s) AS snippet, len(regexp_extract_all(substring(text, s + 1, e - s), '[0-9]+(?:[.,][0-9]+)*')) AS n_numbers FROM g
""")
def phrase_search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = relational.phrase_rows(table(spark, sf_dir, "documents"), "text", "Licensed under")
    out = docs.select("doc_id", relational.snippet("text", "Licensed under").alias("f")).select("doc_id", "f.*")
    return out.withColumn("n_numbers", F.size(F.regexp_extract_all("snippet", F.lit("[0-9]+(?:[.,][0-9]+)*"), F.lit(0))).cast("long"))


@query("""
WITH d AS (SELECT x.cik, 'cik:' || x.cik AS node_id, x.lei, decision, score FROM crosswalk x WHERE decision = 'REVIEW')
SELECT node_id, score FROM d WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.node_id = d.node_id AND r.lei = d.lei) ORDER BY score DESC, node_id LIMIT 25
""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return reads.review_queue(serving.decision_documents(c), c["match_reviews"]).select("node_id", "score")


# --- gates ---


def _derived(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two facts an order (one where the key is a multiple of 13) and a sum of them."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.selectExpr("o_orderkey AS k", "explode(CASE WHEN o_orderkey % 13 = 0 THEN array(1) ELSE array(1, 2) END) AS i")
    facts = rows.selectExpr(
        "concat('f_', k, '_', i) AS fact_id", "string(k % 50 + i) AS value", "CASE WHEN k % 10 = 0 AND i = 2 THEN 'EUR' ELSE 'USD' END AS unit", "CASE WHEN k % 31 <> 0 THEN 'row' END AS locator", "'d' AS document_id", "CASE WHEN k % 37 = 0 THEN ' ' ELSE '2024' END AS as_of",
        "CASE WHEN k % 41 <> 0 THEN 's' END AS source", "'f' AS source_file", "'2024' AS snapshot_date",
    )
    derivations = orders.selectExpr("concat('d_', o_orderkey) AS derivation_id", "array(concat('f_', o_orderkey, '_1'), concat('f_', o_orderkey, '_2')) AS input_ids", "'sum' AS formula", "double(2 * (o_orderkey % 50) + 3 + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END) AS value")
    return facts, derivations


@query("""
WITH f AS (SELECT o_orderkey AS k, 1 AS i FROM orders UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderkey % 13 <> 0)
SELECT 'addressed' AS gate, 'f_' || k || '_' || i AS id FROM f WHERE k % 31 = 0 UNION ALL SELECT 'dated', 'f_' || k || '_' || i FROM f WHERE k % 37 = 0 UNION ALL SELECT 'provenance', 'f_' || k || '_' || i FROM f WHERE k % 41 = 0
UNION ALL SELECT 'derivation_inputs', 'd_' || o_orderkey FROM orders WHERE o_orderkey % 13 = 0 UNION ALL SELECT 'units', 'd_' || o_orderkey FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 10 = 0
UNION ALL SELECT 'recomputes', 'd_' || o_orderkey FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 17 = 0
""")
def gate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.failures(*_derived(spark, sf_dir))


# --- beyond the reference: events by window ---


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowed_totals(table(spark, sf_dir, "events"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
