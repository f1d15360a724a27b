"""Column helpers with the null, order and rounding rules that the operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def latest_value(value: Column | str, by: Column | str) -> Column:
    """Aggregate: the value of greatest by, among rows where neither is null."""
    value, by = col(value), col(by)
    both = value.isNotNull() & by.isNotNull()
    return F.max_by(F.when(both, value), F.when(both, by))


def some_value(value: Column | str) -> Column:
    """Aggregate: one non-null value, always the least, so that reruns agree."""
    return F.min(col(value))


def nested_list(keys: Sequence[Column], payload: Column) -> Column:
    """Aggregate: payloads in the order of keys. Keys must sort as wanted in ascending order, nulls first."""
    names = [f"k{i}" for i in range(len(keys))]
    rows = F.sort_array(F.collect_list(F.struct(*[k.alias(n) for k, n in zip(keys, names, strict=True)], payload.alias("payload"))))
    return F.transform(rows, lambda r: r["payload"])


def descending(c: Column | str) -> list[Column]:
    """Keys for nested_list that put greater numbers first and nulls last."""
    return [col(c).isNull(), -col(c)]


def ascending(c: Column | str) -> list[Column]:
    return [col(c).isNull(), col(c)]


def filing_date(c: Column | str) -> Column:
    """Date of a text such as 07-FEB-2024, else null."""
    return F.try_to_date(col(c), "d-MMM-yyyy")


def any_date(c: Column | str) -> Column:
    """Date of an ISO text or one such as 07-FEB-2024, else null."""
    return F.coalesce(F.try_to_date(col(c), "yyyy-MM-dd"), filing_date(c))


def us_date(c: Column | str) -> Column:
    """ISO text of a month/day/year text; other texts pass."""
    return F.coalesce(F.date_format(F.try_to_date(col(c), "M/d/yyyy"), "yyyy-MM-dd"), col(c))


def compact_date(c: Column | str) -> Column:
    """ISO text of yyyymmdd; null for open ends (9999), zero and anything else."""
    parsed = F.try_to_date(col(c), "yyyyMMdd")
    return F.when(F.year(parsed) < 9999, F.date_format(parsed, "yyyy-MM-dd"))


def as_bigint(c: Column | str) -> Column:
    """Whole number of a numeric text, rounded half away from zero; null if it is none."""
    return F.round(col(c).try_cast("decimal(38,6)"), 0).try_cast("bigint")


def double_text(c: Column | str) -> Column:
    """Text of a double without exponent: 100.0, 0.0001."""
    plain = col(c).cast("decimal(38,12)").cast("string")
    trimmed = F.rtrim(plain, F.lit("0"))
    return F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)


def yes(c: Column | str) -> Column:
    return F.coalesce(F.upper(F.trim(col(c))) == "Y", F.lit(False))


def same_or_both_null(a: Column | str, b: Column | str) -> Column:
    return col(a).eqNullSafe(col(b))
