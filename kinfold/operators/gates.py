"""Gates that facts and derivations must pass before an answer may use them; answers refer to facts by placeholder."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.formulas import FORMULAS, recomputes

from .relational import union_by_name

PLACEHOLDER = re.compile(r"\{\{\s*(f_[0-9a-f]{16})\s*\}\}")
NUMBER = re.compile(r"\d+(?:[.,]\d+)*")


def unaddressed(facts: DataFrame) -> DataFrame:
    return facts.where("locator IS NULL OR trim(locator) = '' OR document_id IS NULL").select("fact_id")


def undated(facts: DataFrame) -> DataFrame:
    return facts.where("as_of IS NULL OR trim(as_of) = ''").select("fact_id")


def without_provenance(facts: DataFrame) -> DataFrame:
    return facts.where("source IS NULL OR source_file IS NULL OR snapshot_date IS NULL").select("fact_id")


def missing_inputs(derivations: DataFrame, facts: DataFrame) -> DataFrame:
    """Derivations (derivation_id, input_ids) with an input that is no fact, or with none."""
    inputs = derivations.select("derivation_id", F.explode_outer("input_ids").alias("fact_id"))
    return inputs.join(facts.select("fact_id"), "fact_id", "left_anti").select("derivation_id").distinct()


def mixed_units(derivations: DataFrame, facts: DataFrame) -> DataFrame:
    """Derivations whose formula needs one unit and whose inputs have several."""
    same = [name for name, f in FORMULAS.items() if f.same_units]
    inputs = derivations.where(F.col("formula").isin(same)).select("derivation_id", F.explode("input_ids").alias("fact_id"))
    units = inputs.join(facts.select("fact_id", F.coalesce("unit", F.lit("")).alias("unit")), "fact_id").groupBy("derivation_id").agg(F.min("unit").alias("low"), F.max("unit").alias("high"))
    return units.where("low <> high").select("derivation_id")


def not_recomputed(derivations: DataFrame, facts: DataFrame) -> DataFrame:
    """Derivations of two inputs whose stated value is not what the formula gives."""
    values = facts.select("fact_id", F.col("value").try_cast("double").alias("v"))
    rows = derivations.join(values.withColumnsRenamed({"fact_id": "_a", "v": "a"}), F.col("input_ids")[0] == F.col("_a")).join(values.withColumnsRenamed({"fact_id": "_b", "v": "b"}), F.try_element_at("input_ids", F.lit(2)) == F.col("_b"), "left")
    computed = F.coalesce(*[F.when(F.col("formula") == name, f.compute("a", "b")) for name, f in FORMULAS.items()])
    return rows.withColumn("computed", computed).where(~F.coalesce(recomputes("value", "computed"), F.lit(False))).select("derivation_id")


def failures(facts: DataFrame, derivations: DataFrame) -> DataFrame:
    """(gate, id) of everything that fails, for all six gates."""
    found = [("addressed", unaddressed(facts)), ("dated", undated(facts)), ("provenance", without_provenance(facts)), ("derivation_inputs", missing_inputs(derivations, facts)), ("units", mixed_units(derivations, facts)), ("recomputes", not_recomputed(derivations, facts))]
    return union_by_name([t.select(F.lit(gate).alias("gate"), F.col(t.columns[0]).alias("id")) for gate, t in found])


def fact_address(*parts: str) -> str:
    import hashlib

    return "f_" + hashlib.sha256(":".join(parts).encode()).hexdigest()[:16]


def display_value(value: str | float, unit: str | None) -> str:
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    text = f"{number:,.0f}" if number == int(number) else f"{number:,.2f}"
    return f"${text}" if unit == "USD" else f"{text}%" if unit == "percent" else f"{text} {unit}" if unit else text


def render_answer(text: str, facts: Mapping[str, tuple[str, str | None]]) -> str:
    """text with its placeholders replaced; numbers that no fact backs are refused."""
    bare = PLACEHOLDER.sub("", text)
    if loose := NUMBER.search(bare):
        raise ValueError(f"a number without a fact: {loose[0]}")
    unknown = {i for i in PLACEHOLDER.findall(text) if i not in facts}
    if unknown:
        raise ValueError(f"unknown facts: {sorted(unknown)}")
    return PLACEHOLDER.sub(lambda m: display_value(*facts[m[1]]), text)
