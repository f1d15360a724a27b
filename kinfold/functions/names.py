"""Normalised names and what is read from them; columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col

# Word lists of the name rules.
LEGAL_SUFFIXES = "limited ltd llc lp llp inc incorporated plc corp corporation co company gmbh sa sarl nv bv ag spa srl kg ab as oy aps sas sc scsp icav".split()
STRUCTURE_WORDS = "master feeder offshore domestic umbrella".split()
ROMAN = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split()
BUSINESS_WORDS = "capital management partners group holdings advisors advisers associates asset assets investment investments fund funds gp lp pte sdn bhd".split()
PLACE_WORDS = (
    "uk us usa eu hk sg jp ch de fr ie lu ky bvi je gg ae difc dubai london europe asia international global america japan hong kong united kingdom states emirates arab cayman islands virgin british singapore switzerland"
).split()
FUND_WORDS = "fund spc trust icav".split()
#: Latin letters that are not an ASCII letter with a mark.
DIGRAPHS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "þ": "th", "ı": "i"}


def _marked_letters() -> tuple[str, str]:
    """Latin letters with marks and their bare letters, by Unicode's own decompositions."""
    import unicodedata

    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = unicodedata.normalize("NFD", chr(code))[0]
        if bare.isascii() and bare != chr(code):
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def to_ascii(c: Column | str) -> Column:
    """Latin letters without marks; other scripts pass unchanged."""
    out = F.translate(col(c), *_marked_letters())
    for letter, plain in DIGRAPHS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.when(F.length(col(c)) == F.octet_length(col(c)), col(c)).otherwise(out)  # most names are ASCII already


def normalize_name(c: Column | str) -> Column:
    """Lower-case ASCII words, one space apart; empty for null."""
    text = F.lower(to_ascii(F.coalesce(col(c), F.lit(""))))
    text = F.regexp_replace(text, "[.'’]", "")
    text = F.regexp_replace(text, r"[,()\[\]/\\-]", " ")
    text = F.replace(text, F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(name: Column | str) -> Column:
    """Words of a normalised name; none for an empty one."""
    return F.filter(F.split(col(name), " "), lambda w: w != "")


def _trailing(options: list[str]) -> str:
    return "(?:(?:^| )(?:" + "|".join(options) + "))+$"


def strip_legal_suffix(name: Column | str) -> Column:
    """Without the legal forms at its end, which may leave nothing."""
    return F.regexp_replace(col(name), _trailing(LEGAL_SUFFIXES), "")


def has_word(name: Column | str, word: str) -> Column:
    return F.array_contains(words(name), word)


def structure_flags(name: Column | str) -> dict[str, Column]:
    return {f"is_{w}": has_word(name, w) for w in STRUCTURE_WORDS[:4]}


def fund_number(core: Column | str) -> Column:
    """Number at the end of a core name, as up to three digits or a roman numeral up to xx."""
    last = F.regexp_extract(col(core), r"([^ ]+)$", 1)
    roman = F.array_position(F.lit(ROMAN), last).cast("int")
    return F.when(last.rlike("^[0-9]{1,3}$"), last.cast("int")).when(roman > 0, roman)


def name_fields(legal_name: Column | str) -> dict[str, Column]:
    """All derived columns of a name, by their names in the register."""
    norm = normalize_name(legal_name)
    core = strip_legal_suffix(norm)
    return {"legal_name_norm": norm, "legal_name_core": core, "name_tokens": words(norm), "fund_number": fund_number(core), **structure_flags(norm)}


def with_name_fields(df: DataFrame, legal_name: str) -> DataFrame:
    """df with the columns of name_fields, each made from those before it, so that a name is normalised once."""
    df = df.withColumn("legal_name_norm", normalize_name(legal_name)).withColumn("legal_name_core", strip_legal_suffix("legal_name_norm"))
    return df.withColumns({"name_tokens": words("legal_name_norm"), "fund_number": fund_number("legal_name_core"), **structure_flags("legal_name_norm")})


def compact(name: Column | str) -> Column:
    return F.replace(col(name), F.lit(" "), F.lit(""))


def aggressive_core(core: Column | str) -> Column:
    """A core name without structure words and without one trailing number, for grouping confusable names."""
    bare = F.regexp_replace(col(core), r"\b(" + "|".join(STRUCTURE_WORDS) + r")\b", "")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.trim(F.regexp_replace(bare, r"\s(" + "|".join(ROMAN) + "|[0-9]{1,3})$", ""))


def word_count(name: Column | str) -> Column:
    return F.length(col(name)) - F.length(compact(name)) + 1


def brand_core(name: Column | str) -> Column:
    """A raw name without legal forms, business words and places at its end, down to one word.

    Once a business word or place has gone, legal forms before it go as well, except that the rest stays as it is
    if it consists of legal forms alone. So what goes is a run at the end of words from either list, and the run
    never takes the first word; where the first word is a legal form too, the words up to the last that is not one stay.
    """
    core = strip_legal_suffix(normalize_name(name))
    tail = "|".join(dict.fromkeys([*BUSINESS_WORDS, *PLACE_WORDS]))
    either = "|".join(dict.fromkeys([*BUSINESS_WORDS, *PLACE_WORDS, *LEGAL_SUFFIXES]))
    stripped = F.regexp_extract(core, rf"^([^ ]+(?: [^ ]+)*?)(?: (?:{either}))* (?:{tail})$", 1)
    forms = "|".join(LEGAL_SUFFIXES)
    only_forms = F.regexp_extract(core, rf"^((?:{forms})(?: (?:{forms}))*)(?: (?:{either}))* (?:{tail})$", 1)
    both = "|".join(w for w in LEGAL_SUFFIXES if w in BUSINESS_WORDS or w in PLACE_WORDS)
    only_forms = F.regexp_replace(only_forms, rf"(?: (?:{both}))+$", "")
    return F.when(only_forms != "", only_forms).when(stripped == "", core).otherwise(stripped)


def brand_tier(query_core: Column | str, candidate_core: Column | str) -> Column:
    """high for the same brand, possible for one that goes on with further words, else null."""
    q, c = col(query_core), col(candidate_core)
    return F.when((q == "") | (c == ""), None).when(q == c, "high").when(c.startswith(F.concat(q, F.lit(" "))), "possible")


def guess_role(norm: Column | str, number: Column | str, master: Column | str, feeder: Column | str) -> Column:
    fund = col(number).isNotNull() | F.coalesce(col(master), F.lit(False)) | F.coalesce(col(feeder), F.lit(False))
    return F.when(fund | F.arrays_overlap(words(norm), F.lit(FUND_WORDS)), "fund").otherwise("management")
