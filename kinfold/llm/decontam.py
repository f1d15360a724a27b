"""Benchmark decontamination by canonical templates. DataFrame functions only.

Numbers, units after numbers, and capitalised names within a sentence become typed placeholders; what is left is
lower-cased, freed of punctuation and cut into tokens. A template is the set of an item's distinct windows of five
tokens, of which two at least are literal; the window of the first word, whose capital would read as a name within a
sentence, counts only where there is no other. A document holds an item if at least 80 % of the item's template occurs
in it, where a window with placeholders counts only if its slots are consistent: each value of the item must stand
for one and the same value of the document, the one that most of the matching windows agree on (ties: the least).
So a copy with other numbers or names is found, while a text that merely shares phrases is not.

All occurrences of a window count, not just its first: a document may repeat parts of an item, or hold it several
times with other values. So values are agreed on, and windows counted, in several scopes, and the best one decides:
the occurrences at one and the same distance from their places in the item, which are those of one unbroken copy;
those at nearly the same distance, for copies with insertions; those with the item's own values; the first of each
window; and all. Each occurrence is in six scopes at most, so work is linear in the text.

Candidates come from a hash join of document windows with so many of each item's rarest windows that 80 % cannot be
reached without one of them; only candidates are matched in full. Item windows are broadcast if they are counted to
be few, else joined by shuffle; matches are reduced by document before that. Nothing grows with pairs of documents.

Items without any template (fewer than five tokens, or no window with two literals) are matched as a whole, with
their exact values: a document holds such an item if the item's words, numbers and signs occur in it one after the
other, whatever their case, white space and other punctuation. Characters of scripts without spaces are words of
their own. There is no least length: an item of one word is held by every document with that word.

Null text counts as empty. Items without words, numbers and signs match nothing. Rows of equal id and text
count as one document and get equal results; a null id is an id. An empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stash

SIZE, LEAST_LITERALS, LEAST_SHARE = 5, 2, 0.8
#: Windows of items that are broadcast at most; more are joined by shuffle.
BROADCAST_WINDOWS = 500_000
#: What numbers, units and names look like. A placeholder is a control character, its value, and \x05.
NUMBER = r"(?<![\p{L}\p{N}])\p{N}+(?:[.,]\p{N}+)*+(?![\p{L}\p{N}])"
UNITS = "percent|km|kilometers?|miles?|meters?|cm|mm|feet|foot|inches|kg|kilograms?|grams?|g|pounds?|lbs?|tons?|liters?|ml|seconds?|minutes?|hours?|days?|weeks?|months?|years?|dollars?|euros?|cents?|usd|eur|degrees?|mph|kmh"
UNIT = rf"(?i)(?<=\x05\x20?)(?:{UNITS})(?![\p{{L}}\p{{N}}])"
NAME = r"(?<=[\p{L}\p{N},;]\x20)\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"


def _text(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _marked(text: str) -> str:
    """SQL for the text with placeholders, lower-cased, without other punctuation."""
    plain = f"translate({text}, '\\u0001\\u0002\\u0003\\u0005', '')"
    named = f"regexp_replace({plain}, {_text(NAME)}, '\\u0002$0\\u0005')"
    numbered = f"regexp_replace(regexp_replace({named}, {_text(NUMBER)}, '\\u0001$0\\u0005'), {_text(UNIT)}, '\\u0003$0\\u0005')"
    filled = f"CASE WHEN {text} RLIKE '\\\\p{{N}}' THEN {numbered} ELSE {named} END"
    return f"regexp_replace(lower({filled}), {_text(r'[^\p{L}\p{N}\s\x01-\x05]+')}, '')"


def _tokens(marked: str) -> str:
    return f"filter(split({marked}, '\\\\s+', -1), x -> x <> '')"


def _windows(tokens: str) -> str:
    """SQL for the hash of each window of five tokens; the third argument to xxhash64 and on are literals of position."""
    parts = ", ".join(f"{tokens}[i + {k}]" for k in range(SIZE))
    return f"CASE WHEN size({tokens}) >= {SIZE} THEN transform(sequence(0, size({tokens}) - {SIZE}), i -> xxhash64({parts})) ELSE array() END"


def _slots(raw: str) -> str:
    """SQL for the (kind and value) strings of the window at i, in order."""
    return f"flatten(transform(slice({raw}, i + 1, {SIZE}), x -> regexp_extract_all(x, '[\\u0001-\\u0003][^\\u0005]*', 0)))"


#: Scopes of an occurrence: all, the item's own values, the first of its window, the same distance, nearly the same.
STEP = "bigint(floor(apart / ceil(length / 2)))"
SCOPES = (
    "filter(array(struct(0 AS kind, 0L AS place), CASE WHEN forall(pairs, p -> p.item_slots = p.slots) THEN struct(1 AS kind, 0L AS place) END, CASE WHEN first THEN struct(2 AS kind, 0L AS place) END, "
    f"struct(3 AS kind, apart AS place), struct(4 AS kind, {STEP} AS place), struct(4 AS kind, {STEP} + 1 AS place)), s -> s IS NOT NULL)"
)
CANONICAL = "regexp_replace({}, '([\\u0001-\\u0003])[^\\u0005]*\\u0005', '$1')"


def _prepared(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, raw tokens (with values) and canonical tokens of the column text."""
    rows = rows.select(*keys, F.expr(_marked("text")).alias("marked"))
    rows = rows.select(*keys, "marked", F.expr(f"CASE WHEN instr(marked, '\\u0005') > 0 THEN {CANONICAL.format('marked')} ELSE marked END").alias("canonical"))
    # values may not hold white space, so both cuts have the same number of tokens
    return rows.select(*keys, F.expr(_tokens("marked")).alias("raw"), F.expr(_tokens("canonical")).alias("tokens"))


def _placed(rows: DataFrame, *keys: str, skip_first: bool = False) -> DataFrame:
    """keys, window hash, place and slots of each occurrence; without the first window, if skip_first and there are others."""
    literals = f"size(filter(slice(tokens, i + 1, {SIZE}), x -> NOT x RLIKE '[\\u0001-\\u0003]')) >= {LEAST_LITERALS}"
    each = f"transform(hashes, (h, i) -> struct(h AS window, i AS at, {_slots('raw')} AS slots, {literals} AS literal, size(hashes) = 1 AS alone))"
    rows = rows.select(*keys, "raw", "tokens", F.expr(_windows("tokens")).alias("hashes"))
    rows = rows.select(*keys, F.explode(F.expr(each)).alias("w")).select(*keys, "w.*").where("literal")
    if skip_first:
        rows = rows.where("at > 0 OR alone")
    return rows.select(*keys, "window", "at", "slots")


#: What an item without a template is compared by: characters of scripts without spaces, numbers, words, signs.
PIECE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]\p{M}*+|\p{N}++(?:[.,]\p{N}++)*+|(?:(?![\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])[\p{L}\p{M}])++|[\p{Sm}\p{Sc}*/^%\u2010-\u2015-]"
PIECES = f"regexp_extract_all(lower(text), {_text(PIECE)}, 0)"


def _whole(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(id, text_hash, item, share, same) of items (item, text, pieces) that rows (id, text_hash, text) hold as a whole.

    Documents meet items by the hash of an item's first pieces, five at most; then the whole sequence is sought.
    """
    items = items.withColumn("n", F.least(F.lit(SIZE), F.size("pieces"))).withColumn("probe", F.expr("xxhash64(n, slice(pieces, 1, n))"))
    items = stash(items.select("item", "n", "probe", F.expr("concat(' ', array_join(pieces, ' '), ' ')").alias("whole")), "whole-items")
    count = items.count()
    sizes = sorted(r["n"] for r in items.select("n").distinct().collect())  # five rows at most
    if not sizes:
        return rows.select("id", "text_hash", F.lit(None).cast(items.schema["item"].dataType).alias("item"), F.lit(1.0).alias("share"), F.lit(True).alias("same")).where("false")
    pieces = rows.select("id", "text_hash", F.expr(PIECES).alias("pieces"))
    starts = ", ".join(f"CASE WHEN size(pieces) >= {n} THEN transform(sequence(0, size(pieces) - {n}), i -> xxhash64({n}, slice(pieces, i + 1, {n}))) ELSE array() END" for n in sizes)
    probes = pieces.select("id", "text_hash", F.explode(F.array_distinct(F.expr(f"flatten(array({starts}))"))).alias("probe"))
    found = stash(probes.join(_few(items.select("probe", "item", "whole"), count), "probe").select("id", "text_hash", "item", "whole").distinct(), "whole-candidates")
    found = found.select(F.col("id").alias("c_id"), F.col("text_hash").alias("c_hash"), "item", "whole")
    texts = rows.join(found.select("c_id", "c_hash").distinct(), rows["id"].eqNullSafe(F.col("c_id")) & (rows["text_hash"] == F.col("c_hash")), "left_semi").dropDuplicates(["id", "text_hash"])
    texts = texts.select("id", "text_hash", F.expr(f"concat(' ', array_join({PIECES}, ' '), ' ')").alias("pieces"))
    held = texts.join(found, texts["id"].eqNullSafe(found["c_id"]) & (texts["text_hash"] == found["c_hash"])).where("instr(pieces, whole) > 0")
    return held.select("id", "text_hash", "item", F.lit(1.0).alias("share"), F.lit(True).alias("same")).distinct()


def _few(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= BROADCAST_WINDOWS else df


@scratch
def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, text_hash, item, share, same): items held by documents; same if all their slots have the item's own values."""
    items = benchmark.select(benchmark[item_col].alias("item"), F.coalesce(benchmark[item_text_col], F.lit("")).alias("text")).distinct()
    given = items
    items = _placed(_prepared(items, "item"), "item", skip_first=True).groupBy("item", "window").agg(F.min_by("slots", "at").alias("slots"), F.min("at").alias("at"))
    rarity = F.count("*").over(Window.partitionBy("window"))
    order = Window.partitionBy("item").orderBy("rarity", "window")
    items = items.withColumn("rarity", rarity).select("item", "window", F.col("slots").alias("item_slots"), F.col("at").alias("item_at"), F.count("*").over(Window.partitionBy("item")).alias("size"), F.expr("max(at) OVER (PARTITION BY item) - min(at) OVER (PARTITION BY item) + 1").alias("length"), F.row_number().over(order).alias("rank"))
    items = stash(items, "item-windows")
    count = items.count()
    # a row of given, as one id may have several texts; the template of an id is that of all its texts
    plain = given.join(items.select(F.col("item").alias("t_item")).distinct(), given["item"].eqNullSafe(F.col("t_item")), "left_anti")
    plain = plain.select("item", F.expr(PIECES).alias("pieces")).where("size(pieces) > 0")
    # of size windows, any floor(0.2 * size) + 1 include one that a text with 80 % of them holds
    probes = items.where(F.col("rank") <= F.floor((1 - LEAST_SHARE) * F.col("size") + 1e-9) + 1).select("window", "item")
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    found = _prepared(rows, "id", "text_hash").select("id", "text_hash", F.explode(F.expr(_windows("tokens"))).alias("window"))
    candidates = stash(found.join(_few(probes, count), "window").select("id", "text_hash", "item").distinct(), "candidates")
    wanted = candidates.select(F.col("id").alias("c_id"), F.col("text_hash").alias("c_hash")).distinct()
    same_row = rows["id"].eqNullSafe(wanted["c_id"]) & (rows["text_hash"] == wanted["c_hash"])
    texts = rows.join(wanted, same_row, "left_semi").dropDuplicates(["id", "text_hash"])
    windows = _placed(_prepared(texts, "id", "text_hash"), "id", "text_hash")
    windows = windows.withColumn("first", F.col("at") == F.min("at").over(Window.partitionBy("id", "text_hash", "window")))
    held = windows.join(_few(items, count), "window").withColumns({"pairs": F.expr("arrays_zip(item_slots, slots)"), "apart": F.expr("bigint(at - item_at)")})
    held = held.select("id", "text_hash", "item", "size", "window", "pairs", F.explode(F.expr(SCOPES)).alias("scope")).distinct()
    held = stash(held, "held-windows")
    key = ["id", "text_hash", "item"]
    votes = held.select(*key, "scope", F.explode("pairs").alias("p")).select(*key, "scope", F.col("p.item_slots").alias("own"), F.col("p.slots").alias("other"))
    votes = votes.groupBy(*key, "scope", "own", "other").agg(F.count("*").alias("n"))
    chosen = votes.groupBy(*key, "scope", "own").agg(F.max_by("other", F.struct("n", F.expr("- xxhash64(other)"))).alias("other"))
    mapping = chosen.groupBy(*key, "scope").agg(F.map_from_entries(F.collect_list(F.struct("own", "other"))).alias("mapping")).select(*[F.col(k).alias(f"m_{k}") for k in [*key, "scope"]], "mapping")
    on = held["id"].eqNullSafe(mapping["m_id"]) & (held["text_hash"] == mapping["m_text_hash"]) & (held["item"] == mapping["m_item"]) & (held["scope"] == mapping["m_scope"])
    held = held.join(mapping, on, "left").where("forall(pairs, p -> mapping[p.item_slots] = p.slots)")
    whole = held.groupBy(*key, "scope").agg(F.max("size").alias("size"), F.count("*").alias("n"), F.bool_and(F.expr("forall(pairs, p -> p.item_slots = p.slots)")).alias("same"))
    whole = whole.where(F.col("n") >= LEAST_SHARE * F.col("size") - 1e-9).withColumn("share", F.col("n") / F.col("size"))
    return whole.groupBy(*key).agg(F.max(F.struct("share", "same")).alias("best")).select(*key, "best.share", "best.same").unionByName(_whole(rows, plain))


@scratch
def mark_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id_col, text_col, the columns in keep, and items: an array of (item, share, same) by item, empty if clean."""
    held = matches(docs, benchmark, id_col, text_col, item_col).groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("item", "share", "same"))).alias("held"))
    held = stash(held, "contaminated")
    rows = docs.select(id_col, text_col, *keep).withColumn("held_hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    held = held.select(F.col("id").alias("held_id"), F.col("text_hash").alias("h"), "held")
    rows = rows.join(held, rows[id_col].eqNullSafe(held["held_id"]) & (rows["held_hash"] == held["h"]), "left")
    return rows.select(id_col, text_col, *keep, F.coalesce("held", F.array().cast(held.schema["held"].dataType)).alias("items"))
