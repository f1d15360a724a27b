"""Deletion of repeated runs of lines by winnowing over line hashes. DataFrame functions only.

1. Lines with words are hashed. From each line on, and back from each line, the shortest window of lines with min_words
   words is taken. The least hash of a window (of equal ones the first) is its fingerprint; the distinct selected
   positions are written, far fewer than windows. Two runs that agree in min_words words or more share a window,
   wherever they lie, and so a fingerprint at the same place of both: no shared run is missed.
2. Positions meet by fingerprint. Where one occurs only once in the corpus, nothing can match.
3. Each position that is left is extended both ways, to all windows that chose it, and these are compared by two
   hashes of all their lines. Of equal windows the first occurrence (by document id, then line) stays and the lines of
   all later ones go, within a document too; overlapping windows make up a whole run.

So a line goes if and only if it lies in a run of consecutive lines, lines without words aside, with min_words words
or more, that also occurs earlier. Lines without words inside such a run go with it. Positions are not paired with
each other, as a frequent line would give all pairs: a window finds its first occurrence by aggregation.

Counts of fingerprints and first places of windows are combined before any shuffle, so a passage that a third of all
rows share is as cheap as others. Null text counts as empty and has no lines to delete. Rows with equal id and text
count as one document; null ids rank last. Offsets and counts are those of the text's \n-separated lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stash

#: A word, and the longest window in lines follows from min_words, as each line has a word.
WORD = r"[^\\x20\\x09-\\x0D]+"
LAST_ID = (1 << 63) - 1


def _windows(min_words: int) -> str:
    """SQL for an array: for each unit (line with words) the windows ahead and back, as (first, last, low) or null.

    first and last number units; low is the unit of least hash in the window.
    """
    grow = f"(a, x) -> CASE WHEN a.words >= {min_words} THEN a ELSE struct(a.words + x.words AS words, a.n + 1 AS n) END"
    size = f"CASE WHEN u.words >= {min_words} THEN struct(u.words AS words, 1 AS n) ELSE aggregate({{}}, struct(0 AS words, 0 AS n), {grow}) END"
    ahead = size.format(f"slice(units, i + 1, {min_words})")
    back = size.format(f"reverse(slice(units, greatest(1, i + 2 - {min_words}), least(i + 1, {min_words})))")
    low = "array_min(transform(slice(units, {first} + 1, {n}), (x, k) -> struct(x.a AS a, {first} + k AS at))).at"
    one = f"transform(array({ahead}), r -> CASE WHEN r.words >= {min_words} THEN struct(i AS first, i + r.n - 1 AS last, {low.format(first='i', n='r.n')} AS low) END)[0]"
    two = f"transform(array({back}), r -> CASE WHEN r.words >= {min_words} THEN struct(i - r.n + 1 AS first, i AS last, {low.format(first='(i - r.n + 1)', n='r.n')} AS low) END)[0]"
    return f"transform(units, (u, i) -> struct({one} AS ahead, {two} AS back))"


def _rows(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    clash = {"n_lines", "n_deleted", "n_runs", "text_hash"} & {id_col, text_col, *keep}
    if clash:
        raise ValueError(f"columns of the result: {clash}")
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col], text.alias(text_col), *[docs[k] for k in keep], F.xxhash64(text).alias("text_hash"))


def selected_positions(units: DataFrame) -> DataFrame:
    """(id, text_hash, fingerprint, at) of the distinct units that are a window's least; units: see repeated_windows."""
    lows = "array_distinct(concat(filter(windows.ahead.low, x -> x IS NOT NULL), filter(windows.back.low, x -> x IS NOT NULL)))"
    each = f"transform({lows}, k -> struct(units[k].a AS fingerprint, k AS at))"
    return units.select("id", "text_hash", F.explode(F.expr(each)).alias("s")).select("id", "text_hash", "s.*")


@scratch
def repeated_windows(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, text_hash, first, last): line numbers, from 0, of each window that occurs earlier."""
    rows = _rows(docs, id_col, text_col, ()).select(F.col(id_col).alias("id"), "text_hash", F.split(F.col(text_col), "\n", -1).alias("lines"))
    unit = f"struct(i AS line, regexp_count(l, '{WORD}') AS words, xxhash64(l) AS a, xxhash64(l, 1) AS b)"
    rows = rows.select("id", "text_hash", F.expr(f"filter(transform(lines, (l, i) -> {unit}), u -> u.words > 0)").alias("units"))
    rows = rows.where(f"aggregate(units, 0L, (n, u) -> n + u.words) >= {min_words}")
    units = stash(rows.select("*", F.expr(_windows(min_words)).alias("windows")), "line-units")
    selected = stash(selected_positions(units), "line-fingerprints")
    shared = selected.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    met = selected.join(stash(shared, "shared-fingerprints"), "fingerprint").groupBy("id", "text_hash").agg(F.collect_set("at").alias("met"))
    met = met.select(F.col("id").alias("met_id"), F.col("text_hash").alias("met_hash"), "met")
    rows = units.join(met, units["id"].eqNullSafe(met["met_id"]) & (units["text_hash"] == met["met_hash"]))
    # the windows that chose position k begin at most min_words units before it, and end at most so many after
    before = f"slice(windows.ahead, greatest(0, k + 1 - {min_words}) + 1, least(k + 1, {min_words}))"
    after = f"slice(windows.back, k + 1, {min_words})"
    chosen = f"flatten(transform(met, k -> array_distinct(filter(concat({before}, {after}), w -> w.low = k))))"
    part = "slice(units, w.first + 1, w.last - w.first + 1)"
    hashes = f"struct(units[w.first].line AS first, units[w.last].line AS last, xxhash64(transform({part}, u -> u.a)) AS c1, xxhash64(transform({part}, u -> u.b)) AS c2)"
    rows = rows.select("id", "text_hash", "units", F.expr(chosen).alias("windows"))
    rows = rows.select("id", "text_hash", F.explode(F.expr(f"transform(windows, w -> {hashes})")).alias("w")).select("id", "text_hash", "w.*")
    windows = stash(rows, "line-windows")
    place = F.struct(F.coalesce("id", F.lit(LAST_ID)).alias("id"), F.col("first").alias("line"))
    key = ["c1", "c2"]
    starts = windows.groupBy(*key).agg(F.min(place).alias("place"), F.max(place).alias("end")).where("place < end").select(*key, "place")
    return stash(windows.join(stash(starts, "line-starts"), key).where(place > F.col("place")).select("id", "text_hash", "first", "last"), "late-windows")


@scratch
def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id_col, text_col without the deleted lines, the columns in keep, n_lines, n_deleted and n_runs (longs)."""
    found = repeated_windows(docs, id_col, text_col, min_words)
    gone = found.groupBy("id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("gone"))
    gone = gone.select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), F.expr("sort_array(array_distinct(flatten(transform(gone, w -> sequence(w.first, w.last)))))").alias("gone"))
    rows = _rows(docs, id_col, text_col, keep)
    rows = rows.join(gone, rows[id_col].eqNullSafe(gone["gone_id"]) & (rows["text_hash"] == gone["gone_hash"]), "left")
    lines = f"split(`{text_col}`, '\\n', -1)"
    left = f"CASE WHEN gone IS NULL THEN `{text_col}` ELSE array_join(transform(array_except(sequence(0, size({lines}) - 1), gone), i -> lines[i]), '\\n') END"
    rows = rows.withColumn("lines", F.expr(f"CASE WHEN gone IS NOT NULL THEN {lines} END"))
    return rows.select(
        id_col,
        F.expr(left).alias(text_col),
        *keep,
        F.expr(f"bigint(length(`{text_col}`) - length(replace(`{text_col}`, '\\n', '')) + 1)").alias("n_lines"),
        F.expr("bigint(coalesce(size(gone), 0))").alias("n_deleted"),
        F.expr("bigint(coalesce(size(filter(gone, (x, i) -> i = 0 OR gone[i - 1] < x - 1)), 0))").alias("n_runs"),
    )
