"""Quality rules: robust multivariate outliers among text statistics, per language and source. DataFrame functions only.

Of each text come counts, and from them a vector of transformed statistics (symbols, word length, repeated words,
repeated lines, capitals). Texts that fail the base rules are rejected and take no part in the estimates. For each
language and source a minimum-covariance-determinant estimate of centre and spread is made. There are three starts:
medians and quartiles, the moments of all texts, and the moments of statistics drawn in to two spreads around their
medians. From each, concentration steps keep the share of texts nearest to the last estimate and estimate anew from
those, until no determinant changes by more than TOLERANCE in its logarithm, or MOST_STEPS times; of a group's starts
that with the least determinant counts. Texts whose Mahalanobis distance from their group is beyond a chi-squared
quantile are rejected. Each statistic has a least spread, as many are 0 throughout a clean group; it is added to the
covariance wherever distances and determinants are taken. The share is cut at distance bins of 1 / DISTANCE_BINS of
a factor e, so it holds up to a bin more than SHARE.

Every step is one aggregation to counts and sums by group, start and distance bin, combined before the shuffle, so a source
that holds a third of all rows costs no more than others. Statistics are integers on a fixed grid and all sums are
exact, so results do not depend on the order of rows. Groups with fewer than least_rows texts join the rest of their
language, languages with fewer the rest of all; a group with fewer than that is not judged.

Null text counts as empty; empty and short texts fail the base rules. A null language or source is a value of its
own. Rows are judged one by one; repeated ones count repeatedly in the estimates. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stash, scratch, stash

#: As SQL text: white space of the word rule, and the symbols that are counted.
SPACE, SYMBOLS = r"' \t\n\u000b\u000c\r'", "'#*$%&|<>'"
#: Grid of the statistics, bins for medians, and bins of a factor e for squared distances.
GRID, COARSE, DISTANCE_BINS = 1024, 16, 64
#: Transformed statistics as SQL, and the least spread of each.
STATISTICS = {
    "symbols": ("ln(1 + 100D * n_symbols / word_chars)", 0.35),
    "word_length": ("ln(1D * word_chars / n_words)", 0.12),
    "repeated_words": ("sqrt(1D * n_repeat_words / n_words)", 0.16),
    "repeated_lines": ("sqrt(1D * n_dup_lines / n_lines)", 0.2),
    "capitals": ("sqrt(1D * n_capitals / word_chars)", 0.06),
}
NAMES = list(STATISTICS)
P = len(NAMES)
#: Share of a group that the estimates rest on, and the chi-squared quantile beyond which a text is rejected.
SHARE, QUANTILE = 0.75, 0.9999
#: Steps end when no log-determinant changes by more, and after so many at the latest.
TOLERANCE, MOST_STEPS = 0.01, 12
#: Where a start draws statistics in to, in spreads around the median.
DRAWN_IN = 2.0
#: So many groups at most are broadcast; more are joined.
BROADCAST_GROUPS = 100_000


def chi2_cdf(x: float, df: int) -> float:
    a, x = df / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(q: float, df: int) -> float:
    low, high = 1e-9, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < q else (low, mid)
    return low


def text_counts(docs: DataFrame, columns: list[Column], text: Column) -> DataFrame:
    """columns, and the counts of each text: whole texts, code points."""
    df = docs.select(*columns, F.coalesce(text, F.lit("")).alias("t"))
    df = df.withColumn("words", F.expr(r"filter(split(t, '[\\x20\\x09-\\x0D]+', -1), w -> w <> '')"))
    df = df.withColumn("grams", F.expr("CASE WHEN size(words) > 3 THEN transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) ELSE array() END"))
    df = df.withColumn("twice", F.expr("size(array_distinct(grams)) < size(grams)"))
    df = df.withColumn("placed", F.expr("CASE WHEN twice THEN sort_array(transform(grams, (g, i) -> struct(g, i))) END"))
    df = df.withColumn("again", F.expr("sort_array(transform(filter(placed, (x, i) -> i > 0 AND placed[i - 1].g = x.g OR i + 1 < size(placed) AND placed[i + 1].g = x.g), x -> x.i))"))
    repeated = "CASE WHEN twice THEN aggregate(transform(again, (x, i) -> CASE WHEN i + 1 < size(again) THEN least(3, again[i + 1] - x) ELSE 3 END), 0L, (a, x) -> a + x) ELSE 0L END"
    df = df.withColumns({
        "n_repeat_words": F.expr(repeated),
        "lines": F.expr(r"filter(split(t, '\n', -1), l -> l RLIKE '[^\\x20\\x09-\\x0D]')"),
    })
    kept = [c for c in df.columns if c not in ("t", "words", "grams", "twice", "placed", "again", "lines", "n_repeat_words")]
    return df.select(
        *kept,
        F.expr("bigint(size(words))").alias("n_words"),
        F.expr(f"bigint(length(translate(t, {SPACE}, '')))").alias("word_chars"),
        F.expr(f"bigint(length(t) - length(translate(t, {SYMBOLS}, '')))").alias("n_symbols"),
        F.expr("bigint(size(lines) - size(array_distinct(lines)))").alias("n_dup_lines"),
        "n_repeat_words",
        F.expr("bigint(size(lines))").alias("n_lines"),
        F.expr(r"bigint(length(t) - length(regexp_replace(t, '\\p{Lu}+', '')))").alias("n_capitals"),
    )


def _grouped(stats: DataFrame, least_rows: int) -> DataFrame:
    """stats and group: language and source, or the rest of the language, or the rest of all."""
    pairs = stats.groupBy("lang", "source").agg(F.count("*").alias("n"))
    pairs = pairs.withColumn("own", F.col("n") >= least_rows)
    rest = F.sum(F.when(~F.col("own"), F.col("n")).otherwise(0)).over(Window.partitionBy("lang"))
    pairs = pairs.withColumn("by_lang", rest >= least_rows)
    group = F.expr("CASE WHEN own THEN concat('s', to_json(struct(lang, source))) WHEN by_lang THEN concat('l', to_json(struct(lang))) ELSE 'rest' END")
    return _bounded_join(stats, pairs.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), group.alias("group")), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))).drop("g_lang", "g_source")


def _bounded_join(rows: DataFrame, few: DataFrame, on: Column | str, how: str = "inner") -> DataFrame:
    """few is broadcast only if it is counted to be small."""
    few = stash(few, "groups")
    return rows.join(F.broadcast(few) if few.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else few, on, how)


def _medians(stats: DataFrame) -> DataFrame:
    """A first estimate: each statistic's median, and its spread from the quartiles. Bins of 1 / COARSE of the grid's unit are counted."""
    step = GRID // (4 * COARSE)
    rows = stats.select("group", F.expr(f"inline(array({', '.join(f'struct({i} AS dim, {n} DIV {step} AS bin)' for i, n in enumerate(NAMES))}))"))
    counts = rows.groupBy("group", "dim", "bin").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("group", "dim").orderBy("bin")
    counts = counts.select("*", F.sum("n").over(ordered).alias("upto"), F.sum("n").over(Window.partitionBy("group", "dim")).alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin")))
    dims = counts.groupBy("group", "dim").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    scale = step / GRID
    picks = []
    for i, name in enumerate(NAMES):
        mine = lambda c, i=i: F.max(F.when(F.col("dim") == i, F.col(c)))
        picks += [((mine("mid") + 0.5) * scale).alias(f"m_{i}"), F.pow((mine("high") - mine("low")) * scale / 1.349, 2).alias(f"v_{i}_{i}")]
    return dims.groupBy("group").agg(*picks).select("*", *[F.lit(0.0).alias(f"v_{i}_{j}") for i in range(P) for j in range(i)])


def _sums() -> list[Column]:
    """Sums of the statistics and of their products, exact as integers."""
    return [F.sum(n).alias(f"s_{i}") for i, n in enumerate(NAMES)] + [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s_{i}_{j}") for i in range(P) for j in range(i + 1)]


def _moments(total: DataFrame, keys: list[str], correct: float) -> DataFrame:
    """keys, m_i and v_i_j from n and the sums; correct: factor of the covariance."""
    means = [(F.col(f"s_{i}") / F.col("n") / GRID).alias(f"m_{i}") for i in range(P)]
    spread = [((F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"s_{i}") / F.col("n") * (F.col(f"s_{j}") / F.col("n"))) * (correct / GRID**2)).alias(f"v_{i}_{j}") for i in range(P) for j in range(i + 1)]
    return total.select(*keys, *means, *spread)


def _starts(stats: DataFrame) -> DataFrame:
    """group, start, m_i, v_i_j of the three first estimates."""
    medians = stash(_medians(stats), "groups")
    rows = _bounded_join(stats.select("group", *NAMES), medians, "group")
    edge = lambda i, sign: f"bigint({GRID} * (m_{i} {sign} {DRAWN_IN} * sqrt(v_{i}_{i} + {STATISTICS[NAMES[i]][1] ** 2}D)))"
    drawn = rows.select("group", *[F.expr(f"greatest(least({n}, {edge(i, '+')}), {edge(i, '-')})").alias(n) for i, n in enumerate(NAMES)])
    starts = [medians]
    for part in (stats, drawn):
        starts.append(_moments(part.groupBy("group").agg(F.count("*").alias("n"), *_sums()), ["group"], 1.0))
    columns = ["group", *[f"m_{i}" for i in range(P)], *[f"v_{i}_{j}" for i in range(P) for j in range(i + 1)]]
    found = [df.select(F.lit(k).alias("start"), *columns) for k, df in enumerate(starts)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _triangle(moments: DataFrame) -> DataFrame:
    """group, start, m_i, l_i_j (the Cholesky factor of the covariance v_i_j with the least spreads added), log_det of that."""
    done = moments
    for i in range(P):
        floor = STATISTICS[NAMES[i]][1] ** 2
        for j in range(i + 1):
            inner = " - ".join([f"v_{i}_{j}" + (f" + {floor}D" if i == j else ""), *[f"l_{i}_{k} * l_{j}_{k}" for k in range(j)]])
            done = done.withColumn(f"l_{i}_{j}", F.expr(f"sqrt(greatest({inner}, {floor}D))" if i == j else f"({inner}) / l_{j}_{j}"))
    log_det = F.expr(" + ".join(f"2 * ln(l_{i}_{i})" for i in range(P)))
    return done.select("group", "start", *[f"m_{i}" for i in range(P)], *[f"l_{i}_{j}" for i in range(P) for j in range(i + 1)], log_det.alias("log_det"))


def _distance(rows: DataFrame) -> DataFrame:
    """rows and d2, the squared Mahalanobis distance by forward substitution."""
    for i, name in enumerate(NAMES):
        inner = " - ".join([f"{name} / {GRID}D - m_{i}", *[f"l_{i}_{k} * z_{k}" for k in range(i)]])
        rows = rows.withColumn(f"z_{i}", F.expr(f"({inner}) / l_{i}_{i}"))
    total = " + ".join(f"z_{i} * z_{i}" for i in range(P))
    return rows.withColumn("d2", F.expr(total)).drop(*[f"z_{i}" for i in range(P)], *[f"m_{i}" for i in range(P)], *[f"l_{i}_{j}" for i in range(P) for j in range(i + 1)])


def _step(stats: DataFrame, estimate: DataFrame) -> DataFrame:
    """For each start, the next estimate from the SHARE of each group that is nearest to the last one (of _triangle)."""
    keys = ["group", "start"]
    near = _distance(_bounded_join(stats.select("group", *NAMES), estimate.drop("log_det"), "group"))
    near = near.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * DISTANCE_BINS))
    bins = near.groupBy(*keys, "bin").agg(F.count("*").alias("n"), *_sums())
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")) - F.col("n")
    bins = bins.withColumn("in", before < F.ceil(SHARE * F.sum("n").over(Window.partitionBy(*keys)))).where("in")
    total = bins.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in bins.columns if c.startswith("s_")])
    return _triangle(_moments(total, keys, SHARE / chi2_cdf(chi2_quantile(SHARE, P), P + 2)))


@scratch
def least_determinants(stats: DataFrame) -> DataFrame:
    """The estimate of each group (of _triangle) whose determinant is least after the concentration steps."""
    estimate = stash(_triangle(_starts(stats)), "estimate")
    for _ in range(MOST_STEPS):
        after = stash(_step(stats, estimate), "estimate")
        now = after.select("group", "start", F.col("log_det").alias("now"))
        moved = estimate.join(now, ["group", "start"]).agg(F.max(F.abs(F.col("now") - F.col("log_det")))).first()[0]
        drop_stash(estimate)
        estimate = after
        if moved is None or moved <= TOLERANCE:
            break
    best = estimate.groupBy("group").agg(F.min_by(F.struct(*estimate.columns[1:]), F.struct("log_det", "start")).alias("best"))
    return stash(best.select("group", "best.*"), "estimate")


@scratch
def judge_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_rows: int = 50
) -> DataFrame:
    """Per row: id_col, the counts, base_failed, distance (squared; null if not judged) and kept."""
    columns = [docs[id_col].alias("id"), docs[lang_col].alias("lang"), docs[source_col].alias("source")]
    counts = text_counts(docs, columns, docs[text_col])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = counts.withColumn("base_failed", failed)
    scaled = [F.expr(f"CASE WHEN NOT base_failed THEN bigint(round({GRID} * {sql})) END").alias(n) for n, (sql, _) in STATISTICS.items()]
    counts = stash(counts.select("*", *scaled), "statistics")
    judged = _grouped(counts.where("NOT base_failed"), least_rows)
    estimate = least_determinants(judged).drop("start", "log_det")
    enough = judged.groupBy("group").agg(F.count("*").alias("rows"))
    judged = _distance(_bounded_join(judged, estimate.join(enough, "group"), "group"))
    judged = judged.withColumn("distance", F.when(F.col("rows") >= least_rows, F.col("d2")))
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance"]
    out = judged.select(*names).unionByName(counts.where("base_failed").withColumn("distance", F.lit(None).cast("double")).select(*names))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_quantile(QUANTILE, P))
    return out.withColumn("kept", kept).withColumnRenamed("id", id_col)
