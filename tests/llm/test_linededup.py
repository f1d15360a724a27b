from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from kinfold.llm import linededup
from kinfold.llm.linededup import LAST_ID, line_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs, least):
    """Every run of lines against every earlier place, one after another."""
    units = []
    for d, (i, t) in enumerate(docs):
        lines = (t or "").split("\n")
        units.append((LAST_ID if i is None else i, d, lines, [(k, len(WORD.findall(x)), x) for k, x in enumerate(lines) if WORD.search(x)]))
    first = {}
    runs = []
    for i, d, _, us in units:
        for a in range(len(us)):
            words = 0
            for b in range(a, len(us)):
                words += us[b][1]
                if words >= least:
                    content = tuple(x[2] for x in us[a : b + 1])
                    place = (i, us[a][0])
                    runs.append((d, us[a][0], us[b][0], content, place))
                    first[content] = min(first.get(content, place), place)
    gone = [set() for _ in docs]
    for d, a, b, content, place in runs:
        if place > first[content]:
            gone[d] |= set(range(a, b + 1))
    out = []
    for (i, t), g, (_, _, lines, _) in zip(docs, gone, units, strict=True):
        text = t or "" if not g else "\n".join(x for k, x in enumerate(lines) if k not in g)
        out.append((i, text, len(lines), len(g), sum(k - 1 not in g for k in g)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark, clash):
    rnd = random.Random(4)
    pool = [" ".join(rnd.choice("abcde") for _ in range(rnd.choice([0, 1, 2, 3, 6, 9]))) for _ in range(14)]
    docs = [(rnd.choice([*range(25), None]) if k % 9 else 7, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))) for k in range(60)]
    docs = list(dict.fromkeys(docs)) + [(200, None), (201, ""), (202, "\n\n"), (203, "x " * 12 + "\n" + "x " * 12), (204, "q " * 12), (205, "q " * 12 + "\nlast one")]
    df = clash(spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("x", "y"))
    got = sorted((tuple(r) for r in line_dedup(df, min_words=10).collect()), key=repr)
    assert got == brute(docs, 10)


def test_long_texts_equal_rows_and_empty_tables(spark):
    long = "\n".join(f"line {i % 5000} with words" for i in range(20_000))
    df = spark.createDataFrame([(1, long), (2, long), (2, long)], "doc_id long, text string")
    rows = line_dedup(df).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_deleted"], r["n_runs"]) for r in rows) == [(1, 20_000, 15_000, 1), (2, 20_000, 20_000, 1), (2, 20_000, 20_000, 1)]
    assert line_dedup(df.limit(0)).count() == 0


def test_plan_is_native(spark):
    df = line_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "MapInArrow"))


def test_shared_runs_share_a_selected_position(spark):
    """Fewer positions than windows are written, and two texts with a common run of min_words select the same line in it."""
    rnd = random.Random(8)
    line = lambda: " ".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([1, 2, 3, 5])))
    shared = [line() for _ in range(12)]
    docs = []
    for i in range(40):
        a = rnd.randint(0, 6)
        docs.append((i, "\n".join([line() for _ in range(rnd.randint(0, 30))] + shared[a : a + 6] + [line() for _ in range(rnd.randint(0, 30))])))
    found = {}
    rows = linededup._rows(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", ()).select(F.col("doc_id").alias("id"), "text_hash", F.split("text", "\n").alias("lines"))
    unit = f"struct(i AS line, regexp_count(l, '{linededup.WORD}') AS words, xxhash64(l) AS a, xxhash64(l, 1) AS b)"
    units = rows.select("id", "text_hash", F.expr(f"transform(lines, (l, i) -> {unit})").alias("units")).select("*", F.expr(linededup._windows(8)).alias("windows"))
    for r in linededup.selected_positions(units).collect():
        found.setdefault(r["id"], set()).add(r["at"])
    texts = dict((i, t.split("\n")) for i, t in docs)
    assert sum(map(len, found.values())) < 0.7 * sum(map(len, texts.values()))
    for i in texts:
        for j in texts:
            for a in range(len(texts[i])):
                for b in range(len(texts[j])):
                    n = 0
                    while a + n < len(texts[i]) and b + n < len(texts[j]) and texts[i][a + n] == texts[j][b + n]:
                        n += 1
                    if i != j and sum(len(x.split()) for x in texts[i][a : a + n]) >= 8:
                        assert any(a + k in found[i] and b + k in found[j] for k in range(n))
