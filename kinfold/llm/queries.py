"""The registered query of each operator, with its production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, htmltext, linededup, minhash, pii, quality, suffixdedup, toxicity, urlfilter

ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the URL filter, and the hosts that it blocks besides.
ALLOW, BLOCK = {"org/", "com/fr/"}, {"example.org/es/", "example.org/en/1", "com/de/"}
BLOCKED_HOSTS = {"cheap-pills.example.com", "spam-farm.example.org", "free-bets.example.com", "ads-track.example.org"}


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixdedup.suffix_dedup(_table(spark, sf_dir, "documents"), min_bytes=50)
    removed = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)").alias("n_removed")
    return done.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op1_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS p FROM d),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM p),
late AS (SELECT w.doc_id, w.p FROM w JOIN (SELECT s, min(doc_id) AS m FROM w GROUP BY s) f ON w.s = f.s AND w.doc_id > f.m),
edge AS (SELECT *, coalesce(p - lag(p) OVER o, 1000) > 50 AS new FROM late WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
number AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM edge),
span AS (SELECT doc_id, k, min(p) AS s, max(p) + 50 AS e FROM number GROUP BY ALL),
gap AS (SELECT doc_id, k, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY k), 0) AS a, s AS b FROM span
  UNION ALL SELECT doc_id, max(k) + 1, max(e), 1000000000 FROM span GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(d.h, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.k) AS h FROM gap g JOIN d ON g.doc_id = d.doc_id GROUP BY g.doc_id),
total AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN total ON d.doc_id = total.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = htmltext.extract_text(_table(spark, sf_dir, "pages"), keep=("url",))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"), ALLOW, BLOCK, BLOCKED_HOSTS)


ORACLES["op3_url_filter"] = r"""
WITH split AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS raw, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM split),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
hosts(h) AS (VALUES ('cheap-pills.example.com'), ('spam-farm.example.org'), ('free-bets.example.com'), ('ads-track.example.org')),
best AS (
  SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL
)
SELECT page_id, host, path, rule,
  coalesce(v, CASE WHEN EXISTS (SELECT 1 FROM hosts WHERE host = h OR ends_with(host, '.' || h)) THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = f"filter(spans, s -> s.rank < {len(pii.BASE)})"
    counts = [F.expr(f"bigint(size(filter(spans, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.expr(f"sha2({joined.format(base)}, 256)").alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.line_dedup(_table(spark, sf_dir, "documents"), min_words=50)
    return done.select("doc_id", "n_lines", "n_deleted", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op5_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
u AS (SELECT *, row_number() OVER o AS k, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS cum FROM w WHERE words > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
ahead AS (SELECT a.doc_id, a.k AS s, min(b.k) AS e FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 49 AND b.cum - a.cum + a.words >= 50 GROUP BY ALL),
back AS (SELECT a.doc_id, max(b.k) AS s, a.k AS e FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k - 49 AND a.k AND a.cum - b.cum + b.words >= 50 GROUP BY a.doc_id, a.k),
spans AS (SELECT doc_id, s, e FROM ahead UNION SELECT doc_id, s, e FROM back),
content AS (SELECT x.doc_id, min(u.i) AS first, max(u.i) AS last, string_agg(u.line, chr(10) ORDER BY u.k) AS c FROM spans x JOIN u ON u.doc_id = x.doc_id AND u.k BETWEEN x.s AND x.e GROUP BY x.doc_id, x.s, x.e),
placed AS (SELECT *, min(struct_pack(d := doc_id, f := first)) OVER (PARTITION BY c) AS p FROM content),
late AS (SELECT doc_id, first, last FROM placed WHERE struct_pack(d := doc_id, f := first) > p),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(first, last + 1)) AS i FROM late)),
marked AS (SELECT l.doc_id, l.i, l.line, gone.i IS NOT NULL AS g FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i),
runs AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY i), false) AS start FROM marked)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g) AS n_deleted, count(*) FILTER (WHERE start) AS n_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT g), '')) AS kept_sha256
FROM runs GROUP BY doc_id
""".replace("\\\\", "\\")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


ORACLES["op6_minhash"] = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT d, y FROM reach JOIN link ON r = x),
m AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, component_id, t.doc_id = component_id AS kept FROM t LEFT JOIN n ON t.doc_id = n.doc_id JOIN m ON t.doc_id = m.d
""".replace("\\\\", "\\")


def _held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learnt from the labelled rows of docs that are not held out."""
    return toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~_held_out()))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity_model(docs, spark, sf_dir))
    return scored.select("doc_id", _held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.bpe(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontam.mark_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    listed = "array_join(transform(items, x -> concat(x.item, CASE WHEN x.same THEN '' ELSE '~' END)), ',')"
    return marked.select("doc_id", F.size("items").cast("long").alias("n_items"), F.expr(listed).alias("items"), (F.size("items") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_html_text, op3_url_filter, op4_pii, op5_line_dedup, op6_minhash, op7_toxicity, op8_quality, op9_bpe, op10_decontamination)}
