"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Everything is built from DataFrame functions. For each kind a text is cut by the kind's pattern into gaps and hits;
running sums of their lengths give the offsets. The patterns equal the plain leftmost, non-overlapping ones, but
start a run of characters only at its head (or where the last hit ended) and never give characters back, so that
long runs cost linear time and no stack.

Base kinds (email, ip, card, phone) stay whatever their score. The further kinds need a score of min_score: iban
(mod-97 confirmed), ssn (only near words such as "social security"), secret (a value assigned to a token or
password) and local phone numbers (only near words such as "call"). They give way to overlapping base spans.

Null or empty text has no spans. Repeated rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds, in an order that also ranks spans with the same start.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "secret": r"(?<=(?:token|secret|password|passwd|api_key|apikey)\x20?[=:]\x20?[\"']?)[A-Za-z0-9_+/=.-]{16,512}",
    "local_phone": r"(?<![0-9+(])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
KINDS = {k: i for i, k in enumerate([*BASE, *MORE])}
#: Score without and with a context word within NEAR characters of the span, and the words.
NEAR = 48
SCORES = {
    "email": (0.9, 1.0, "mail|contact|write"), "ip": (0.6, 0.8, "ip|server|address|host"), "card": (0.7, 1.0, "card|visa|credit|pay|iban"),
    "phone": (0.7, 1.0, "call|phone|tel|mobile|fax"), "iban": (0.8, 1.0, "iban|account|bank"), "ssn": (0.3, 0.8, "ssn|social|security|tax"),
    "secret": (0.8, 1.0, "key|secret|private"), "local_phone": (0.3, 0.8, "call|phone|tel|mobile|fax|contact"),
}
#: Lengths are summed in blocks of so many hits, which keeps the offsets of many hits from taking quadratic time.
BLOCK = 256


def _luhn(hit: str) -> str:
    digits = f"split(reverse(translate({hit}, ' -', '')), '')"
    doubled = "CASE WHEN i % 2 = 0 THEN int(c) WHEN int(c) > 4 THEN 2 * int(c) - 9 ELSE 2 * int(c) END"
    return f"aggregate(transform(filter({digits}, c -> c <> ''), (c, i) -> {doubled}), 0, (a, x) -> a + x) % 10 = 0"


def _mod97(hit: str) -> str:
    compact = f"translate({hit}, ' ', '')"
    chars = f"filter(split(concat(substr({compact}, 5), substr({compact}, 1, 4)), ''), c -> c <> '')"
    value = "CASE WHEN c >= 'A' THEN (a * 100 + ascii(c) - 55) % 97 ELSE (a * 10 + ascii(c) - 48) % 97 END"
    return f"length({compact}) BETWEEN 15 AND 34 AND aggregate({chars}, 0, (a, c) -> {value}) = 1"


def _digits(hit: str) -> str:
    return rf"length(regexp_replace({hit}, '[^0-9]', ''))"


#: What confirms a hit h, as SQL; kinds that are not listed need no more than their pattern.
CONFIRM = {
    "ip": r"forall(split(h, '\\.'), p -> length(ltrim('0', p)) < 3 OR length(ltrim('0', p)) = 3 AND ltrim('0', p) <= '255')",
    "card": f"CASE WHEN length(h) > 37 OR {_digits('h')} NOT BETWEEN 12 AND 19 THEN false ELSE {_luhn('h')} END",
    "phone": f"{_digits('h')} BETWEEN 9 AND 15",
    "iban": _mod97("h"),
}
#: A cheap test that every text with a hit passes.
MAY_HOLD = {"email": "instr(text, '@') > 0", "phone": "instr(text, '+') > 0", "secret": "text RLIKE '[=:]'"}
HAS_DIGIT = "text RLIKE '[0-9]'"


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _starts(kind: str) -> str:
    """Offset of each hit: the lengths of all gaps up to its own and of all earlier hits."""
    size = f"transform({kind}_hits, (h, i) -> length({kind}_gaps[i]) + length(h))"
    upto = f"aggregate(slice(sizes, (i DIV {BLOCK}) * {BLOCK} + 1, int(i % {BLOCK})), 0, (a, x) -> a + x)"
    blocks = f"transform(sequence(0, int(size(sizes) DIV {BLOCK})), b -> aggregate(slice(sizes, b * {BLOCK} + 1, {BLOCK}), 0, (a, x) -> a + x))"
    return (
        f"flatten(transform(array({size}), sizes -> flatten(transform(array({blocks}), blocks -> "
        f"transform({kind}_hits, (h, i) -> aggregate(slice(blocks, 1, i DIV {BLOCK}), 0, (a, x) -> a + x) + {upto} + length({kind}_gaps[i]))))))"
    )


def _context(kind: str) -> str:
    """SQL for the NEAR characters before and after hit i, across other hits of the kind; trimmed has the ends of the gaps.

    A hit has two characters at least, so NEAR / 2 neighbours on each side are enough.
    """
    hits, most = f"{kind}_hits", NEAR // 2
    earlier = f"array_join(transform(slice({hits}, greatest(i - {most}, 0) + 1, least(i, {most})), (x, j) -> concat(right(trimmed[greatest(i - {most}, 0) + j], {NEAR}), right(x, {NEAR}))), '')"
    later = f"array_join(transform(slice({hits}, i + 2, {most}), (x, j) -> concat(left(x, {NEAR}), left(trimmed[i + j + 2], {NEAR}))), '')"
    before = f"CASE WHEN i = 0 OR length(trimmed[i]) >= {NEAR} THEN right(trimmed[i], {NEAR}) ELSE right(concat({earlier}, trimmed[i]), {NEAR}) END"
    after = f"CASE WHEN i + 1 = size({hits}) OR length(trimmed[i + 1]) >= {NEAR} THEN left(trimmed[i + 1], {NEAR}) ELSE left(concat(trimmed[i + 1], {later}), {NEAR}) END"
    return f"concat({before}, ' ', {after})"


def _spans(kind: str) -> str:
    low, high, words = SCORES[kind]
    near = rf"lower({_context(kind)}) RLIKE '\\b(?:{words})'"
    trimmed = f"transform({kind}_gaps, g -> CASE WHEN length(g) <= {2 * NEAR} THEN g ELSE concat(left(g, {NEAR}), right(g, {NEAR})) END)"
    span = f"struct(starts[i] AS start, {KINDS[kind]} AS rank, starts[i] + length(h) AS end, '{kind}' AS kind, CASE WHEN {near} THEN {high}D ELSE {low}D END AS score, {CONFIRM.get(kind, 'true')} AS ok)"
    return f"filter(flatten(transform(array({_starts(kind)}), starts -> flatten(transform(array({trimmed}), trimmed -> transform({kind}_hits, (h, i) -> {span}))))), s -> s.ok)"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.6) -> DataFrame:
    """Per row: id_col and spans, an array of (start, rank, end, kind, score) by start and then kind.

    Offsets count code points, ends are exclusive.
    """
    df = docs.select(docs[id_col].alias(id_col), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    if id_col == "text":
        raise ValueError("id_col may not be named text")
    df = df.withColumns({"digit": F.expr(HAS_DIGIT), "secret": F.expr(MAY_HOLD["secret"])})
    cut: dict[str, Column] = {}
    for kind, pattern in {**BASE, **MORE}.items():
        may = " AND ".join([MAY_HOLD.get(kind, "true"), "digit" if kind not in ("email", "secret") else "true"])
        cut[f"{kind}_gaps"] = F.expr(f"CASE WHEN {may} THEN split(text, {_sql_text(pattern)}, -1) ELSE array(text) END")
        cut[f"{kind}_hits"] = F.expr(f"CASE WHEN {may} THEN regexp_extract_all(text, {_sql_text(pattern)}, 0) ELSE array() END")
    df = df.select(id_col, *[c.alias(k) for k, c in cut.items()])
    df = df.select(id_col, *[F.expr(f"CASE WHEN size({k}_hits) = 0 THEN array() ELSE {_spans(k)} END").alias(k) for k in KINDS])
    base = f"concat({', '.join(BASE)})"
    more = f"filter(concat({', '.join(MORE)}), s -> s.score >= {min_score})"
    clear = f"filter({more}, s -> NOT exists(base, b -> b.start < s.end AND s.start < b.end))"
    df = df.select(id_col, F.expr(base).alias("base"), *MORE)
    fields = "struct(s.start AS start, s.rank AS rank, s.end AS end, s.kind AS kind, s.score AS score)"
    return df.select(id_col, F.expr(f"transform(array_sort(concat(base, {clear})), s -> {fields})").alias("spans"))
