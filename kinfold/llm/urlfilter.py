"""URL filtering by Bloom filter cascades: exact membership of listed keys, with neither a join nor the list.

A key is a host suffix followed by a path prefix. Level 0 of a cascade encodes the listed keys; level 1 the unlisted
keys of the corpus that level 0 lets through; level 2 the listed keys that level 1 lets through, and so on until
none is left, so that over the listed keys and all keys of the corpus the first level that lacks a key decides
exactly. One pass over the corpus finds the false positives of level 0. Their expected number stays below the
number of listed keys, as level 0 is sized by the number of distinct keys in the corpus; this bounds what the driver
gathers and what executors receive. A key can only be listed if its numbers of host labels and path characters
occur in the list, so each URL has few keys, however long it is.

Null URLs and those without :// have an empty host and path, fit no rule and are allowed. Rows are judged one by
one: repeated ones get equal results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value

HOST, PATH = re.compile(r"[^/?#]*"), re.compile(r"[^?#]*")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: False positives that level 0 may have for each listed key before it is built anew, larger.
MOST_PASSED = 8


class Bloom(NamedTuple):
    bits: bytes
    size: int
    hashes: int
    seed: int

    def __contains__(self, key: str) -> bool:
        h = xxhash.xxh3_128_intdigest(key, self.seed)
        at, step = h & ((1 << 64) - 1), (h >> 64) | 1
        for _ in range(self.hashes):
            bit = at % self.size
            if not self.bits[bit >> 3] >> (bit & 7) & 1:
                return False
            at += step
        return True


def make_bloom(keys: Iterable[str], rate: float, seed: int) -> Bloom:
    keys = list(keys)
    size = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
    hashes = max(1, round(-math.log2(rate)))
    bits = bytearray(size // 8 + 1)
    for key in keys:
        h = xxhash.xxh3_128_intdigest(key, seed)
        at, step = h & ((1 << 64) - 1), (h >> 64) | 1
        for _ in range(hashes):
            bit = at % size
            bits[bit >> 3] |= 1 << (bit & 7)
            at += step
    return Bloom(bytes(bits), size, hashes, seed)


class Cascade(NamedTuple):
    """Exact for the listed keys and the universe it was built over."""

    levels: list[Bloom]

    def __contains__(self, key: str) -> bool:
        for depth, level in enumerate(self.levels):
            if key not in level:
                return depth % 2 == 1
        return len(self.levels) % 2 == 1


def make_cascade(listed: set[str], first: Bloom, passed: set[str]) -> Cascade:
    """passed: the unlisted keys of the universe that first lets through."""
    levels, inside, outside = [first], listed, passed
    while outside:
        levels.append(make_bloom(outside, 0.5, len(levels)))
        inside, outside = outside, {k for k in inside if k in levels[-1]}
    return Cascade(levels)


class Shape(NamedTuple):
    """The numbers of host labels and of path characters that occur among listed keys."""

    labels: list[int]
    prefixes: list[int]

    def keys(self, host: str, path: str) -> list[str]:
        """The keys that a URL could be listed by, the longest first; of equally long ones that with the longer host."""
        if not host:
            return []
        dots = [0, *(m.end() for m in re.finditer(r"\.", host))]
        hosts = [host[dots[-n] :] for n in self.labels if n <= len(dots)]
        found = [(len(h) + n, len(h), h + path[:n]) for h in hosts for n in self.prefixes if n <= len(path)]
        return [key for _, _, key in sorted(found, reverse=True)]


def split_url(url: str | None) -> tuple[str, str]:
    _, colon, rest = (url or "").partition("://")
    if not colon:
        return "", ""
    host = HOST.match(rest)[0]
    return host.translate(LOWER), PATH.match(rest, len(host))[0]


def _shape(keys: Iterable[str]) -> Shape:
    split = [(h, s + p) for h, s, p in (k.partition("/") for k in keys)]
    return Shape(sorted({h.count(".") + 1 for h, _ in split}), sorted({len(p) for _, p in split}))


def _passed(urls: DataFrame, shape: Shape, firsts: list[Bloom]) -> DataFrame:
    """Distinct (list number, key): keys of the corpus that the list's level 0 lets through, listed ones among them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for url in batch.column(0).to_pylist():
                for key in shape.keys(*split_url(url)):
                    found.update((i, key) for i, first in enumerate(firsts) if key in first)
            found = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([k for _, k in found], pa.string())], ["list", "key"])

    return urls.mapInArrow(scan, "list int, key string").distinct()


def _count_keys(urls: DataFrame, shape: Shape) -> int:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = {xxhash.xxh3_64_intdigest(k) >> 1 for url in batch.column(0).to_pylist() for k in shape.keys(*split_url(url))}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.int64())], ["key"])

    return urls.mapInArrow(scan, "key long").agg(F.approx_count_distinct("key")).first()[0]


def make_cascades(urls: DataFrame, lists: list[set[str]]) -> tuple[list[Cascade], Shape]:
    """A cascade for each list, exact over the keys of urls (one string column)."""
    shape = _shape(set().union(*lists))
    total = max(1, _count_keys(urls, shape))
    rates = [min(0.5, max(1, len(x)) / (math.sqrt(2) * total)) for x in lists]
    while True:
        firsts = [make_bloom(x, rate, 0) for x, rate in zip(lists, rates, strict=True)]
        most = [(MOST_PASSED + 1) * len(x) + 64 for x in lists]  # level 0 lets all listed keys through
        rows = _passed(urls, shape, firsts).limit(sum(most) + 1).collect()  # one more than may be; then all are found anew
        passed = [{r["key"] for r in rows if r["list"] == i} - x for i, x in enumerate(lists)]
        if len(rows) <= sum(most):
            return [make_cascade(x, first, more) for x, first, more in zip(lists, firsts, passed, strict=True)], shape
        rates = [rate / 16 for rate in rates]


def filter_urls(
    pages: DataFrame, allow: set[str], block: set[str], blocked_hosts: set[str], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Per row: id_col, host, path, rule and verdict.

    allow and block hold rules, a host and a path such as example.org/es/, which fit that host and its subdomains and
    all paths that start so; the longest that fits decides. Without one, blocked_hosts (and their subdomains) are
    blocked and all else is allowed; rule is then null.
    """
    lists = [allow, block | blocked_hosts]
    urls = pages.select(pages[url_col].alias("url"))
    (allowed, blocked), shape = make_cascades(urls, lists)
    shared = pages.sparkSession.sparkContext.broadcast((allowed, blocked, shape))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed, blocked, shape = shared.value
        for batch in batches:
            hosts, paths, rules, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = None, "allow"
                for key in shape.keys(host, path):
                    if key in blocked or key in allowed:
                        verdict = "block" if key in blocked else "allow"
                        if "/" in key:
                            rule = key
                            break
                        if verdict == "block":  # a host of the method's own list; a shorter rule still goes first
                            rule = next((k for k in shape.keys(host, path) if "/" in k and (k in blocked or k in allowed)), None)
                            verdict = "block" if rule is None or rule in blocked else "allow"
                            break
                for column, value in ((hosts, host), (paths, path), (rules, rule), (verdicts, verdict)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts))], ["id", "host", "path", "rule", "verdict"])

    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"))
    out = rows.mapInArrow(judge, f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


ship_by_value(__name__)
