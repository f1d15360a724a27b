from __future__ import annotations

import random

from kinfold.llm import urlfilter as U
from kinfold.llm.queries import ALLOW, BLOCK, BLOCKED_HOSTS


def brute(url):
    host, path = U.split_url(url)
    fits = [r for r in ALLOW | BLOCK if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    rule = max(fits, key=len, default=None)
    blocked = rule in BLOCK if rule else any(host == h or host.endswith("." + h) for h in BLOCKED_HOSTS)
    return host, path, rule, "block" if blocked else "allow"


URLS = [None, "", "no scheme", "://", "http://", "http://EXAMPLE.org/es/x", "http://www.example.org/en/1234?q#f", "https://a.b.com/fr/", "http://com/de/x", "http://xcom/de/", "http://org", "http://org?x", "http://org/", "ftp://x.cheap-pills.example.com/a/b", "http://cheap-pills.example.com/fr/1",
        "http://spam-farm.example.org/", "http://spam-farm.example.org/es/", "http://ÄÖ.Org/é", "a://b://c/d", "http://..org/", "http://" + "a." * 5000 + "org/" + "x" * 5000]


def test_equals_brute_force(spark, clash):
    rnd = random.Random(3)
    urls = URLS + ["http://" + ".".join(rnd.choice(["a", "example", "org", "com", "net", "cheap-pills"]) for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "/", "/es/1", "/en/1", "/fr/", "/de/2", "?x"]) for _ in range(500)]
    df = clash(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.filter_urls(df, ALLOW, BLOCK, BLOCKED_HOSTS).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert U.filter_urls(df.limit(0), ALLOW, BLOCK, BLOCKED_HOSTS).count() == 0


def test_cascade_is_exact_over_its_universe():
    universe = {f"k{i}" for i in range(5000)}
    listed = {f"k{i}" for i in range(0, 5000, 50)}
    first = U.make_bloom(listed, 0.1, 0)
    cascade = U.make_cascade(listed, first, {k for k in universe - listed if k in first})
    assert len(cascade.levels) > 1 and {k for k in universe if k in cascade} == listed
    assert "k1" not in U.make_cascade(set(), U.make_bloom([], 0.5, 0), set())
