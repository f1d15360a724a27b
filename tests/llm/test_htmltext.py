from __future__ import annotations

import collections
import random
import re
import time

import numpy as np
import pytest

from kinfold.llm import htmltext
from kinfold.llm.htmltext import extract_text, main_text

P = "Some real sentence of the article that goes on for a while, with commas."


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain text", "plain text"),
    (f"<body><nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>{P}<p>Short.</p><b>x</b></article><footer>f</footer></body>", f"T & U\n\n{P}\n\nShort.\n\nx"),
    (f"<html><body><div class='sidebar'>Side words</div><div id=content><p>{P}</p><p>a<br>b &nbsp; c</p></div><div class='comments'><p>{P} not me</p></div></body>", f"{P}\n\na b c"),
    (f"<main><form><p>{P}</p></form><p>{P}</p><aside>{P}</aside><script>var x = '<p>no</p>';</script><style>p</style><p hidden>h</p></main>", P),
    (f"<div><header>Head</header><article><header><h2>Title</h2></header><p>{P}</article><div class=ad>Buy</div></div>", f"Title\n\n{P}"),
    (f"<article><ul><li>{P}<li>two</ul><table><tr><td>c1<td>c2</table><!-- no --><p>{P} end", f"{P}\n\ntwo\n\nc1\n\nc2\n\n{P} end"),
    (f"<div role=navigation>n</div><article><p>{P} &#169; &lt;tag&gt; 5 < 6</p></article>", f"{P} © <tag> 5 < 6"),
])
def test_layouts(html, text):
    assert main_text(html) == text


def test_long_and_broken_pages():
    assert main_text("<p>" + "word " * 200_000 + "</p>").count("word") == 200_000
    assert main_text("<div>" * 3000 + P) == P
    assert main_text("<a <b <!-- " + P) is not None


def test_table(spark, clash, sf_dir):
    df = clash(spark.createDataFrame([(1, "u", f"<article><p>{P}</article>"), (1, "u", None)], "page_id long, url string, html string").drop("text"))
    assert sorted((r["page_id"], r["text"]) for r in extract_text(df, keep=("url",)).collect()) == [(1, ""), (1, P)]
    assert extract_text(df.limit(0)).count() == 0
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert extract_text(pages).where("text = ''").count() == 0


@pytest.mark.parametrize("html", [
    "<body><div id=content><div>{0}</div><div>{1}</div></div></body>",
    "<body><article>{0}</article><article>{1}</article></body>",
    "<body><main>{0}</main><div>{1}</div><nav><a href=x>Menu</a></nav></body>",
])
def test_content_in_several_containers(html):
    parts = [f"{P} {i}" for i in range(10)]
    page = html.format("".join(f"<p>{x}</p>" for x in parts[:8]), "<h2>More</h2>" + "".join(f"<p>{x}</p>" for x in parts[8:]))
    assert main_text(page) == "\n\n".join([*parts[:8], "More", *parts[8:]])


def prose(n, seed):
    return " ".join(random.Random(seed).choices("the river wind stone walked over under house morning light quiet people carried water across field and then they were".split(), k=n))


def labelled_pages():
    """(html, main text) of layouts without article and main, whose names tell nothing or mislead."""
    for s in range(6):
        p = lambda n, i, b=s * 50: f"<p>{prose(n, b + i)}.</p>"
        t = lambda n, i, b=s * 50: f"{prose(n, b + i)}."
        link = lambda i, b=s * 50: f"<a href=/l{i}>{prose(3, 1000 + b + i)}</a>"
        menu = "<div class=x1><ul>" + "".join(f"<li>{link(i)}</li>" for i in range(8)) + "</ul></div>"
        legal = "<div class=x2>" + "".join(f"<div>{link(20 + i)}</div>" for i in range(6)) + f"<div>{t(25, 9)}</div>" + "".join(f"<div>{link(30 + i)}</div>" for i in range(6)) + "</div>"
        sizes = [(40 if i % 2 else 12) + s for i in range(10)]
        body, text = "".join(p(n, i) for i, n in enumerate(sizes)), [t(n, i) for i, n in enumerate(sizes)]
        yield f"{menu}<div class=c3><h1>{prose(5, s)}</h1>{body}</div>{legal}", [prose(5, s), *text]
        yield f"{menu}<div class=c3>{''.join(f'<div class=r><div>{p(n, i)}</div></div>' for i, n in enumerate(sizes))}</div>{legal}", text
        short = [6, 30 + s, 9, 45, 8, 60, 7, 30, 5, 40]
        yield f"{menu}<div>{''.join(f'<section>{p(n, i)}</section>' for i, n in enumerate(short))}</div>{legal}", [t(n, i) for i, n in enumerate(short)]
        yield f"{menu}<div>{body}<ul><li>{t(8, 11)}<li>{t(4, 12)}</ul><blockquote>{p(20, 13)}</blockquote>{p(5, 14)}</div>{legal}<div>{t(6, 15)}</div>", [*text, t(8, 11), t(4, 12), t(20, 13), t(5, 14)]
        yield f"{menu}{body}{legal}", text
        yield f"{menu}<div class='widget sidebar'>{body}</div>{legal}", text
        yield f"{menu}<div>{body}</div><div>{''.join(f'<div><p>{t(9, 40 + i)} {link(40 + i)}</p></div>' for i in range(6))}</div>{legal}", text


def f1(got, want):
    a, b = collections.Counter(got.split()), collections.Counter(want.split())
    return 2 * (a & b).total() / max(1, a.total() + b.total())


def test_smoothed_ratios_decide(spark, sf_dir, monkeypatch):
    """On layouts that no element or name gives away, and on the given pages with those taken away."""
    given = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    bare = [re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", h).replace(' class="ad"', "") for h in given]
    made = [(f"<body>{h}</body>", "\n\n".join(t)) for h, t in labelled_pages()]
    labelled = made + list(zip(bare, map(main_text, given), strict=True))
    mean = lambda rows: np.mean([f1(main_text(h), t) for h, t in rows])
    smoothed, on_made = mean(labelled), mean(made)
    assert on_made > 0.97 and smoothed > 0.94
    monkeypatch.setattr(htmltext, "smooth", lambda x: x)
    assert mean(made) < on_made and mean(labelled) < smoothed
    noise = np.random.default_rng(1)
    monkeypatch.setattr(htmltext, "smooth", lambda x: noise.random(len(x)) * x.max())
    assert mean(labelled) < smoothed - 0.01


@pytest.mark.parametrize("html", ["<div>some text, {0}", "<b>x{0}</i>", "<ul><li>a", "<table><tr><td>a", "<i><div><b>x</i>", "<section><p>{0}"])
def test_deep_nesting_is_linear(html):
    started = time.process_time()
    assert main_text("".join(html.format(i) for i in range(20_000)) + f"<p>{P}</p>").endswith(P)
    assert time.process_time() - started < 10


def test_names_of_columns_to_keep(spark):
    df = spark.createDataFrame([(1, f"<p>{P}", "h")], "page_id long, body string, html string")
    assert extract_text(df, html_col="body", keep=("html",)).collect() == [(1, "h", P)]
    with pytest.raises(ValueError, match="columns"):
        extract_text(df.withColumnRenamed("html", "text"), html_col="body", keep=("text",))
