"""Operators on pages: URL verdicts and visible text."""

import re

import pytest

from orrery.llm import html_text, url_filter
from orrery.llm.html_text import visible_text

RULES = url_filter.RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_of(host, path):
    best = None
    for rule, verdict in RULES:
        name, _, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


URLS = [
    "https://A.Example.COM/en/712?x#y", "http://com/en/", "http://notcom/en/", "http://x.example.com/en", "https://b.net/de/8", "https://example.net/de/80", "ftp://é.ORG/es/Ü?q",
    "http://x.org", "http://x.org?en=/es/", "mailto:a@b.com", "", None, "://", "http://", "a://b://c/de/", "https://cheap-pills.net/fr/1", "https://cheappillsonline.net/fr/1", "http://" + "x" * 3000 + ".net/" + "9" * 3000,
]


@pytest.fixture(scope="module")
def pages(spark, sf):
    rows = [(i, u, None if i % 5 == 0 else f"<title>Cheap pills online {i}</title>", "k", 1) for i, u in enumerate([*URLS, *URLS])]
    odd = spark.createDataFrame(rows, "page_id bigint, url string, html string, key string, score int")
    return odd.unionByName(spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id + 1000 as page_id", "url", "html"), allowMissingColumns=True)


def test_hosts_paths_and_rules(pages):
    rows = url_filter.verdicts(pages).collect()
    urls = {r.page_id: r.url for r in pages.collect()}
    assert len(rows) == len(urls)
    for r in rows:
        host, path = parts(urls[r.page_id])
        best = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == (best[1] if best else "block" if r.block_score > 0 else "allow")


def test_verdicts_learn_from_rules(spark):
    good = [(i, f"http://news{i}.example.org/xx/{i}", None) for i in range(20)]
    train = [(100 + i, f"http://cheap-pills{i}.com/en/{i}", "<title>cheap pills and news</title>") for i in range(20)] + [(200 + i, f"http://news-{i}.net/de/{i}", None) for i in range(20)]
    asked = [(900, "http://cheappills.org/xx/", None), (901, "http://news.org/xx/", None), (902, None, None)]
    df = spark.createDataFrame(good + train + asked, "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.verdicts(df).collect()}
    assert got[900] == "block" and got[901] == "allow"
    assert url_filter.verdicts(df.where("page_id < 0")).count() == 0


def test_segment():
    cost = {w: 3.0 for w in ("cheap", "pills", "online", "on", "line")}
    assert url_filter.segment("cheappillsonline", cost, 1e4) == ["cheap", "pills", "online"]
    assert url_filter.segment("zzz", {}, 1e4) == ["zzz"]
    assert url_filter.segment("", {}, 1e4) == []
    assert "".join(url_filter.segment("x" * 500, {}, 1.0)) == "x" * 500


@pytest.mark.parametrize(
    "html,text",
    [
        (None, None),
        ("", ""),
        ("a<p>b<p>c", "a\n\nb\n\nc"),
        ("<title>t</title><h1>H &amp; h</h1>x<br>y", "H & h\n\nx\ny"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>", "- a\n- b\n  3. c\n  4. d\n- e"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td>日本<td>7</table>", "Name       Qty\napple pie  3\n日本       7"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide over both</table>z", "a  b\n   c\nwide over both\n\nz"),
        ("<table><tr><td>x<table><tr><td>in<td>ner</table><td>y</table>", "x        y\nin  ner"),
        ("<p>a<script>b</script><style>c</style><!-- d --><noscript>e</noscript><div hidden>f</div><span style='color:red;display : none'>g</span>h", "a\n\nh"),
        ("<pre>\n a\n  b</pre>", " a\n  b"),
        ("a <b> b </b> c", "a b c"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("<details><summary>s</summary>no</details><details open>yes</details>", "s\nyes"),
        ("<p>a</b></i>b<a href='>'>c</a>", "abc"),
        ("<p>in <textarea>\n a\n b</textarea><select><option>one<optgroup label=more><option selected>two</select>x", "in\n a\n b\none\nmore\ntwo\nx"),
        ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><text>lab<tspan>el</tspan></text><text>b</text></svg>c", "label\nb\nc"),
        ("a <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> b", "a x=1 b"),
        ("<input type=submit value=Go><input value='a b'><input type=hidden value=no><input type=password value=no><input placeholder=Name><input type=checkbox value=no>z", "Go a b Name z"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no<i style='display:block;visibility:visible'>too</i></div>", "yestoo"),
        ("<div style='display:none'>no<b style='visibility:visible;display:block'>no</b></div><div hidden style='display:block'>yes</div><p style='display:block;display:none'>no", "yes"),
        ("<p style='display:none !important; display:block'>no</p>yes<svg><foreignobject><desc>d</desc></foreignobject></svg>", "yesd"),
        ("&lt;b&gt; &eacute; &#x65e5; &nosuch;", "<b> é 日 &nosuch;"),
        ("<p title=\"a>b\">c", "c"),
    ],
)
def test_rendering(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "x", "<table>" * 3000 + "x", "<" * 50_000, "<li><ul>" * 5000 + "x", "<a b=\"" * 1000, "<p>" * 20_000 + "x", "<td colspan=99999 rowspan=99999>x" * 50, "<!--" * 1000, "</p>" * 1000])
def test_hostile_pages_end(html):
    assert isinstance(visible_text(html), str)


def test_no_visible_word_is_lost(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    texts = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>", "", r.html)
        from html import unescape

        assert unescape(re.sub(r"<[^>]*>", " ", body)).split() == re.sub(r"(?m)^ *- ", "", texts[r.page_id]).split()
    assert html_text.extract(pages.where("page_id < 0")).count() == 0
