"""Selectors over nested and broken markup, against a tree walked in plain Python."""

import re
from html.parser import HTMLParser

import pytest

from lotwise.sources import selectors, structured

PAGES = {
    1: '<html lang="en"><body><div class="card big" id="x"><h2> A &amp; B </h2><a href="/a?b=1&amp;c=2">one <b>two</b></a></div><div class="card"><p>three</div></body></html>',
    2: "<ul><li>a<li>b <ul><li>c</ul><li>d</ul><p>x<p>y<div><p>z</div>",
    3: "<div class=card><a HREF=/x CLASS='l m'>t</a><br><img src=i.png><script>if (a < b) '<p>'</script><style>p{}</style></span></div></div>tail <em>e",
    4: "no markup at all", 5: "", 6: None, 7: "<a><b><c>deep</c></b></a><a>flat</a><!-- <a>comment</a> --><a/>", 8: '<table><tr><td>1<td>2<tr><td>3</table><input disabled value="v w">',
}


class Tree(HTMLParser):
    """An independent reading: nested lists [tag, attributes, children]."""

    void = "area base br col embed hr img input link meta source track wbr".split()

    def __init__(self, page):
        super().__init__()
        self.root = ["", {}, []]
        self.path = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "th", "option", "dt", "dd") and self.path[-1][0] == tag:
            self.path.pop()
        node = [tag, dict(attrs), []]
        self.path[-1][2].append(node)
        if tag not in self.void:
            self.path.append(node)

    def handle_endtag(self, tag):
        names = [n[0] for n in self.path]
        if tag in names:
            del self.path[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        if self.path[-1][0] not in ("script", "style"):
            self.path[-1][2].append(data)


def walk(node, above=()):
    for child in node[2]:
        if isinstance(child, list):
            yield child, (*above, node)
            yield from walk(child, (*above, node))


def text(node):
    return "".join(c if isinstance(c, str) else text(c) for c in node[2])


def has(node, tag=None, cls=None, attr=None):
    return (tag is None or node[0] == tag) and (cls is None or cls in (node[1].get("class") or "").split()) and (attr is None or attr in node[1])


CASES = {
    "p": lambda n, up: has(n, "p"),
    "div.card > a": lambda n, up: has(n, "a") and has(up[-1], "div", "card"),
    "ul li": lambda n, up: has(n, "li") and any(has(u, "ul") for u in up),
    "ul ul > li": lambda n, up: has(n, "li") and has(up[-1], "ul") and any(has(u, "ul") for u in up[:-1]),
    ".card": lambda n, up: has(n, cls="card"),
    "#x h2, em": lambda n, up: (has(n, "h2") and any(u[1].get("id") == "x" for u in up)) or has(n, "em"),
    "a[href^='/a']": lambda n, up: has(n, "a") and (n[1].get("href") or "").startswith("/a"),
    "a[href*=x].m": lambda n, up: has(n, "a", "m") and "x" in n[1].get("href", ""),
    "[disabled]": lambda n, up: has(n, attr="disabled"),
    'input[value~="w"]': lambda n, up: has(n, "input") and "w" in n[1].get("value", "").split(),
    "tr > td": lambda n, up: has(n, "td") and has(up[-1], "tr"),
    "a  b>c": lambda n, up: has(n, "c") and has(up[-1], "b") and any(has(u, "a") for u in up[:-1]),
    "*": lambda n, up: True,
}


def test_selectors_equal_a_walk(spark):
    pages = spark.createDataFrame(list(PAGES.items()), "page_id long, html string").repartition(3)
    mapping = spark.createDataFrame([(s, s, "text") for s in CASES] + [("hrefs", "a", "HREF"), ("hrefs", "img[src]", "src")], "field string, selector string, take string")
    got = {(r["page_id"], r["field"]): r["values"] for r in selectors.extract(pages, mapping).collect()}
    want = {}
    tidy = lambda s: re.sub("[ \t\n\x0b\f\r]+", " ", s or "").strip(" ")
    for page, html in PAGES.items():
        found = list(walk(Tree(html or "").root))
        for s, test in CASES.items():
            if values := [tidy(text(n)) for n, up in found if test(n, up) and tidy(text(n))]:
                want[page, s] = values
        if values := [v for n, _ in found if (v := tidy(n[1].get("href") if n[0] == "a" else n[1].get("src") if n[0] == "img" else ""))]:
            want[page, "hrefs"] = values
    assert got == want


def test_nothing_and_refusals(spark):
    pages = spark.createDataFrame(list(PAGES.items()), "page_id long, html string")
    none = spark.createDataFrame([], "field string, selector string, take string")
    assert selectors.extract(pages, none).collect() == []
    assert selectors.extract(pages.limit(0), spark.createDataFrame([("a", "a", "text")], none.schema)).collect() == []
    tree = selectors.nodes(pages)
    for bad in ("", "a >", "a:hover", "a[b", "a!b", "a[b|=c]"):
        with pytest.raises(ValueError, match="not a selector"):
            selectors.select(tree, bad)


def test_open_paragraphs_of_the_given_pages(spark):
    from lotwise.plans.pages import MAPPINGS

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    one = spark.createDataFrame([m for m in MAPPINGS if m[0] == "paragraphs"], "field string, selector string, take string")
    got = {r["page_id"]: r["values"] for r in selectors.extract(pages, one).collect()}
    for r in pages.collect():
        want = [" ".join(text(n).split()) for n, up in walk(Tree(r["html"]).root) if has(n, "footer") or (has(n, "p") and has(up[-1], "p") and any(has(u, "article") for u in up))]
        assert [" ".join(v.split()) for v in got.get(r["page_id"], [])] == [w for w in want if w]


LD = '<script type="application/ld+json">{}</script>'
#: (html, candidates as kind:listed:updated), for the page https://a.com/v/1 with VIN V1.
DATED = [
    (LD.format('{"@type":"Car","url":"https://a.com/v/1/","datePosted":" 2024-01-02 ","dateModified":"2024-02-03"}'), "proven:2024-01-02:2024-02-03"),
    (LD.format('{"@graph":[{"@type":["Thing","http://schema.org/Vehicle"],"vin":"v 1","offers":[{"@type":"Offer","datePublished":"2024-05-06"}]},{"@type":"Article","datePosted":"2020-01-01"}]}'), "proven:2024-05-06:"),
    (LD.format('{"@type":"WebPage","url":"/v/1#x","mainEntity":{"@type":"Product","dateCreated":"2023-01-01"}}'), "proven:2023-01-01:"),
    (LD.format('{"@type":"Product","datePosted":"2022-02-02"}'), "anonymous:2022-02-02:"),
    (LD.format('{"@type":"Product","sku":"other","datePosted":"2022-02-02"}') + LD.format("{oops"), "unmatched:2022-02-02:"),
    ('<div itemscope itemtype="https://schema.org/Car" itemid="https://a.com/v/1?q=1"><time itemprop="datePosted" datetime="2021-03-04">x</time><span itemprop="dateModified"> 2021-04-05 </span></div>', "proven:2021-03-04:2021-04-05"),
    ('<div itemscope itemtype="https://schema.org/Product"><meta itemprop="vin" content="V1"><br><div itemscope itemtype="https://schema.org/Offer" itemprop="offers"><meta itemprop="datePublished" content="2020-06-07"></div></div>', "proven:2020-06-07:"),
    ('<div itemscope itemtype="https://schema.org/WebPage" itemid="https://a.com/v/1"><div itemscope itemprop="mainEntity" itemtype="https://schema.org/Vehicle"><b itemprop="dateCreated">2019-01-01</b></div></div>', "proven:2019-01-01:"),
    ("<p>no data</p>", ""),
    (LD.format('[{"@type":"Car","identifier":{"value":["x",{"@id":"V 1"}]},"datePosted":5,"dateCreated":"2018-01-01"},[{"@type":"Offer"}]]'), "proven:2018-01-01:,anonymous::"),
    (LD.format('{"@type":"Vehicle","itemOffered":{"dateModified":"2","datePosted":" "},"offers":{"datePublished":"1","url":"https://b.com/"}}') + '<i itemscope itemtype="Car"></i>', "unmatched:1:2,anonymous::"),
    (LD.format('{"@type":"Car","url":"https://A.com/v/1?x=1"}'), "proven::"), ("", ""), (None, ""),
]


def test_dates_of_structured_data(spark):
    pages = spark.createDataFrame([(i, h, "https://a.com/v/1", "V1") for i, (h, _) in enumerate(DATED)], "id int, html string, url string, vin string").repartition(3)
    got = {}
    for r in sorted(structured.date_candidates(pages, "id", "vin").collect(), key=lambda r: (r["id"], r["candidate"])):
        got.setdefault(r["id"], []).append(f"{r['kind']}:{r['listed'] or ''}:{r['updated'] or ''}")
    assert {i: ",".join(x) for i, x in got.items()} == {i: w for i, (_, w) in enumerate(DATED) if w}


def test_only_the_references_asked_for_are_decoded(spark):
    page = '<title>A &amp; &quot;B&amp</title><a href="/x?a=1&copy=2&amp;b=3">l &lt c &#38; &amp;lt;</a><script type="application/json">{"a":"b&c"}</script><style>a&b</style>'
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    read = lambda *a: {(r["tag"], r["text"], r["attributes"].get("href")) for r in selectors.nodes(df, "page_id", "html", *a).collect()}
    assert {("#text", "A & &quot;B&amp", None), ("a", None, "/x?a=1&copy=2&b=3"), ("#text", "l &lt c &#38; &lt;", None), ("#data", '{"a":"b&c"}', None)} <= read(("amp",))
    assert {("#text", 'A & "B&', None), ("#text", "l < c & &lt;", None)} <= read()
