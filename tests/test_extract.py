"""Extraction against Python's own URL and HTML functions and hand-written pages."""

import html as stdlib_html
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagetrawl.functions import html as H
from pagetrawl.functions.text import decode_entities
from pagetrawl.functions.urls import domain_key, is_page_link, netloc, resolve_url
from pagetrawl.operators import extract as E

PAGE = "http://Host.example.com:80/a/b/c.html?x=1#top"


def rows(df):
    return [tuple(r) for r in df.collect()]


def extract(spark, html, url=PAGE, **options):
    raw = spark.createDataFrame([(url, html)], "url string, html string")
    return E.extract_pages(raw, **options).first()


def test_resolve_url_as_urljoin(spark):
    hrefs = [
        "https://other.org/x", "HTTP://other.org/X/../y", "//cdn.org/x?q#f", "/x", "/x//y", "x", "./x", "../x",
        "../../x", "../../../x", "..", ".", "../", "x/./y/../z", "?q=2", "?q=2#f", "#f", "#", "", "  /x  ", "/a\tb",
        "mailto:a@b.c", "javascript:void(0)", "data:text/plain,hi", "x;p=1", "/é", "x y", "a:b/c", "/..", "/../x/.",
    ]
    bases = [PAGE, "https://h.org", "https://h.org/", "https://u:p@h.org:8080/d/"]
    pairs = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(pairs, "base string, href string")
    got = rows(df.select("base", "href", resolve_url("base", "href")))
    expected = [(b, h, urljoin(b, h.strip(" "))) for b, h in pairs]
    assert [g for g, e in zip(got, expected) if g != e] == []


def test_decode_as_unescape(spark):
    texts = [
        "a &amp; b", "&amp;lt;", "&lt;p&gt;", "&#233;&#xE9;&#128512;", "&eacute;&nbsp;x", "&unknown; &amp", "&#0; &",
        "&#38;lt;", "&amp;#38;", "&quot;&apos;&copy;&middot;", "plain", "", "&#x41;&#X42;", "&hellip;&amp;hellip;",
    ]
    keep = {"&amp": "&amp", "&#0;": "&#0;"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows(df.select(decode_entities("t")))]

    def expected(t):
        for k in keep:
            if k in t and k + ";" not in t:
                t = t.replace(k, k.replace("&", "\x00"))
        return stdlib_html.unescape(t).replace("\x00", "&")

    assert got == [expected(t) for t in texts]


class Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.inside = [], False

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "body"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_content_as_html_parser(spark, sf):
    raw = spark.read.parquet(f"{sf}/pages.parquet")
    for html, content in rows(raw.select("html", H.extract_content("html"))):
        parser = Text()
        parser.feed(html)
        assert content == " ".join(" ".join(parser.parts).split())


@pytest.mark.parametrize("html, kept, dropped", [
    ("<body>a<script>var x;</script>b</body>", "a var x; b", "a b"),
    ("<body class='k'>a<!-- <b>no</b> -->b<style>p{}</style>", "a b p{}", "a b"),
    ("<title>t</title><p>no body", "no body", "no body"),
    ("<head><title>t</title></head><p>x  y&nbsp;z", "x y z", "x y z"),
    ("", "", ""),
])
def test_script_and_missing_body(spark, html, kept, dropped):
    assert extract(spark, html).content == kept
    assert extract(spark, html, drop_script_style=True).content == dropped


def test_title(spark):
    assert extract(spark, "<TITLE lang=x>\n A &amp; B </TITLE><title>no</title>").title == "A & B"
    assert extract(spark, "<title>   </title>").title == PAGE
    assert extract(spark, "<p>none").title == PAGE


def test_snippet(spark):
    meta = "<head><meta charset=u><META content=' d &amp; e ' NAME=description></head><body>x"
    assert extract(spark, meta).snippet == "d & e"
    assert extract(spark, "<meta name='description' content=''><body>x").snippet == "x"
    assert extract(spark, "<body>" + "é" * 160).snippet == "é" * 160
    assert extract(spark, "<body>" + "é" * 161).snippet == "é" * 160 + "..."


def test_links(spark):
    html = """<body><a href='x.PDF'>1</a><a class=k HREF="x.pdf">2</a><a href=/y>3</a><abbr href='/no'>
      <a name=n>4</a><!-- <a href='/no'> --><script>"<a href='/no'>"</script><a href="mailto:a@b">5</a>
      <a title="a > b" href='//o.org/z.png?k'>6</a><a href='/q?a=1&amp;b=2'>7</a><a href='/y'>8</a>"""
    home = "http://Host.example.com:80"
    assert extract(spark, html).links == [f"{home}/a/b/x.PDF", f"{home}/y", f"{home}/q?a=1&b=2"]
    many = "".join(f"<a href='/{i % 18}'>" for i in range(40))
    assert extract(spark, many).links == [f"{home}/{i}" for i in range(18)]
    assert extract(spark, many, max_links=15).links == [f"{home}/{i}" for i in range(15)]
    near = "<a href='//o.org/x'><a href='/x'><a href='http://HOST.example.com:80/y'><a href='http://Host.example.com:80.evil.org/'>"
    assert extract(spark, near, same_host=True).links == [f"{home}/x", "http://HOST.example.com:80/y"]


def test_images(spark):
    html = "<title> T </title><body><img alt=none><img src='spacer.png'><img src=x.GIF><img src='/tracking/p.png'>"
    html += "<img src='data:image/png;base64,x'><img src='1.png' alt=' A ' title=' N '><img src='2.png' alt=' A '>"
    html += "<img src='3.png'/>" + "".join(f"<img src='n{i}.png'>" for i in range(14))
    images = extract(spark, html).images
    assert [(i.url.rsplit("/")[-1], i.alt_text, i.title) for i in images[:3]] == [
        ("1.png", "A", "N"), ("2.png", "A", "A"), ("3.png", "", "T")]
    assert len(images) == 17 and all(i.source_url == PAGE for i in images)
    assert extract(spark, html, max_images=12).images == images[:12]
    assert extract(spark, "<img src='1.png'>").images[0].title == "Scraped Image"


def test_pages_full_of_traps(spark):
    home = "http://Host.example.com:80"
    long = extract(spark, "<body><a " + 'x="y" ' * 20_000 + "href=/z>far</a>")
    assert (long.links, long.content) == ([f"{home}/z"], "far")
    stray = extract(spark, '<body><a href=/x title=Bob"s>l</a>' + '<p class="x">y' * 3_000)
    assert (stray.links, stray.content) == ([f"{home}/x"], "l" + " y" * 3_000)
    quoted = '<body><img alt="Next > page" src="/a.jpg">text <a onclick="if(a>b)go()" title="href=/no" href=/yes>go</a>'
    found = extract(spark, quoted)
    assert (found.content, found.links, found.images[0].url) == ("text go", [f"{home}/yes"], f"{home}/a.jpg")
    hidden = "<!-- <title>old</title><body>no --><titlebar>x</titlebar><title>real</title><body>yes <!-- <p>no</p> -->"
    assert extract(spark, hidden)[1:3] == ("real", "yes")
    script = "<body><script>for(i=0;i<n;i++){x()} if(a>b)y();</script>t"
    assert extract(spark, script).content == "for(i=0;i<n;i++){x()} if(a>b)y(); t"
    assert extract(spark, script, drop_script_style=True).content == "t"
    assert extract(spark, "<body>a <b c <d>e</d> < f").content == "a e < f"


def test_links_and_lists(spark):
    lists = spark.createDataFrame([("s", " a ,, b,s , ")], "source_url string, links string")
    links = E.links_from_lists(lists)
    assert rows(links) == [("s", "a"), ("s", "b"), ("s", "s")]
    assert sorted(r.target_url for r in E.as_link_rows(links).collect()) == ["a", "b"]


def test_url_parts(spark):
    urls = ["http://User:p@Host:80/x", "no scheme", "http://[broken/", "https://a.b:80", "//h/x", "http:///x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in rows(df.select(netloc("url")))] == ["User:p@Host:80", None, None, "a.b:80", "h", None]
    assert df.select(domain_key(F.lit("a.b:80/c"))).first()[0] == "a_b_80_c"
    assert [r[0] for r in rows(df.select(is_page_link("url")))] == [True, False, True, True, False, True]


def test_text_stats(spark):
    df = spark.createDataFrame([("a", " x  yy\nz "), ("b", None), ("c", "")], "id string, content string")
    assert rows(E.text_stats(df)) == [("a", 9, 3), ("b", 0, 0), ("c", 0, 0)]


def test_a_tag_is_read_once_for_an_attribute(spark):
    """A long tag is scanned up to the value, and not at all for a name that is not in it."""
    tags = ["src=a", 'x="src=1" SRC = "b c" src=d', "src='q\"r'", 'src="open', "src", "src=", "data-src=x", "title", 'alt="src"  src=" "',
            'src=\n"l1\nl2"', "src==e", "/src=f", "", "src=&amp;x", "=src=g", None]
    df = spark.createDataFrame(list(enumerate(tags)), "n int, a string")
    found = [r.v for r in df.select("n", F.expr(H._attribute("a", "src")).alias("v")).orderBy("n").collect()]
    assert found == ["a", "b c", 'q"r', '"open', None, "", None, None, " ", "l1\nl2", "=e", "f", None, "&x", "g", None]
    assert H._attribute("a", "src").count("regexp_extract(a,") == 1 and "a RLIKE" not in H._attribute("a", "src")
