"""Pages and feeds: titles of anchors, reasons of page validation, images of a scrape, and the forms of feed items."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedlens.sources import feeds, html


def parse(spark, *pages):
    return html.parsed(spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id bigint, url string, html string"))


def test_anchor_titles_come_from_the_enclosing_blocks(spark):
    page = """<main><section><h2>Section head</h2><div><article><h3 class="x">Head &amp; one</h3><p>text <a href="/1">Read more</a></article>
      <ul><li><a href="2">Own text</a><li><span class="card-title">Card</span><a href="3">Card</a><h4>Later</h4></ul></div></section></main>
      <div><h2>Same</h2><a href="/4">same</a></div><p><h5>Before</h5><a href="/5"> more </a></p><a href="/6">learn more</a><a href="/7"><b>Al</b>one</a><script>"<a href='/no'>x</a>"</script>"""
    found = {r.link: r.label for r in html.anchors(parse(spark, ("https://a.com/x/y", page))).collect()}
    assert found == {
        "https://a.com/1": "Head & one", "https://a.com/x/2": "Section head", "https://a.com/x/3": "Section head", "https://a.com/4": "same", "https://a.com/5": "Before", "https://a.com/6": "Before", "https://a.com/7": "Alone",
    }


def test_references_without_a_semicolon_are_text(spark):
    page = """<!-- a&ampb <script> --><title>R&amp;D &#38; &lt;&amp&amp</title><script type="application/ld+json">{"x": "?a=1&amp=2"}</script><p>a &am b &copy c</p><a href="/q?x=1&lt=2&amp;y=3">Plain</a>"""
    row = parse(spark, ("https://a.com/x", page)).first()
    assert row.title == "R&D & <&amp&amp" and row.ld == ['{"x": "?a=1&amp=2"}']
    assert row.paragraphs[0].text.startswith("a &am b &copy c") and row.anchors[0].link == "https://a.com/q?x=1&lt=2&y=3"


def test_a_worker_holds_few_parsed_pages_at_a_time():
    pages = pa.RecordBatch.from_pylist([{"page_id": k, "url": None, "html": "<p>x</p>" * (100_000 if k in (3, 4) else 1)} for k in range(600)] + [{"page_id": None, "url": "https://a.com", "html": None}])
    found = list(html._parse(iter([pages])))
    assert [b.num_rows for b in found] == [4, 1, 256, 256, 84]
    assert [x for b in found for x in b.column(0).to_pylist()] == [*range(600), None]


def test_anchor_scores(spark):
    page = """<article><a href="/news/1">A headline of twenty-four characters</a></article><div role="main"><ul><li><a href="https://b.org/q">Short</a></li></ul></div>
      <a href="#top">Top</a><a href="javascript:x()">Run</a><a href="/about-us">We</a><a href="mailto:a@b.c">Mail</a><a href="">None</a><a href="/x"></a><a href="/i">Text with the Terms</a>"""
    rows = html.anchors(parse(spark, ("https://www.a.com/x", page))).orderBy("pos").collect()
    assert [r.score for r in rows] == [4 + 3 + 2 + 6 + 2, 3 + 3 + 1, -1, -1, -1, -1, -1, -1, -1]
    assert [r.link for r in html.listing(parse(spark, ("https://www.a.com/x", page)), least=1).orderBy("rank").collect()] == ["https://www.a.com/news/1", "https://b.org/q"]


LONG = "word " * 40
REASONS = [
    ("https://a.com/x", "Downloads", LONG, "", "blocked-title"), ("https://a.com/x", "", LONG, "", "blocked-title"), ("https://a.com/x", "Careers at our firm", LONG, "", "blocked-title"),
    ("https://a.com/x", "Careers of all the people who worked there", LONG, "", "accepted"), ("https://a.com/x", "Fine title", LONG, "<title>Login</title>", "blocked-page-title"),
    ("https://a.com/support/x", "Fine title", LONG, "", "blocked-url-without-date"), ("https://a.com/support/x", "Fine title", LONG, '<meta name="pubdate" content="2024-02-03">', "accepted"),
    ("https://a.com/x", "Fine title", "short", "", "missing-article-signals"), ("https://a.com/x", "Fine title", "short", '<body class="Press-area">', "accepted"),
    ("https://a.com/x", "Fine title", "short", '<nav class="breadcrumb">Home / Newsroom</nav>', "accepted"), ("https://a.com/x", "Fine title", "short", "<time>3 May 2024</time>", "accepted"),
    ("https://a.com/2024/5/3/x", "Fine title", "short", "", "accepted"), ("https://a.com/x", "Fine title", "short", '<script type="application/ld+json">{"a": 1}{"dateCreated": "2024-05-03"}</script>', "accepted"),
    ("https://a.com/product/x", "Fine title", LONG, "", "product-url"), ("https://a.com/product/x", "Fine title", LONG + "award", "", "accepted"),
    ("https://a.com/x", "Self-kiosks for all", LONG, "", "product-title"), ("https://a.com/x", "Our products", LONG, "", "product-title"),
    ("https://a.com/x", "Services and offerings", LONG, "", "marketing-page-without-article-signals"), ("https://a.com/x", "Services and offerings", LONG, "<time datetime='2024-05-03'></time>", "accepted"),
    ("https://regulaforensics.com/products/x", "Fine title", LONG, "<time datetime='2024-05-03'></time>", "regula-product-page"),
    ("https://www.veridos.com/portfolio/x", "Fine title", LONG, "<time datetime='2024-05-03'></time>", "veridos-marketing-page"),
    ("https://www.veridos.com/portfolio/x", "Case study", LONG, "<time datetime='2024-05-03'></time>", "accepted"),
]


def test_page_validation_reasons(spark):
    pages = parse(spark, *[(u, f"{head}<article><p>{body}</p></article>") for u, _, body, head, _ in REASONS])
    titles = spark.createDataFrame([(k, r[1]) for k, r in enumerate(REASONS)], "page_id bigint, said string")
    found = html.validated(pages.join(titles, "page_id"), F.col("said")).orderBy("page_id").collect()
    assert [(r.url, r.title, r.reason) for r, x in zip(found, REASONS, strict=True) if r.reason != x[4]] == []
    assert {x[4] for x in REASONS} >= {"blocked-title", "blocked-page-title", "blocked-url-without-date", "missing-article-signals", "product-url", "product-title", "marketing-page-without-article-signals"}
    assert all(r.accepted == (r.reason == "accepted") for r in found)


def test_bodies_and_snippets_by_place(spark):
    pages = parse(
        spark, ("https://a.com", f"<main><p>{LONG}<p>two</main><article><p>short</article>"), ("https://a.com", f'<div class="wide content"><p>{LONG}</p></div><main><p>other {LONG}</main>'),
        ("https://a.com", f"<article>{'<p>12 letters.</p>' * 14}</article>"), ("https://a.com", None), ("https://a.com", f"<article><p>We use cookie settings here and there, as all do.<p>{LONG}</article>"),
    )
    rows = pages.select("page_id", html.article_body().alias("b"), html._snippet().alias("s")).orderBy("page_id").collect()
    assert [len(r.b) for r in rows] == [203, 199, 12 * 12 - 1, 0, 249] and [len(r.s) for r in rows] == [199, 205, 0, 0, 199]


def test_metadata_images(spark):
    ld = '<script type="application/ld+json">{"@graph": [{"image": [{"url": "/uploads/g.jpg"}]}], "image": {"contentUrl": "https://a.com/img/logo.png"}}</script>'
    pages = parse(
        spark,
        ("https://a.com/harbour-bridge", '<link rel="canonical" href="/c"><meta property="og:image" content="/i/site-logo.png"><meta name="twitter:image" content="/i/bridge.jpg"><meta name="description" content=" D &amp; e ">'),
        ("https://a.com/x", ld), ("https://a.com/x", '<meta property="og:image" content="https://a.com/i/q"><article><img src="s.jpg" width="100"><img src="t.jpg" width="900px" height="10"><img data-src="u.jpg" width="900" height="500"></article>'),
        ("https://a.com/x", '<img src="a.jpg" width="200"><img src="favicon.png"><img src="b.jpg" height="90">'), ("https://a.com/x", '<img srcset="z.webp 2x, y.webp"><figure><img src="f.jpg"></figure>'), ("https://a.com/x", None),
        ("https://a.com/x", '<script type="application/ld+json">{"image": broken</script><img src="data:image/png;base64,x">'),
    )
    rows = html.metadata(pages).orderBy("page_id").collect()
    assert [(r.image, r.thumbnailSource, r.fetchStatus) for r in rows] == [
        ("https://a.com/i/bridge.jpg", "twitter-image", "enriched"), ("https://a.com/uploads/g.jpg", "schema-image", "enriched"), ("https://a.com/x/u.jpg".replace("/x/", "/"), "article-image", "enriched"),
        ("https://a.com/a.jpg", "article-image", "enriched"), ("https://a.com/f.jpg", "article-image", "enriched"), ("", "fallback", "partial"), ("", "fallback", "partial"),
    ]
    assert [r.rejectedReasons for r in rows] == [["og_image_generic"], [], ["metadata_not_article_specific", "width_too_small"], ["article_image_generic", "width_too_small", "height_too_small", "article_image_fallback_used"], [], [], []]
    assert rows[0].canonicalLink == "https://a.com/c" and rows[0].description == "D & e" and rows[5].language == "unknown"


def test_published_dates_by_order(spark):
    heads = ['<meta name="date" content="nonsense"><time datetime="2024-05-01T10:00:00+02:00">', '<time datetime="2024-05-01"><span class="news-date">2 May 2024</span>', '<span datetime="2024-05-04">x</span><time>May 3, 2024</time>', "<p>2024-05-05</p>", None]
    rows = parse(spark, *[("https://a.com/x", h) for h in heads]).select("page_id", F.date_format(html.published(F.col("url")), "yyyy-MM-dd HH").alias("d")).orderBy("page_id").collect()
    assert [r.d for r in rows] == ["2024-05-01 08", "2024-05-02 00", "2024-05-03 00", None, None]


RSS = """<rss xmlns:dc="d" xmlns:atom="a" xmlns:wp="w"><channel><title>t</title><item><title> A </title><guid isPermaLink="false">g1</guid><category>#tag</category><category domain="d">#tag</category><category>z</category>
<dc:subject>Sub &amp;amp; j</dc:subject><wp:term nicename="nice">Term</wp:term><source/><source url="u1">Desk &lt;b&gt;one&lt;/b&gt;</source></item><item><title>B</title><link> </link><atom:link href="al"/><pubDate>now</pubDate></item>
<item><link>https://www.google.com/url?url=https%3A%2F%2Fx.com</link><source><name>N</name><url>nu</url></source></item></channel></rss>"""
ATOM = """<feed xmlns="x"><title>f</title><entry><title type="html">At</title><link rel="self" href="s"/><link rel="alternate" href="alt"/><id>i1</id><category term="#T1" label="Label one"/><source><title>Src t</title></source>
<updated>2024</updated></entry><entry><link href="norel"/></entry><entry><link rel="enclosure" href="enc"/><id>i3</id></entry><entry><link rel="enclosure" href="enc"/></entry><entry/></feed>"""
RDF = '<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><item><title>R</title><link>rl</link><dc:date>2023</dc:date></item></rdf:RDF>'


def test_feed_items_of_all_forms(spark):
    docs = spark.createDataFrame([("a", RSS), ("b", ATOM), ("c", RDF), ("d", "<rss><channel>"), ("e", None), ("f", "")], "feedId string, xml string")
    rows = feeds.feed_items(docs).orderBy("feedId", "pos").collect()
    assert [(r.feedId, r.title, r.link, r.source, r.sourceUrl, r.tags, r.pubDate) for r in rows] == [
        ("a", "A", "g1", "Desk one", "u1", ["tag", "Sub & j", "Term", "nice"], None), ("a", "B", "al", "", "", [], "now"), ("a", "", "https://x.com", "N", "nu", [], None),
        ("b", "At", "alt", "Src t", "", ["T1", "Label one"], "2024"), ("b", "", "norel", "", "", [], None), ("b", "", "i3", "", "", [], None), ("b", "", "enc", "", "", [], None), ("b", "", "", "", "", [], None),
        ("c", "R", "rl", "", "", [], "2023"),
    ]


def test_documents_beyond_a_fetchers_limits(spark):
    rows = [("x" * 10, 200, None), ("x" * 11, 399, 5), ("x", 400, 0), ("x", None, 0), (None, 204, 0), ("x", 200, 6)]
    found = feeds.accepted(spark.createDataFrame(rows, "xml string, status int, redirects int"), most_bytes=10).collect()
    assert [r.refused for r in found] == ["", "too_large", "bad_status", "bad_status", "", "too_many_redirects"]


@pytest.mark.parametrize(("link", "whole"), [("", ""), ("data:x", ""), ("//b.c/d", "https://b.c/d"), ("/e", "https://a.com/e"), ("f.jpg", "https://a.com/x/f.jpg"), ("ftp://q", "ftp://q")])
def test_joined_url(spark, link, whole):
    assert spark.range(1).select(html.joined_url(F.lit("https://a.com/x/y?z=/q"), F.lit(link))).first()[0] == whole


def test_sheets(spark):
    import io
    import zipfile

    from feedlens.sources import sheets

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def book(rows: str, shared: str = "", name: str = "xl/worksheets/sheet1.xml") -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/worksheets/sheet10.xml", f"<worksheet {main}><row><c><v>no</v></c></row></worksheet>")
            z.writestr(name, f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
            if shared:
                z.writestr("xl/sharedStrings.xml", f"<sst {main}>{shared}</sst>")
        return out.getvalue()

    good = book('<row><c r="A1" t="s"><v>0</v></c><c r="AB1" t="inlineStr"><is><t>ti</t><t>tle </t></is></c></row><row><c r="B2"><v>7</v></c><c r="C2"/></row><row/><row><c r="A4"><v>1</v></c><c r="AB4" t="str"><v>x</v></c></row>', "<si><r><t>I</t></r><r><t>D</t></r></si>")
    files = spark.createDataFrame([("a", good), ("b", b"no zip"), ("c", None), ("d", book("<broken", name="xl/worksheets/sheet2.xml"))], "path string, content binary")
    rows = sheets.sheet_rows(files)
    assert [(r.path, r.row, r.cells) for r in rows.orderBy("row").collect()] == [("a", 0, ["ID", *[None] * 26, "title "]), ("a", 1, [None, "7"]), ("a", 2, []), ("a", 3, ["1", *[None] * 26, "x"])]
    assert [tuple(r) for r in sheets.headed(rows, ("id", "title", "other")).collect()] == [("a", 3, "1", "x", None)]
