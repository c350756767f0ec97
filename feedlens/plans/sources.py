"""Queries of the sources: stored pages, landed feeds, catalogs and scans."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.plans.registry import query
from feedlens.sources import feeds, html, sheets
from feedlens.sources.tables import role, table, with_roles


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return html.parsed(table(spark, sf, "pages"))


def _feed_number() -> Column:
    return F.regexp_extract("feedId", "([0-9]+)$", 1).cast("int")


def _landed(spark: SparkSession, sf: str) -> DataFrame:
    """Feed documents with a bounded number of items, built from the news as a fetcher lands them: feeds of even numbers are
    RSS, those of odd numbers Atom. Links, sources and tags come in the several forms that feeds use."""
    n, even = F.col("n"), F.col("n") % 2 == 0
    tag = lambda name, text, attrs="": F.concat(F.lit(f"<{name}{attrs}>"), text if not isinstance(text, str) else F.lit(text), F.lit(f"</{name}>"))
    none = F.lit("")
    desk = F.concat(F.lit("Desk "), "source")
    rss_source = F.when(even, tag("source", desk, ' url="https://desk.example/"')).when(n % 5 == 0, F.concat(F.lit("<source/>"), tag("source", tag("name", F.concat(F.lit("Late "), "source"))))).otherwise(none)
    rss = tag("item", F.concat(
        tag("title", F.col("title")), tag("link", F.when(n % 3 == 0, " ").otherwise(F.col("link"))), tag("guid", F.col("link"), ' isPermaLink="false"'), rss_source,
        tag("category", F.concat(F.lit("#"), "source")), tag("category", "x"), tag("category", "news", ' domain="d"'), F.when(n % 4 == 0, tag("dc:subject", "Paper &amp;amp; ink")).otherwise(none),
    ))
    href = lambda rel, at: F.concat(F.lit(f'<link rel="{rel}" href="'), at, F.lit('"/>'))
    atom = tag("entry", F.concat(
        tag("title", F.col("title"), ' type="html"'), href("self", F.concat(F.lit("https://self.example/"), "id")), F.when(n % 3 == 0, href("enclosure", F.col("link"))).otherwise(href("alternate", F.col("link"))),
        tag("id", F.concat(F.lit("urn:"), "id")), F.when(even, tag("source", tag("title", desk))).otherwise(none),
        F.concat(F.lit('<category term="#'), "source", F.lit('" label="News desk"/><category term="news"/>')),
    ))
    rows = role(spark, sf, "news").select("feedId", "n", F.floor(n / 2000).alias("block"), (_feed_number() % 2 == 1).alias("atom"), F.when(_feed_number() % 2 == 1, atom).otherwise(rss).alias("x"))
    docs = rows.groupBy("feedId", "block", "atom").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]), "").alias("items"))
    channel = tag("rss", tag("channel", F.concat(F.lit("<title>t</title>"), "items")), ' xmlns:dc="http://purl.org/dc/elements/1.1/"')
    return docs.select("feedId", F.when(F.col("atom"), tag("feed", F.concat(F.lit("<title>t</title>"), "items"), ' xmlns="http://www.w3.org/2005/Atom"')).otherwise(channel).alias("xml"))


#: The items of the landed documents as SQL: whether the feed is Atom, and the link that stands for the item.
_ITEMS = """, landed AS (SELECT *, CAST(regexp_extract(feedId, '([0-9]+)$', 1) AS INTEGER) % 2 = 1 AS atom FROM news),
items AS (SELECT *, CASE WHEN atom AND n % 3 = 0 THEN 'urn:' || id ELSE link END AS target,
  CASE WHEN atom THEN [source, 'News desk', 'news'] WHEN n % 4 = 0 THEN [source, 'news', 'Paper & ink'] ELSE [source, 'news'] END AS tags,
  CASE WHEN n % 2 = 0 THEN 'Desk ' || source WHEN NOT atom AND n % 5 = 0 THEN 'Late ' || source ELSE '' END AS desk,
  CASE WHEN n % 2 = 0 AND NOT atom THEN 'https://desk.example/' ELSE '' END AS deskUrl FROM landed)
"""


@query("SRC1_rss_items", with_roles(_ITEMS + "SELECT feedId, title, target AS link FROM items", "news"))
def src1(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.feed_items(_landed(spark, sf)).select("feedId", "title", "link")


@query(
    "SRC1_accepted_documents",
    with_roles(
        _ITEMS + """, docs AS (SELECT feedId, n // 2000 AS block, CAST(min(n) AS INTEGER) AS k FROM items GROUP BY ALL)
SELECT CASE WHEN k % 7 > 5 THEN 'too_many_redirects' WHEN k % 5 = 0 THEN 'bad_status' ELSE '' END AS refused, count(*) AS n, CAST(count(DISTINCT feedId) AS BIGINT) AS feeds FROM docs GROUP BY 1""",
        "news",
    ),
)
def src1_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by the fetcher's limits; statuses and redirects follow from the number of each document's first item."""
    items = _landed(spark, sf)
    first = F.regexp_extract("xml", r"(?:/item/|urn:)(\d+)", 1).cast("int")
    said = items.select("feedId", "xml", F.when(first % 5 == 0, F.when(first % 2 == 0, 404).otherwise(F.lit(None))).otherwise(200 + first % 200).alias("status"), F.when(first % 7 > 5, 6).otherwise(F.lit(None)).alias("redirects"))
    return feeds.accepted(said, most_bytes=1 << 40).groupBy("refused").agg(F.count("*").alias("n"), F.countDistinct("feedId").alias("feeds"))


@query("SRC2_repeated_fields", with_roles(_ITEMS + "SELECT feedId, count(*) AS n, sum(len(tags))::BIGINT AS tags FROM items GROUP BY feedId", "news"))
def src2(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.feed_items(_landed(spark, sf)).groupBy("feedId").agg(F.count("*").alias("n"), F.sum(F.size("tags")).alias("tags"))


@query("SRC3_item_link", with_roles(_ITEMS + "SELECT target AS link, atom, target LIKE 'urn:%' AS from_id FROM items", "news"))
def src3(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.feed_items(_landed(spark, sf)).select("link", (_feed_number() % 2 == 1).alias("atom"), F.startswith("link", F.lit("urn:")).alias("from_id"))


@query("SRC4_item_source", with_roles(_ITEMS + 'SELECT target AS link, desk AS source, deskUrl AS "sourceUrl" FROM items', "news"))
def src4(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.feed_items(_landed(spark, sf)).select("link", "source", "sourceUrl")


@query("SRC5_item_tags", with_roles(_ITEMS + "SELECT target AS link, array_to_string(tags, ',') AS tags FROM items", "news"))
def src5(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.feed_items(_landed(spark, sf)).select("link", F.array_join("tags", ",").alias("tags"))


#: The test pages read by patterns: anchors of the navigation, and the article's paragraphs, titles and language.
_LIKE = lambda column, parts: "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"
_ANCHORS = rf"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS raw,
  unnest(range(0, len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)))) AS pos FROM pages),
b AS (SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS label, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS link FROM a),
c AS (SELECT *, lower(href || ' ' || label) AS said FROM b),
scored AS (SELECT *, CASE WHEN label = '' OR href = '' OR {_LIKE("said", html.NAV_TOKENS)} THEN -1
  ELSE CASE WHEN length(label) >= 24 THEN 4 ELSE 0 END + CASE WHEN length(label) >= 48 THEN 2 ELSE 0 END + CASE WHEN link <> url THEN 3 ELSE 0 END + 2 + 1 + CASE WHEN {_LIKE("said", html.NEWS_TOKENS)} THEN 2 ELSE 0 END END AS score FROM c)
"""


@query("SRC6_listing", _ANCHORS + ", best AS (SELECT page_id, lower(link) AS link, max(score) AS score, min(pos) AS pos FROM scored WHERE score >= 4 GROUP BY page_id, link) SELECT page_id, least(count(*), 20)::BIGINT AS n, max(score)::INTEGER AS score, min(pos)::INTEGER AS first FROM best GROUP BY page_id")
def src6(spark: SparkSession, sf: str) -> DataFrame:
    return html.listing(_pages(spark, sf)).groupBy("page_id").agg(F.count("*").alias("n"), F.max("score").alias("score"), F.min("pos").alias("first"))


@query("SRC7_anchor_scores", _ANCHORS + "SELECT page_id, pos, link, score FROM scored")
def src7(spark: SparkSession, sf: str) -> DataFrame:
    return html.anchors(_pages(spark, sf)).select("page_id", "pos", "link", "score")


@query("SRC8_anchor_titles", _ANCHORS + "SELECT page_id, pos, label FROM scored")
def src8(spark: SparkSession, sf: str) -> DataFrame:
    return html.anchors(_pages(spark, sf)).select("page_id", "pos", "label")


_DECODED = lambda x: f"replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"
_BARE = lambda x: rf"trim(regexp_replace({_DECODED(f'regexp_replace({x}, ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}, '\s+', ' ', 'g'))"
_TITLES = "', '".join(html.NAV_TITLES)
_PARSED = f"""WITH t AS (SELECT page_id, url, regexp_extract(html, '<html lang=.([a-z]+)', 1) AS lang, {_BARE("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title,
  {_BARE("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS heading,
  list_transform(string_split(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<p>')[2:], lambda x: {_BARE("split_part(x, '</p>', 1)")}) AS paras FROM pages),
u AS (SELECT *, trim(array_to_string(paras[1:12], ' ')) AS raw_body, lower(url) AS low, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS name, trim(regexp_replace(lower(heading), '[^a-z0-9]+', ' ', 'g')) AS cand,
  array_to_string(list_filter(paras, lambda p: length(p) >= 35 AND NOT regexp_matches(lower(p), '{"|".join(html.BOILERPLATE)}'))[1:5], ' ') AS raw_snippet FROM t),
v AS (SELECT *, CASE WHEN length(raw_body) >= 140 THEN raw_body ELSE '' END AS body, CASE WHEN length(raw_snippet) >= 80 THEN raw_snippet ELSE '' END AS snippet FROM u),
w AS (SELECT *, {_LIKE("low", html.NEWS_CONTEXT)} AS room, lower(title || ' ' || url || ' ' || body) AS said FROM v),
x AS (SELECT *, room OR {_LIKE("low", html.NEWS_PATHS)} OR {_LIKE("said", html.NEWS_WORDS)} AS news FROM w)
"""
_NAV = lambda c: f"({c} = '' OR {c} IN ('{_TITLES}') OR " + " OR ".join(f"(starts_with({c}, '{p} ') AND length(trim({c}[{len(p) + 1}:])) BETWEEN 1 AND 24)" for p in html.NAV_TITLES) + ")"


@query(
    "SRC9_page_verdicts",
    _PARSED + f"""SELECT page_id, CASE WHEN {_NAV("cand")} THEN 'blocked-title' WHEN {_NAV("name")} THEN 'blocked-page-title' WHEN {_LIKE("low", html.NAV_PATHS)} THEN 'blocked-url-without-date'
  WHEN body = '' AND NOT room THEN 'missing-article-signals' WHEN {_LIKE("low", html.PRODUCT_PATHS)} AND NOT news THEN 'product-url' WHEN {_LIKE("name", html.PRODUCT_TITLES)} AND NOT news THEN 'product-title'
  WHEN ({_LIKE("name", html.MARKETING_TITLES)} OR {_LIKE("low", html.MARKETING_PATHS)}) AND NOT (body <> '' AND room) THEN 'marketing-page-without-article-signals' ELSE 'accepted' END AS reason FROM x""",
)
def src9(spark: SparkSession, sf: str) -> DataFrame:
    return html.validated(_pages(spark, sf), F.coalesce(F.get("headings", F.lit(0)), F.lit(""))).select("page_id", "reason")


@query("SRC10_text_dates", with_roles("SELECT id, strftime(pubDate, '%Y-%m-%d') AS day FROM articles", "articles"))
def src10(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("n") % 3 == 0, F.date_format("pubDate", "'on' d MMMM yyyy")).when(F.col("n") % 3 == 1, F.date_format("pubDate", "MMM d, yyyy 'at noon'")).otherwise(F.date_format("pubDate", "'am' d.M.yyyy"))
    return role(spark, sf, "articles").select("id", F.to_date(html.text_date(said)).cast("string").alias("day"))


@query("SRC11_page_titles", _PARSED + "SELECT page_id, title, lang, sha256(body) AS body, room AS newsroom, news FROM x")
def src11(spark: SparkSession, sf: str) -> DataFrame:
    """Title, language, body, whether the page stands in a newsroom, and whether anything says that it is news."""
    pages = _pages(spark, sf)
    body, room = html.article_body(), F.lit(False)
    for term in html.NEWS_CONTEXT:
        room = room | F.contains("context", F.lit(term))
    rows = pages.select("page_id", "url", "title", "lang", body.alias("body"), room.alias("newsroom"), html.published(F.col("url")).alias("published"))
    return rows.select("page_id", "title", "lang", F.sha2("body", 256).alias("body"), "newsroom", html.news_indicators("title", "url", "body", F.col("newsroom"), F.col("published")).alias("news"))


@query("SRC14_catalog", "SELECT n_nationkey::BIGINT AS id, upper(n_name) AS name FROM nation")
def src14(spark: SparkSession, sf: str) -> DataFrame:
    """A static catalog is a JSON array; here the nation table is written as one and parsed with an explicit schema."""
    text = table(spark, sf, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("j"))
    rows = text.select(F.explode(F.from_json(F.regexp_replace("j", "^\\x{FEFF}", ""), "array<struct<n_nationkey:bigint,n_name:string>>")).alias("x"))
    return rows.select(F.col("x.n_nationkey").alias("id"), F.upper("x.n_name").alias("name"))


def _workbooks(rows: DataFrame) -> DataFrame:
    """Rows (block, n, title) as workbooks, one a block: shared texts, a header row, and a column left empty, as an office writes them."""
    cell = lambda column, number, kind, value: f'<c r="{column}{number}"{kind}><v>{value}</v></c>'

    def written(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        texts, lines = [" Title ", "ID", *pdf.sort_values("n").title], ['<row r="1">' + cell("A", 1, ' t="s"', 1) + cell("C", 1, ' t="s"', 0) + "</row>"]
        lines += [f'<row r="{k + 2}">{cell("A", k + 2, "", n)}{cell("C", k + 2, chr(32) + "t=" + chr(34) + "s" + chr(34), k + 2)}</row>' for k, n in enumerate(sorted(pdf.n))]
        out, main = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>")
            z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(f'<si><t>{escape(t)}</t></si>' for t in texts)}</sst>")
        return pd.DataFrame({"path": [f"book{key[0]}.xlsx"], "content": [out.getvalue()]})

    return rows.groupBy("block").applyInPandas(written, "path string, content binary")


@query("SRC15_sheet_rows", "SELECT 'book' || (item_id // 25) || '.xlsx' AS path, CAST(item_id % 25 + 1 AS INTEGER) AS row, item_id AS id, trim(text) AS title FROM benchmark")
def src15(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of workbooks that hold the benchmark's items, twenty-five each."""
    rows = table(spark, sf, "benchmark").select(F.floor(F.col("item_id") / 25).alias("block"), F.col("item_id").alias("n"), F.col("text").alias("title"))
    found = sheets.headed(sheets.sheet_rows(_workbooks(rows)), ("id", "title"))
    return found.select("path", "row", F.col("id").cast("bigint").alias("id"), "title")


@query("SRC16_newest_scan", with_roles("SELECT id, title FROM articles ORDER BY createdAt DESC, id LIMIT 100", "articles"))
def src16(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").orderBy(F.desc("createdAt"), "id").limit(100).select("id", "title")


@query("SRC17_catalog_lookup", with_roles("SELECT f.id, (SELECT n.n_name FROM nation n WHERE f.name = 'Feed src' || n.n_nationkey OR f.rssUrl = 'https://src' || n.n_nationkey || '.example.com/rss' ORDER BY n.n_nationkey LIMIT 1) AS entry FROM feeds f", "feeds"))
def src17(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    c = table(spark, sf, "nation").select("n_nationkey", "n_name", F.explode(F.array(F.concat(F.lit("Feed src"), key), F.concat(F.lit("https://src"), key, F.lit(".example.com/rss")))).alias("k"))
    f = role(spark, sf, "feeds").select("id", F.explode(F.array("name", "rssUrl")).alias("k"))
    return f.join(F.broadcast(c), "k", "left").groupBy("id").agg(F.min_by("n_name", "n_nationkey").alias("entry"))


@query("SRC18_metadata", _PARSED + "SELECT page_id, lang AS language, 'fallback' AS thumbnail_source, '' AS reasons, CASE WHEN snippet <> '' THEN 'enriched' ELSE 'partial' END AS status, sha256(snippet) AS snippet FROM x")
def src18(spark: SparkSession, sf: str) -> DataFrame:
    rows = html.metadata(_pages(spark, sf))
    return rows.select("page_id", "language", F.col("thumbnailSource").alias("thumbnail_source"), F.array_join("rejectedReasons", ",").alias("reasons"), F.col("fetchStatus").alias("status"), F.sha2("snippet", 256).alias("snippet"))


@query("STR5_enrichment_queue", with_roles("SELECT id FROM articles WHERE fetchStatus IN ('pending', 'partial') ORDER BY createdAt, id LIMIT 150", "articles"))
def str5(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").where("fetchStatus in ('pending', 'partial')").dropDuplicates(["id"]).orderBy("createdAt", "id").limit(150).select("id")
