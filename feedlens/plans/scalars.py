"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions import text as T
from feedlens.plans.registry import query
from feedlens.sources.tables import role, table, with_roles


def _news(spark: SparkSession, sf: str, **columns: Column) -> DataFrame:
    return role(spark, sf, "news").select("id", *[c.alias(k) for k, c in columns.items()])


@query("SCL1_normal_text", "SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace('  ' || text || chr(160), '^[\\s\\x{00A0}\\x{FEFF}]+', ''), '[\\s\\x{00A0}\\x{FEFF}]+$', ''), ''), 'none') AS t FROM documents")
def scl1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normal_text(F.concat(F.lit("  "), F.col("text"), F.lit(" ")), "none").alias("t"))


_ENT = "replace(replace(replace(replace(replace(replace({x}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' ')"


@query("SCL2_entities", with_roles("SELECT id, " + _ENT.format(x="'a &amp;lt; b &gt; ' || title || ' A'") + " AS t FROM news", "news"))
def scl2(spark: SparkSession, sf: str) -> DataFrame:
    return _news(spark, sf, t=T.named_entities(T.numeric_entities(F.concat(F.lit("a &amp;lt; b &gt; "), "title", F.lit(" &#65;")))))


@query("SCL3_strip_html", r"SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS t FROM pages")
def scl3(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.stripped_html(F.col("html")).alias("t"))


@query("SCL4_sanitize", r"SELECT page_id, trim(regexp_replace(" + _ENT.format(x="regexp_replace(html, '<[^>]+>', ' ', 'g')") + r", '[\s\x{00A0}\x{FEFF}]+', ' ', 'g')) AS t FROM pages")
def scl4(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.sanitized(F.col("html")).alias("t"))


_TITLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '^[^a-z0-9]+', ''), '^(breaking|watch|analysis|live|update):\s+', ''), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("SCL5_normal_title", with_roles(f"SELECT id, {_TITLE} AS t FROM news", "news"))
def scl5(spark: SparkSession, sf: str) -> DataFrame:
    return _news(spark, sf, t=T.normal_title(F.col("title")))


@query("SCL6_redirects", with_roles("SELECT id, CASE WHEN n % 3 = 2 THEN link ELSE link END AS t FROM news", "news"))
def scl6(spark: SparkSession, sf: str) -> DataFrame:
    coded = F.url_encode("link")
    wrapped = F.when(F.col("n") % 3 == 0, F.concat(F.lit("https://www.google.com/url?rct=j&url="), coded, F.lit("&ct=ga"))).when(F.col("n") % 3 == 1, F.concat(F.lit("https://www.bing.com/news/apiclick.aspx?url="), coded)).otherwise(F.col("link"))
    return _news(spark, sf, t=T.unwrapped_link(wrapped))


@query("SCL7_canonical_url", with_roles("SELECT id, 'https://site' || (n % 20) || '.example.com/news/' || (n % 700) || '?k=1&z=2' AS t FROM articles", "articles"))
def scl7(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").select("id", T.canonical_url(F.concat("link", F.lit("&k=1&utm_term=x&z=2#frag"))).alias("t"))


@query("SCL8_resolve_url", with_roles("SELECT id, 'https://' || source || '.example.com/a/' || id || '.html' AS t FROM news", "news"))
def scl8(spark: SparkSession, sf: str) -> DataFrame:
    return _news(spark, sf, t=T.resolved_url(F.col("link"), F.concat(F.lit("/a/"), "id", F.lit(".html"))))


_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query("SCL9_tokens", with_roles(f"SELECT id, array_to_string(list_filter(string_split({_TITLE}, ' '), lambda w: length(w) > 2 AND w NOT IN ({_STOPS})), ' ') AS t FROM news", "news"))
def scl9(spark: SparkSession, sf: str) -> DataFrame:
    return _news(spark, sf, t=F.array_join(T.tokens(F.col("title")), " "))


@query("SCL10_sha256", with_roles("SELECT id, sha256(coalesce(canonicalLink, '')) AS t FROM articles", "articles"))
def scl10(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").select("id", F.sha2(F.coalesce("canonicalLink", F.lit("")), 256).alias("t"))


@query("SCL12_summary", with_roles(r"SELECT id, left(coalesce(nullif(regexp_extract(trim(contentSnippet), '^((?s:.*?)[.!?])(?:\s|$)', 1), ''), trim(contentSnippet)), 220) AS t FROM articles", "articles"))
def scl12(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").select("id", T.summary_short(F.col("contentSnippet")).alias("t"))


@query("SCL13_terms", with_roles(r"SELECT id, regexp_matches(lower(title), '(^|[^a-z0-9])id card([^a-z0-9]|$)') AS exact, regexp_matches(lower(title), '(^|[^a-z0-9])visa[\s\-/&]+free([^a-z0-9]|$)') AS flexible, contains(lower(title), 'e system') AS part FROM news", "news"))
def scl13(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("title")
    return _news(spark, sf, exact=T.has_term(low, "ID card"), flexible=T.has_term(low, "visa free", flexible=True), part=F.contains(low, F.lit("e system")))


@query("SCL14_wish_text", with_roles("SELECT id, trim(regexp_replace(regexp_replace(strip_accents(lower(title)), '\\blicence\\b', 'license', 'g'), '[^a-z0-9]+', ' ', 'g')) AS t FROM articles", "articles"))
def scl14(spark: SparkSession, sf: str) -> DataFrame:
    plain = T.wish_text(F.col("title"))
    return role(spark, sf, "articles").select("id", plain.alias("t"))


@query("SCL15_passages", with_roles(r"SELECT id, len(list_filter(list_concat(regexp_split_to_array(title, '[.!?]+|\n+'), regexp_split_to_array(contentSnippet, '[.!?]+|\n+')), lambda x: trim(x) <> ''))::BIGINT AS n FROM articles", "articles"))
def scl15(spark: SparkSession, sf: str) -> DataFrame:
    found = F.filter(T.passages(F.col("title"), F.col("contentSnippet")), lambda x: F.trim(x) != "")
    return role(spark, sf, "articles").select("id", F.size(found).cast("bigint").alias("n"))


@query("SCL16_months", with_roles("SELECT id, month(pubDate)::BIGINT AS m, year(pubDate)::BIGINT AS y, month(pubDate) = 3 AND year(pubDate) = 2024 AS same FROM news", "news"))
def scl16(spark: SparkSession, sf: str) -> DataFrame:
    march = T.month_number(F.lit(" March "))
    return _news(spark, sf, m=F.month("pubDate").cast("bigint"), y=F.year("pubDate").cast("bigint"), same=(F.month("pubDate") == march) & (F.year("pubDate") == 2024))


@query("SCL17_host", with_roles("SELECT id, 'site' || (n % 20) || '.example.com' AS host FROM articles", "articles"))
def scl17(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").select("id", T.host_of(F.col("link")).alias("host"))


@query("SCL18_evidence_text", with_roles(r"SELECT id, regexp_replace(regexp_replace(lower(title || ' ' || feedName), '[-_]+', ' ', 'g'), '\s+', ' ', 'g') AS t FROM news", "news"))
def scl18(spark: SparkSession, sf: str) -> DataFrame:
    return _news(spark, sf, t=T.evidence_text(F.col("title"), F.col("feedName")))


@query("SCL20_sql_scalars", with_roles("SELECT id, left(title, 5) AS l, length(title)::BIGINT AS n, coalesce(nullif(canonicalLink, ''), 'none') AS c, lower(topic) AS t, concat_ws('|', source, topic) AS j, CAST(CAST(pubDate AS DATE) AS VARCHAR) AS d FROM articles", "articles"))
def scl20(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").select("id", F.left("title", F.lit(5)).alias("l"), F.length("title").cast("bigint").alias("n"), F.coalesce(F.nullif("canonicalLink", F.lit("")), F.lit("none")).alias("c"), F.lower("topic").alias("t"), F.concat_ws("|", "source", "topic").alias("j"), F.to_date("pubDate").cast("string").alias("d"))


@query("SCL21_thumbnails", with_roles("SELECT id, coalesce(regexp_matches(thumbnail, '^https?://') AND NOT regexp_matches(lower(thumbnail), 'placeholder|placehold\\.co|source-title-card'), false) AS presentable, coalesce(regexp_matches(lower(thumbnail), 'logo|favicon|sprite|default|avatar|icon[-_.]'), false) AS generic FROM articles", "articles"))
def scl21(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").select("id", T.presentable(F.col("thumbnail")).alias("presentable"), T.generic_image(F.col("thumbnail")).alias("generic"))


@query("SCL22_date_correction", with_roles("SELECT id, CAST(CASE WHEN n % 3 = 0 THEN pubDate - INTERVAL 30 HOUR ELSE pubDate END AS VARCHAR) AS d FROM articles", "articles"))
def scl22(spark: SparkSession, sf: str) -> DataFrame:
    claimed = F.when(F.col("n") % 3 == 0, F.col("pubDate") - F.expr("interval 30 hours")).otherwise(F.col("pubDate") - F.expr("interval 5 hours"))
    return role(spark, sf, "articles").select("id", T.corrected_date(F.col("pubDate"), claimed).cast("string").alias("d"))


@query(
    "SCL23_affinities",
    with_roles(
        "SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_concat(string_split(affinities, ','), CASE WHEN sourceGroup = 'vendors' THEN ['vendors', 'researcher'] WHEN sourceGroup = 'central_banks' THEN ['central_bank'] ELSE [] END), lambda x: x <> ''))), ',') AS t FROM feeds",
        "feeds",
    ),
)
def scl23(spark: SparkSession, sf: str) -> DataFrame:
    from feedlens.operators.rules import affinities

    return role(spark, sf, "feeds").select("id", F.array_join(F.array_sort(affinities(F.split("affinities", ","), F.col("sourceGroup"))), ",").alias("t"))
