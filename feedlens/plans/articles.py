"""Queries of the article API: filters, ordering, paging, dedupe, set operations and projections."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlens.operators import paging, projections, ranges, snapshots
from feedlens.operators.filters import ArticleQuery, all_of, backlog, expired, holds, predicate, resolve_feed, search_predicate, source_health, wishlisted
from feedlens.plans.registry import query
from feedlens.sources.tables import role, table, with_roles

AS_OF = "2025-06-01 00:00:00"


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").withColumn("keywords", F.split("keywords", ","))


def _filtered(name: str, q: ArticleQuery, where: str) -> None:
    """Registers a query that applies one filter and returns ids and dates."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _articles(spark, sf).where(predicate(q)).select("id", F.col("pubDate").cast("string").alias("pub"))

    query(name, with_roles(f"SELECT id, CAST(pubDate AS VARCHAR) AS pub FROM articles WHERE {where}", "articles"))(run)


_filtered("FLT1_topic", ArticleQuery(topic="Banknotes"), "topic = 'Banknotes'")
_filtered("FLT2_feeds", ArticleQuery(feed_ids=(" src1 ", "src2", "src1", ""), feed_id="src9"), "feedId IN ('src1', 'src2')")
_filtered("FLT3_dates", ArticleQuery(date_from="2024-01-10", date_to="2024-03-01", since="2024-02-01"), "pubDate >= '2024-02-01' AND pubDate <= '2024-03-01'")
_filtered("FLT4_duplicates", ArticleQuery(exclude_duplicates=True, only_duplicates=True), "isDuplicate")
_filtered("FLT5_status", ArticleQuery(fetch_statuses=("pending", "failed")), "fetchStatus IN ('pending', 'failed')")
_search = " OR ".join(f"contains(lower(coalesce({c}, '')), '{{t}}')" for c in ("title", "source", "topic", "feedName", "link", "canonicalLink", "contentSnippet"))
_filtered("FLT7_search", ArticleQuery(search=" The  SRC1 "), f"({_search.format(t='the')}) AND ({_search.format(t='src1')})")
_filtered("FLT8_tag", ArticleQuery(tag="fr"), "list_contains(string_split(keywords, ','), 'fr')")
_filtered("FLT9_signals", ArticleQuery(signal_keywords=("identity", "site7.")), f"({_search.format(t='identity')}) OR ({_search.format(t='site7.')})")


@query("FLT6_wishlist_exists", with_roles("SELECT id FROM articles a WHERE EXISTS (SELECT 1 FROM bridge b JOIN items i ON i.id = b.wishlistItemId WHERE b.articleId = a.id AND b.confidence = 'strong' AND i.isActive AND i.workflowStatus <> 'Completed')", "articles", "bridge", "items"))
def flt6(spark: SparkSession, sf: str) -> DataFrame:
    return wishlisted(role(spark, sf, "articles"), role(spark, sf, "bridge"), role(spark, sf, "items")).select("id")


@query("FLT10_backlog", with_roles("SELECT id, fetchStatus FROM articles WHERE coalesce(thumbnail, '') = '' OR coalesce(summaryShort, '') = '' OR fetchStatus IN ('pending', 'partial')", "articles"))
def flt10(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").where(backlog()).select("id", "fetchStatus")


_PROFILED = "CASE WHEN n % 13 = 0 THEN 'researcher' ELSE 'border_control' END"
_EXPIRED = f"CASE WHEN feedId IN ('src0', 'src5') OR {_PROFILED} = 'researcher' THEN pubDate < CAST('{AS_OF}' AS timestamp) - INTERVAL 1095 DAY ELSE pubDate < CAST('{AS_OF}' AS timestamp) - INTERVAL 365 DAY END"


@query("FLT11_retention", with_roles(f"SELECT id FROM articles WHERE {_EXPIRED}", "articles"))
def flt11(spark: SparkSession, sf: str) -> DataFrame:
    rows = role(spark, sf, "articles").withColumn("profileSignals", F.array(F.expr(_PROFILED)))
    return rows.where(expired(AS_OF, ["src0", "src5"])).select("id")


@query("FLT12_feeds", with_roles("SELECT id, name FROM feeds WHERE isActive AND lastStatus = 'success' AND sourceType IN ('rss')", "feeds"))
def flt12(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "feeds").where("isActive and lastStatus = 'success' and sourceType in ('rss')").select("id", "name")


@query("FLT13_resolve_feed", with_roles("SELECT id, rssUrl FROM feeds WHERE lower(regexp_extract(rssUrl, '^[a-z]+://([^/]+)', 1)) = 'src12.example.com' ORDER BY createdAt DESC, id LIMIT 1", "feeds"))
def flt13(spark: SparkSession, sf: str) -> DataFrame:
    return resolve_feed(role(spark, sf, "feeds"), " SRC12.example.com ").select("id", "rssUrl")


@query("FLT14_day_window", with_roles("SELECT id FROM articles WHERE createdAt >= date_trunc('day', TIMESTAMP '2024-03-05 14:00:00') AND createdAt <= date_trunc('day', TIMESTAMP '2024-03-05 14:00:00') + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND", "articles"))
def flt14(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_trunc("day", F.lit("2024-03-05 14:00:00").cast("timestamp"))
    return role(spark, sf, "articles").where(F.col("createdAt").between(day, day + F.expr("interval 1 day - interval 1 millisecond"))).select("id")


@query(
    "FLT15_patterns",
    with_roles(
        "SELECT id FROM articles WHERE (title ILIKE 'th%' OR title ILIKE '%re') AND feedId IN ('src1', 'src2', 'src3') AND regexp_matches(link, 'news/[0-9]+') AND NOT regexp_matches(lower(title), '^the ') AND canonicalLink IS DISTINCT FROM ''",
        "articles",
    ),
)
def flt15(spark: SparkSession, sf: str) -> DataFrame:
    a = role(spark, sf, "articles")
    return a.where((F.col("title").ilike("th%") | F.col("title").ilike("%re")) & F.col("feedId").isin("src1", "src2", "src3") & F.col("link").rlike("news/[0-9]+") & ~F.lower("title").rlike("^the ") & ~F.col("canonicalLink").eqNullSafe("")).select("id")


@query("FLT16_source_health", with_roles("SELECT id, CASE WHEN NOT isActive THEN 'inactive' WHEN lastStatus = 'error' THEN 'error' WHEN lastStatus = 'success' THEN 'success' ELSE 'awaiting' END AS health FROM feeds", "feeds"))
def flt16(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "feeds").select("id", source_health().alias("health"))


@query("FLT17_client_filter", with_roles("SELECT id FROM articles WHERE topic = 'Banknotes' AND feedId = 'src4' AND pubDate >= '2024-01-05' AND contains(lower(title || ' ' || contentSnippet), 'the')", "articles"))
def flt17(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").where(predicate(ArticleQuery(topic="Banknotes", feed_id="src4", since="2024-01-05")) & holds(F.concat_ws(" ", "title", "contentSnippet"), "the")).select("id")


_SOURCES = "SELECT canonicalLink, id, title, source FROM articles WHERE canonicalLink <> ''"


@query(
    "FLT18_grouped_search",
    with_roles(f"SELECT canonicalLink, min(CAST(id AS BIGINT)) AS first_id, count(*) AS n_sources FROM ({_SOURCES}) WHERE contains(lower(title), 'on') GROUP BY canonicalLink", "articles"),
)
def flt18(spark: SparkSession, sf: str) -> DataFrame:
    grouped = role(spark, sf, "articles").where("canonicalLink != ''").groupBy("canonicalLink").agg(F.sort_array(F.collect_list(F.struct(F.col("id").cast("bigint").alias("id"), "title", "source"))).alias("sources"))
    kept = grouped.withColumn("hit", F.filter("sources", lambda s: F.contains(F.lower(s["title"]), F.lit("on")))).where(F.size("hit") > 0)
    return kept.select("canonicalLink", F.get("hit", F.lit(0))["id"].alias("first_id"), F.size("hit").cast("bigint").alias("n_sources"))


@query("FLT19_freshness", with_roles("SELECT id FROM articles WHERE pubDate IS NOT NULL AND pubDate >= CAST('2024-12-01' AS timestamp) - INTERVAL 90 DAY", "articles"))
def flt19(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").where(F.coalesce(F.col("pubDate") >= F.expr("timestamp'2024-12-01' - interval 90 days"), F.lit(False))).select("id")


KEY = "lower(coalesce(nullif(trim(canonicalLink), ''), nullif(trim(link), ''), id))"
NEWEST = "pubDate DESC, createdAt DESC, id ASC"
DEDUPED = f"SELECT * FROM (SELECT *, {KEY} AS canonicalKey, row_number() OVER (PARTITION BY {KEY} ORDER BY {NEWEST}) AS r FROM articles) WHERE r = 1"


_MATCHING = "SELECT * FROM articles WHERE contains(lower(coalesce(title, '')), 'de') OR contains(lower(coalesce(contentSnippet, '')), 'de')"
_CANDIDATES = f"SELECT *, count(*) OVER () >= 1500 AS truncated FROM ({_MATCHING} ORDER BY {NEWEST} LIMIT 1500)"
_RANKED = f"SELECT *, {KEY} AS canonicalKey, row_number() OVER (PARTITION BY {KEY} ORDER BY {NEWEST}) AS r FROM ({_CANDIDATES})"


@query("FLAGSHIP_canonical_page", with_roles(f"SELECT id, title, canonicalKey, CAST(pubDate AS VARCHAR) AS pub, count(*) OVER () AS total, truncated FROM ({_RANKED}) WHERE r = 1 ORDER BY {NEWEST} LIMIT 200", "articles"))
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    rows = paging.canonical_page(role(spark, sf, "articles"), search_predicate("de", ("title", "contentSnippet")), 1, 200)
    return rows.select("id", "title", "canonicalKey", F.col("pubDate").cast("string").alias("pub"), "total", "truncated")


@query("WIN1_canonical_dedupe", with_roles(f"SELECT id, canonicalKey FROM ({DEDUPED})", "articles"))
def win1(spark: SparkSession, sf: str) -> DataFrame:
    return paging.dedupe_canonical(role(spark, sf, "articles")).select("id", "canonicalKey")


@query(
    "WIN2_candidates",
    with_roles(
        f"SELECT id, (SELECT count(*) >= 150 FROM articles) AS truncated FROM (SELECT id, row_number() OVER (PARTITION BY {KEY} ORDER BY {NEWEST}) AS r FROM (SELECT * FROM articles ORDER BY {NEWEST} LIMIT 150)) WHERE r = 1",
        "articles",
    ),
)
def win2(spark: SparkSession, sf: str) -> DataFrame:
    return paging.candidates(role(spark, sf, "articles"), 150).select("id", "truncated")


@query("WIN3_page", with_roles(f"SELECT id FROM articles ORDER BY {NEWEST} LIMIT 50 OFFSET 50", "articles"))
def win3(spark: SparkSession, sf: str) -> DataFrame:
    return paging.page(role(spark, sf, "articles"), 2, 50).select("id")


@query(
    "WIN4_duplicate_groups",
    with_roles(
        "SELECT id, canonicalLink, primaryId, id <> primaryId AS isDuplicate FROM (SELECT a.id, canonicalLink, first_value(a.id) OVER (PARTITION BY canonicalLink ORDER BY createdAt, a.id) AS primaryId, count(*) OVER (PARTITION BY canonicalLink) AS size, bool_or(f.articleId IS NOT NULL) OVER (PARTITION BY canonicalLink) AS skipped FROM articles a LEFT JOIN (SELECT DISTINCT articleId FROM feedback) f ON f.articleId = a.id WHERE canonicalLink <> '') WHERE size > 1 AND NOT skipped",
        "articles",
        "feedback",
    ),
)
def win4(spark: SparkSession, sf: str) -> DataFrame:
    return paging.consolidation_plan(role(spark, sf, "articles"), role(spark, sf, "feedback").select(F.col("articleId").alias("id")))


@query("WIN5_latest", with_roles("SELECT id, feedId FROM poll_logs ORDER BY startedAt DESC, id DESC LIMIT 1", "poll_logs"))
def win5(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "poll_logs").orderBy(F.desc("startedAt"), F.desc("id")).limit(1).select("id", "feedId")


@query("WIN6_top_per_feed", with_roles("SELECT feedId, id, r FROM (SELECT feedId, id, row_number() OVER (PARTITION BY feedId ORDER BY textLength DESC, pubDate DESC, id) AS r FROM articles) WHERE r <= 3", "articles"))
def win6(spark: SparkSession, sf: str) -> DataFrame:
    best = Window.partitionBy("feedId").orderBy(F.desc("textLength"), F.desc("pubDate"), "id")
    return role(spark, sf, "articles").select("feedId", "id", F.row_number().over(best).cast("bigint").alias("r")).where("r <= 3")


@query("WIN7_nulls_last", with_roles("SELECT id, canonicalLink FROM articles ORDER BY canonicalLink DESC NULLS LAST, id LIMIT 40", "articles"))
def win7(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").orderBy(F.desc_nulls_last("canonicalLink"), "id").limit(40).select("id", "canonicalLink")


_SCORES = "SELECT id, k, (n * (k + 3)) % 17 AS score FROM articles, (SELECT unnest([0, 1, 2]) AS k)"


@query("WIN8_best_other", with_roles(f"SELECT s.id, s.k, s.score, max(o.score) AS best_other FROM ({_SCORES}) s JOIN ({_SCORES}) o ON o.id = s.id AND o.k <> s.k GROUP BY ALL", "articles"))
def win8(spark: SparkSession, sf: str) -> DataFrame:
    """The best score of the other members of a group, from the group's two best: no self join."""
    scores = role(spark, sf, "articles").select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(k.alias("k"), ((F.col("n") * (k + 3)) % 17).alias("score")))).alias("x")).select("id", "x.*")
    group = Window.partitionBy("id").orderBy(F.desc("score"), "k")
    whole = Window.partitionBy("id")
    ranked = scores.withColumn("r", F.row_number().over(group))
    top = ranked.withColumn("first", F.max(F.when(F.col("r") == 1, F.col("score"))).over(whole)).withColumn("second", F.max(F.when(F.col("r") == 2, F.col("score"))).over(whole))
    return top.select("id", "k", "score", F.when(F.col("r") == 1, F.col("second")).otherwise(F.col("first")).alias("best_other"))


@query("WIN9_neighbours", "SELECT conv_id, turn, lag(length(text)) OVER w AS before, lead(length(text)) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def win9(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    size = F.length("text").cast("bigint")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lag(size).over(w).alias("before"), F.lead(size).over(w).alias("after"))


@query("WIN10_running_cap", with_roles("SELECT id, running FROM (SELECT id, n, sum(CASE WHEN fetchStatus = 'enriched' THEN 1 ELSE 0 END) OVER (PARTITION BY feedId ORDER BY n ROWS UNBOUNDED PRECEDING)::BIGINT AS running, fetchStatus FROM articles) WHERE fetchStatus = 'enriched' AND running <= 5", "articles"))
def win10(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("feedId").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = F.when(F.col("fetchStatus") == "enriched", 1).otherwise(0)
    return role(spark, sf, "articles").select("id", "fetchStatus", F.sum(taken).over(w).alias("running")).where("fetchStatus = 'enriched' and running <= 5").select("id", "running")


_UNION = f"SELECT id, component, row_number() OVER (PARTITION BY {KEY} ORDER BY component, {NEWEST}) AS r FROM (SELECT *, 0 AS component FROM articles WHERE topic = 'Banknotes' UNION ALL SELECT *, 1 FROM articles WHERE contains(lower(title), 'de') UNION ALL SELECT *, 2 FROM articles WHERE contains(lower(title), 'on'))"


@query("SET1_composite", with_roles(f"SELECT id, component FROM ({_UNION}) WHERE r = 1", "articles"))
def set1(spark: SparkSession, sf: str) -> DataFrame:
    a = role(spark, sf, "articles")
    parts = [a.where("topic = 'Banknotes'"), a.where(holds(F.col("title"), "de")), a.where(holds(F.col("title"), "on"))]
    return paging.composite(parts).select("id", "component")


@query("SET2_append_page", with_roles("SELECT id FROM articles", "articles"))
def set2(spark: SparkSession, sf: str) -> DataFrame:
    a = role(spark, sf, "articles")
    return paging.append_page(a.where("n % 3 < 2"), a.where("n % 3 > 0")).select("id")


@query("SET3_pool_merge", with_roles("SELECT key, min(n) AS n FROM (SELECT CASE WHEN coalesce(canonicalLink, '') <> '' THEN 'canonical:' || canonicalLink ELSE 'id:' || id END AS key, n FROM articles) GROUP BY key", "articles"))
def set3(spark: SparkSession, sf: str) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("canonical:"), F.nullif(F.col("canonicalLink"), F.lit(""))), F.concat(F.lit("id:"), "id"))
    return role(spark, sf, "articles").groupBy(key.alias("key")).agg(F.min("n").alias("n"))


_BOUND = "greatest(20, (SELECT count(*) FROM articles) // 9)"
_HALVED = f""", bound AS (SELECT {_BOUND} AS b), days AS (SELECT CAST(pubDate AS DATE) AS d, count(*) AS c FROM articles WHERE pubDate IS NOT NULL GROUP BY 1),
sizes AS (SELECT a.lo, b.hi, (SELECT coalesce(sum(c), 0) FROM days WHERE d BETWEEN a.lo AND b.hi) AS n FROM
  (SELECT DATE '2024-01-01' + CAST(k AS INTEGER) AS lo FROM (SELECT unnest(range(0, 366)) AS k)) a, (SELECT DATE '2024-01-01' + CAST(k AS INTEGER) AS hi FROM (SELECT unnest(range(0, 366)) AS k)) b WHERE a.lo <= b.hi),
r AS (SELECT DATE '2024-01-01' AS lo, DATE '2024-12-31' AS hi
  UNION ALL SELECT CASE h WHEN 0 THEN r.lo ELSE r.lo + CAST((r.hi - r.lo) // 2 + 1 AS INTEGER) END, CASE h WHEN 0 THEN r.lo + CAST((r.hi - r.lo) // 2 AS INTEGER) ELSE r.hi END
  FROM r JOIN sizes s ON s.lo = r.lo AND s.hi = r.hi, bound, (SELECT unnest([0, 1]) AS h) WHERE s.n > b AND r.hi - r.lo > 7),
f AS (SELECT r.lo, r.hi, s.n, s.n > b AS over FROM r JOIN sizes s ON s.lo = r.lo AND s.hi = r.hi, bound WHERE NOT (s.n > b AND r.hi - r.lo > 7) AND s.n > 0),
k AS (SELECT f.*, row_number() OVER (PARTITION BY CASE WHEN coalesce(canonicalLink, '') <> '' THEN 'canonical:' || canonicalLink ELSE 'id:' || id END ORDER BY f.lo, {NEWEST}) AS r FROM articles a JOIN f ON CAST(a.pubDate AS DATE) BETWEEN f.lo AND f.hi)
SELECT strftime(lo, '%Y-%m-%d') AS first, strftime(hi, '%Y-%m-%d') AS last, any_value(n)::BIGINT AS n, bool_or(over) AS over, count(*) FILTER (WHERE r = 1) AS kept FROM k GROUP BY lo, hi"""


@query("SET4_date_ranges", with_roles(_HALVED, "articles").replace("WITH articles", "WITH RECURSIVE articles", 1))
def set4(spark: SparkSession, sf: str) -> DataFrame:
    """The ranges that a year is halved into so that none holds more than a ninth of all articles, and what each adds to the union."""
    a = role(spark, sf, "articles")
    bound = max(20, a.count() // 9)
    days = ranges.day_ranges(a, "pubDate", "2024-01-01", "2024-12-31", bound)
    sizes = days.groupBy("lo", "hi").agg(F.max("n").alias("n"), F.bool_or("over").alias("over"))
    kept = ranges.complete(a, "2024-01-01", "2024-12-31", bound).groupBy("lo", "hi").agg(F.count("*").alias("kept"))
    met = sizes.join(kept, ["lo", "hi"], "left")
    return met.select(F.col("lo").cast("string").alias("first"), F.col("hi").cast("string").alias("last"), "n", "over", F.coalesce("kept", F.lit(0)).alias("kept"))


@query("SET5_label_sets", with_roles("SELECT id, len(list_distinct(list_concat(k, ['en', 'vendors'])))::BIGINT AS n_union, len(list_filter(k, lambda x: x <> 'en'))::BIGINT AS n_except, list_has_any(k, ['fr', 'src1']) AS overlaps FROM (SELECT id, string_split(keywords, ',') AS k FROM articles)", "articles"))
def set5(spark: SparkSession, sf: str) -> DataFrame:
    k, extra = F.col("keywords"), F.array(F.lit("en"), F.lit("vendors"))
    return _articles(spark, sf).select(
        "id", F.size(F.array_union(k, extra)).cast("bigint").alias("n_union"), F.size(F.array_except(k, F.array(F.lit("en")))).cast("bigint").alias("n_except"), F.arrays_overlap(k, F.array(F.lit("fr"), F.lit("src1"))).alias("overlaps")
    )


@query("SET6_id_difference", with_roles("SELECT id FROM articles WHERE topic = 'Banknotes' EXCEPT ALL SELECT id FROM articles WHERE isDuplicate", "articles"))
def set6(spark: SparkSession, sf: str) -> DataFrame:
    a = role(spark, sf, "articles")
    return a.where("topic = 'Banknotes'").select("id").exceptAll(a.where("isDuplicate").select("id"))


_THUMB = "CASE WHEN thumbnail IS NULL OR thumbnail = '' OR contains(thumbnail, 'placeholder') THEN 'placeholder' ELSE thumbnail END"


_STORED = """SELECT *, CASE n % 3 WHEN 0 THEN array('banknotes') WHEN 1 THEN array('identity_documents', 'security_printing') END AS domains, CASE WHEN n % 4 < 2 THEN array('central_bank', 'passport_authority') ELSE array() END AS profileSignals,
  CASE WHEN n % 5 > 0 THEN array('passports') ELSE array() END AS classifications, CASE n % 2 WHEN 0 THEN array('central_bank', 'vendors') ELSE array('passport_authority', 'researcher') END AS affinities FROM {articles}"""
_DTO = f""", s AS ({_STORED.format(articles="articles").replace("array(", "list_value(").replace("list_value()", "[]::VARCHAR[]")}),
d AS (SELECT *, coalesce(domains, []) AS dom FROM s)
SELECT id, title, coalesce(nullif(canonicalLink, ''), link) AS url, {_THUMB} AS image, coalesce(nullif(topic, ''), 'General') AS topic, keywords AS tags,
  CASE WHEN n % 2 = 1 THEN 'source_not_affiliated' WHEN n % 4 >= 2 THEN 'article_signal_missing' WHEN NOT list_contains(dom, 'banknotes') THEN 'profile_domain_missing' ELSE 'source_affinity_and_article_evidence' END AS central_bank,
  CASE WHEN n % 2 = 0 THEN 'source_not_affiliated' WHEN n % 4 >= 2 THEN 'article_signal_missing' WHEN NOT list_contains(dom, 'identity_documents') THEN 'profile_domain_missing' ELSE 'source_affinity_and_article_evidence' END AS passport_authority,
  CASE WHEN n % 2 = 0 THEN 'source_not_affiliated' WHEN len(dom) = 0 OR n % 5 = 0 THEN 'article_industry_evidence_missing' ELSE 'source_affinity_and_industry_evidence' END AS researcher FROM d"""


@query("PRJ1_article_dto", with_roles(_DTO, "articles"))
def prj1(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(_STORED, articles=_articles(spark, sf))
    dto = projections.article_dto(rows, F.col("affinities"))
    why = lambda p: F.get(F.filter("profileDecisions", lambda d: d["profile"] == p), F.lit(0))["reason"].alias(p)
    return dto.select("id", "title", F.col("canonicalLink").alias("url"), F.col("thumbnail").alias("image"), "topic", F.array_join("tags", ",").alias("tags"), why("central_bank"), why("passport_authority"), why("researcher"))


@query("PRJ2_feed_dto", with_roles("SELECT f.id, f.name, coalesce(n.n_name, '') AS region FROM feeds f LEFT JOIN nation n ON 'src' || CAST(n.n_nationkey AS VARCHAR) = f.id", "feeds"))
def prj2(spark: SparkSession, sf: str) -> DataFrame:
    catalog = table(spark, sf, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("id"), "n_name")
    return role(spark, sf, "feeds").join(catalog, "id", "left").select("id", "name", F.coalesce("n_name", F.lit("")).alias("region"))


@query(
    "PRJ3_normalized_item",
    with_roles(
        r""", i AS (SELECT *, regexp_replace(link, '^(https?://)www\.', '\1') AS u, CASE WHEN n % 2 = 0 THEN source ELSE regexp_extract(link, '^https?://(www\.)?([^/?#:]+)', 2) END AS s,
  trim(regexp_replace(contentSnippet, '[\s\x{00A0}\x{FEFF}]+', ' ', 'g')) AS snip, CASE WHEN n % 3 = 0 THEN [source, 'banknotes'] ELSE [] END AS own FROM news),
b AS (SELECT *, lower(title || ' ' || snip || ' ' || link) AS x FROM i)
SELECT sha256(u) AS id, u AS canonical, s AS source, sha256(snip) AS snippet, left(coalesce(nullif(regexp_extract(snip, '^((?s:.*?)[.!?])(?:\s|$)', 1), ''), nullif(snip, ''), title), 220) AS summary,
  array_to_string(own, ',') AS tags, len(own) > 0 OR regexp_matches(x, '(^|[^a-z0-9])(banknotes?|currency note|polymer note|note series)([^a-z0-9]|$)') AS of_banknotes FROM b""",
        "news",
    ),
)
def prj3(spark: SparkSession, sf: str) -> DataFrame:
    """Items as article rows; every second names its source, every third has tags, which add a domain."""
    none = F.array().cast("array<string>")
    items = role(spark, sf, "news").withColumns({"description": F.col("contentSnippet"), "source": F.when(F.col("n") % 2 == 0, F.col("source")).otherwise(""), "tags": F.when(F.col("n") % 3 == 0, F.array("source", F.lit("banknotes"))).otherwise(none)})
    out = projections.article_rows(items.drop("contentSnippet"))
    known = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.concat(F.lit("src"), k.cast("string")))
    tags = F.when(F.size(F.array_intersect("keywords", known)) > 0, F.slice("keywords", 1, 2)).otherwise(none)
    return out.select("id", F.col("canonicalLink").alias("canonical"), "source", F.sha2("contentSnippet", 256).alias("snippet"), F.col("summaryShort").alias("summary"), F.array_join(tags, ",").alias("tags"), F.array_contains("domains", "banknotes").alias("of_banknotes"))


@query("PRJ4_feedback_export", with_roles("SELECT articleId, reason, 'exclude' AS expectedAction, row_number() OVER (ORDER BY createdAt, articleId, clientId) AS pos FROM feedback", "feedback"))
def prj4(spark: SparkSession, sf: str) -> DataFrame:
    rows = paging.numbered(role(spark, sf, "feedback"), F.to_date("createdAt"), "createdAt", "articleId", "clientId")
    return rows.select("articleId", "reason", F.lit("exclude").alias("expectedAction"), "pos")


@query("PRJ5_nested_matches", with_roles("SELECT a.id, coalesce(string_agg(b.wishlistItemId || ':' || i.workflowStatus, ',' ORDER BY b.wishlistItemId) FILTER (WHERE i.id IS NOT NULL), '') AS matches FROM articles a LEFT JOIN bridge b ON b.articleId = a.id LEFT JOIN items i ON i.id = b.wishlistItemId GROUP BY a.id", "articles", "bridge", "items"))
def prj5(spark: SparkSession, sf: str) -> DataFrame:
    held = role(spark, sf, "bridge").join(F.broadcast(role(spark, sf, "items").select(F.col("id").alias("wishlistItemId"), "workflowStatus")), "wishlistItemId")
    nested = held.groupBy(F.col("articleId").alias("id")).agg(F.sort_array(F.collect_list(F.struct("wishlistItemId", "workflowStatus"))).alias("m"))
    text = F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["wishlistItemId"], x["workflowStatus"])), ",")
    return role(spark, sf, "articles").select("id").join(nested, "id", "left").select("id", F.coalesce(text, F.lit("")).alias("matches"))


_REASON = "CASE WHEN contains(lower(title), 'job') THEN 'career' WHEN contains(lower(title), 'collector') THEN 'collector' WHEN contains(link, '/item/7') THEN 'product' ELSE 'keep' END"


@query("PRJ6_case_reasons", with_roles(f"SELECT id, {_REASON} AS reason FROM news", "news"))
def prj6(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "news").select("id", F.expr(_REASON).alias("reason"))


@query("PRJ7_catalog_defaults", "SELECT n_nationkey::BIGINT AS abbr, coalesce(nullif(n_name, ''), 'unknown') AS state, CASE WHEN n_regionkey = 1 THEN 'us' ELSE 'canada' END AS region, '' AS rssUrl FROM nation")
def prj7(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("abbr"), F.coalesce(F.nullif("n_name", F.lit("")), F.lit("unknown")).alias("state"), F.when(F.col("n_regionkey") == 1, "us").otherwise("canada").alias("region"), F.lit("").alias("rssUrl"))


@query("STR8_snapshot_page", with_roles(f"SELECT id, pos FROM (SELECT id, row_number() OVER (ORDER BY {NEWEST}) AS pos FROM articles WHERE topic = 'Banknotes') WHERE pos BETWEEN 11 AND 30", "articles"))
def str8(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.orderBy(*paging.newest_first())
    items = role(spark, sf, "articles").where(all_of([predicate(ArticleQuery(topic="Banknotes"))])).orderBy(*paging.newest_first()).limit(5000).withColumn("pos", F.row_number().over(order).cast("bigint"))
    return paging.snapshot_page(items, 11, 20).select("id", "pos")


@query("STR8_snapshot_store", with_roles(f"SELECT id, pos, total FROM (SELECT id, row_number() OVER (ORDER BY {NEWEST}) AS pos, least(count(*) OVER (), 5000) AS total FROM articles WHERE topic = 'Identity Documents') WHERE pos BETWEEN 21 AND 40", "articles"))
def str8_store(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of a snapshot that the first page's request made."""
    from feedlens.streaming.ingest import work_folder

    store = snapshots.SnapshotStore(spark, f"{work_folder(spark)}/snapshots")
    newest = lambda: role(spark, sf, "articles").where("topic = 'Identity Documents'").orderBy(*paging.newest_first()).limit(5000)
    first = store.serve("documents", newest, limit=20)
    page = store.serve("documents", None, first.id, 2, 20) if first.id else replace(first, rows=first.rows.limit(0))
    return page.rows.select("id", "pos", F.lit(page.total).cast("bigint").alias("total"))
