"""Reports and joins over feeds, articles and poll logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions.text import STOP_WORDS, inferred_keywords
from feedlens.operators import reports
from feedlens.plans.registry import query
from feedlens.sources.tables import role, table, with_roles

AS_OF = "2024-12-31 00:00:00"


@query("JON1_feeds_left_articles", with_roles("SELECT f.id, count(a.id) AS n FROM feeds f LEFT JOIN articles a ON a.feedId = f.id GROUP BY f.id", "feeds", "articles"))
def jon1(spark: SparkSession, sf: str) -> DataFrame:
    counts = role(spark, sf, "articles").groupBy("feedId").agg(F.count("*").alias("n"))
    f = role(spark, sf, "feeds")
    return f.join(counts, f.id == counts.feedId, "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("JON2_feeds_logs", with_roles("SELECT f.name, count(*) AS n, sum(l.newArticles)::BIGINT AS new_articles FROM feeds f JOIN poll_logs l ON l.feedId = f.id GROUP BY f.name", "feeds", "poll_logs"))
def jon2(spark: SparkSession, sf: str) -> DataFrame:
    """Logs are counted per feed before the join, so the join moves one row a feed."""
    logs = role(spark, sf, "poll_logs").groupBy("feedId").agg(F.count("*").alias("n"), F.sum("newArticles").alias("new_articles"))
    return logs.join(role(spark, sf, "feeds").select(F.col("id").alias("feedId"), "name"), "feedId").select("name", "n", "new_articles")


@query("JON3_articles_feeds", with_roles("SELECT a.id, f.sourceGroup FROM articles a JOIN feeds f ON f.id = a.feedId WHERE f.sourceGroup = 'vendors' AND regexp_matches(lower(a.title), 'the|on')", "articles", "feeds"))
def jon3(spark: SparkSession, sf: str) -> DataFrame:
    vendors = role(spark, sf, "feeds").where("sourceGroup = 'vendors'").select(F.col("id").alias("feedId"), "sourceGroup")
    return role(spark, sf, "articles").where(F.lower("title").rlike("the|on")).join(vendors, "feedId").select("id", "sourceGroup")


@query("JON4_articles_left_feeds", with_roles("SELECT a.id, coalesce(f.name, 'unknown') AS feed FROM articles a LEFT JOIN feeds f ON f.id = a.feedId AND f.isActive", "articles", "feeds"))
def jon4(spark: SparkSession, sf: str) -> DataFrame:
    live = role(spark, sf, "feeds").where("isActive").select(F.col("id").alias("feedId"), "name")
    return role(spark, sf, "articles").join(live, "feedId", "left").select("id", F.coalesce("name", F.lit("unknown")).alias("feed"))


@query("JON5_feed_articles_logs", with_roles("SELECT f.id, (SELECT count(*) FROM articles a WHERE a.feedId = f.id) AS articles, (SELECT count(*) FROM poll_logs l WHERE l.feedId = f.id) AS logs FROM feeds f", "feeds", "articles", "poll_logs"))
def jon5(spark: SparkSession, sf: str) -> DataFrame:
    """Both children are counted first: a left chain of raw rows would multiply them."""
    a = role(spark, sf, "articles").groupBy(F.col("feedId").alias("id")).agg(F.count("*").alias("articles"))
    logs = role(spark, sf, "poll_logs").groupBy(F.col("feedId").alias("id")).agg(F.count("*").alias("logs"))
    return role(spark, sf, "feeds").select("id").join(a, "id", "left").join(logs, "id", "left").select("id", F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("logs", F.lit(0)).alias("logs"))


@query("JON6_one_row_tables", with_roles("SELECT l.feedId, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM poll_logs), 2) AS percent FROM poll_logs l WHERE l.startedAt < (SELECT max(startedAt) - INTERVAL 7 DAY FROM poll_logs) GROUP BY l.feedId", "poll_logs"))
def jon6(spark: SparkSession, sf: str) -> DataFrame:
    logs = role(spark, sf, "poll_logs")
    facts = F.broadcast(logs.agg(F.count("*").alias("total"), (F.max("startedAt") - F.expr("interval 7 days")).alias("cutoff")))
    old = logs.crossJoin(facts).where("startedAt < cutoff")
    return old.groupBy("feedId").agg(F.count("*").alias("n"), F.round(F.count("*") * 100.0 / F.first("total"), 2).alias("percent"))


@query("JON7_article_feed_map", with_roles("SELECT a.id, f.sourceType FROM articles a LEFT JOIN feeds f ON f.id = a.feedId", "articles", "feeds"))
def jon7(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").join(role(spark, sf, "feeds").select(F.col("id").alias("feedId"), "sourceType"), "feedId", "left").select("id", "sourceType")


@query("JON8_semi_anti", with_roles("SELECT id, EXISTS (SELECT 1 FROM feedback f WHERE f.articleId = a.id) AS reviewed FROM articles a WHERE NOT EXISTS (SELECT 1 FROM bridge b WHERE b.articleId = a.id AND b.confidence = 'strong')", "articles", "feedback", "bridge"))
def jon8(spark: SparkSession, sf: str) -> DataFrame:
    a = role(spark, sf, "articles").select("id").join(role(spark, sf, "bridge").where("confidence = 'strong'").select(F.col("articleId").alias("id")), "id", "left_anti")
    seen = role(spark, sf, "feedback").select(F.col("articleId").alias("id"), F.lit(True).alias("r")).distinct()
    return a.join(seen, "id", "left").select("id", F.coalesce("r", F.lit(False)).alias("reviewed"))


@query("JON11_set_difference", with_roles("SELECT a.id FROM articles a WHERE a.n % 2 = 0 AND NOT EXISTS (SELECT 1 FROM articles b WHERE b.n % 2 = 1 AND b.link = a.link) AND NOT EXISTS (SELECT 1 FROM articles b WHERE b.n % 2 = 1 AND b.canonicalLink = a.canonicalLink AND b.canonicalLink <> '')", "articles"))
def jon11(spark: SparkSession, sf: str) -> DataFrame:
    a = role(spark, sf, "articles")
    left, right = a.where("n % 2 = 0"), a.where("n % 2 = 1")
    return left.join(right.select("link"), "link", "left_anti").join(right.where("canonicalLink != ''").select("canonicalLink"), "canonicalLink", "left_anti").select("id")


@query("JON12_first_rule", with_roles("SELECT id, CASE WHEN contains(k, 'src1') THEN 'r1' WHEN contains(k, 'feed src2') THEN 'r2' WHEN contains(k, 'example') THEN 'r3' END AS rule FROM (SELECT id, lower(name || ' ' || rssUrl) AS k FROM feeds)", "feeds"))
def jon12(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([(1, "r1", "src1"), (2, "r2", "feed src2"), (3, "r3", "example")], "rule_no int, rule string, sourceKey string")
    f = role(spark, sf, "feeds").withColumn("k", F.lower(F.concat_ws(" ", "name", "rssUrl")))
    return f.join(F.broadcast(rules), F.contains("k", "sourceKey"), "left").groupBy("id").agg(F.min_by("rule", "rule_no").alias("rule"))


@query("AGG1_count", with_roles("SELECT count(*) AS n FROM articles", "articles"))
def agg1(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").agg(F.count("*").alias("n"))


@query("AGG2_per_feed", with_roles("SELECT f.id, count(a.id) AS n, CAST(min(a.pubDate) AS VARCHAR) AS first_pub, CAST(max(a.createdAt) AS VARCHAR) AS last_created FROM feeds f LEFT JOIN articles a ON a.feedId = f.id GROUP BY f.id", "feeds", "articles"))
def agg2(spark: SparkSession, sf: str) -> DataFrame:
    a = role(spark, sf, "articles").groupBy(F.col("feedId").alias("id")).agg(F.count("*").alias("n"), F.min("pubDate").cast("string").alias("first_pub"), F.max("createdAt").cast("string").alias("last_created"))
    return role(spark, sf, "feeds").select("id").join(a, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), "first_pub", "last_created")


@query("AGG3_duplicate_links", with_roles("SELECT coalesce(canonicalLink, link) AS url, count(*) AS n FROM articles GROUP BY url HAVING count(*) > 1", "articles"))
def agg3(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").groupBy(F.coalesce("canonicalLink", "link").alias("url")).agg(F.count("*").alias("n")).where("n > 1")


@query("AGG4_by_flag", with_roles("SELECT isDuplicate, count(*) AS n FROM articles GROUP BY isDuplicate", "articles"))
def agg4(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").groupBy("isDuplicate").agg(F.count("*").alias("n"))


_AGES = ", ".join(f"count(*) FILTER (WHERE pubDate < CAST('{AS_OF}' AS timestamp) - INTERVAL {d} DAY) AS older_{d}" for d in (30, 60, 90))


@query("AGG5_ages_by_status", with_roles(f"SELECT fetchStatus, {_AGES} FROM articles GROUP BY fetchStatus", "articles"))
def agg5(spark: SparkSession, sf: str) -> DataFrame:
    return reports.ages(role(spark, sf, "articles"), "pubDate", AS_OF, (30, 60, 90), ["fetchStatus"])


_WINDOWS = ", ".join(f"count(*) FILTER (WHERE pubDate < CAST('{AS_OF}' AS timestamp) - INTERVAL {d} DAY) AS older_{d}" for d in (7, 14, 180, 365))


@query("AGG6_dynamic_windows", with_roles(f"SELECT {_WINDOWS} FROM articles", "articles"))
def agg6(spark: SparkSession, sf: str) -> DataFrame:
    return reports.ages(role(spark, sf, "articles"), "pubDate", AS_OF, (7, 14, 180, 365))


@query("AGG7_lengths", with_roles("SELECT topic, round(avg(length(coalesce(title, ''))), 4) AS avg_title, max(length(coalesce(contentSnippet, '')))::BIGINT AS max_snippet FROM articles GROUP BY topic ORDER BY avg(length(coalesce(title, ''))) + avg(length(coalesce(contentSnippet, ''))) DESC", "articles"))
def agg7(spark: SparkSession, sf: str) -> DataFrame:
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    g = role(spark, sf, "articles").groupBy("topic").agg(F.avg(size("title")).alias("t"), F.avg(size("contentSnippet")).alias("s"), F.max(size("contentSnippet")).cast("bigint").alias("max_snippet"))
    return g.orderBy(F.desc(F.col("t") + F.col("s"))).select("topic", F.round("t", 4).alias("avg_title"), "max_snippet")


@query("AGG8_rows_per_day", with_roles("SELECT CAST(CAST(startedAt AS DATE) AS VARCHAR) AS day, count(*) AS n FROM poll_logs GROUP BY day ORDER BY day DESC LIMIT 30", "poll_logs"))
def agg8(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "poll_logs").groupBy(F.to_date("startedAt").cast("string").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(30)


#: Messages as a feed's errors say them: long, alike at their beginning, and different after it.
_SAID = "repeat('Connection to ' || feedId || ' failed. ', 4) || errorMessage"


@query(
    "AGG9_repeated_logs",
    with_roles(f"SELECT feedId, status, left({_SAID}, 120) AS error, count(*) AS n, CAST(min(startedAt) AS DATE)::VARCHAR AS first_seen, CAST(max(startedAt) AS DATE)::VARCHAR AS last_seen FROM poll_logs GROUP BY feedId, status, left({_SAID}, 120) HAVING count(*) > 1", "poll_logs"),
)
def agg9(spark: SparkSession, sf: str) -> DataFrame:
    g = role(spark, sf, "poll_logs").groupBy("feedId", "status", F.left(F.expr(_SAID), F.lit(120)).alias("error"))
    return g.agg(F.count("*").alias("n"), F.to_date(F.min("startedAt")).cast("string").alias("first_seen"), F.to_date(F.max("startedAt")).cast("string").alias("last_seen")).where("n > 1")


@query("AGG10_top_feeds", with_roles("SELECT feedId, count(*) AS n FROM poll_logs GROUP BY feedId ORDER BY n DESC, feedId LIMIT 10", "poll_logs"))
def agg10(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "poll_logs").groupBy("feedId").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feedId").limit(10)


@query("AGG11_column_sizes", with_roles(" UNION ALL ".join(f"SELECT '{c}' AS name, round(avg(strlen(coalesce({c}, ''))), 4) AS average, max(strlen(coalesce({c}, '')))::BIGINT AS largest FROM articles" for c in ("title", "contentSnippet", "link")), "articles"))
def agg11(spark: SparkSession, sf: str) -> DataFrame:
    return reports.column_sizes(role(spark, sf, "articles"), ["title", "contentSnippet", "link"])


@query("AGG12_percent", with_roles("SELECT status, count(*) AS n, CASE WHEN (SELECT count(*) FROM poll_logs) > 0 THEN round(100.0 * count(*) / (SELECT count(*) FROM poll_logs), 2) ELSE 0 END AS percent FROM poll_logs GROUP BY status", "poll_logs"))
def agg12(spark: SparkSession, sf: str) -> DataFrame:
    return reports.shares(role(spark, sf, "poll_logs"), "status")


@query("AGG13_bytes", with_roles("SELECT coalesce(sum(strlen(errorMessage)), 0)::BIGINT AS bytes FROM poll_logs", "poll_logs"))
def agg13(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "poll_logs").agg(F.coalesce(F.sum(F.octet_length("errorMessage")), F.lit(0)).alias("bytes"))


@query("AGG14_topics", with_roles("SELECT DISTINCT topic FROM articles WHERE topic <> '' ORDER BY topic", "articles"))
def agg14(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").where("topic != ''").select("topic").distinct().orderBy("topic")


@query(
    "AGG15_dashboard",
    with_roles(
        """SELECT (SELECT count(*) FROM feeds) AS total_feeds, (SELECT count(*) FROM feeds WHERE isActive) AS active_feeds,
(SELECT count(*) FROM feeds WHERE lastStatus = 'error' AND isActive) AS failed_feeds, (SELECT count(DISTINCT topic) FROM articles WHERE topic <> '') AS topics,
(SELECT count(*) FROM articles WHERE pubDate >= TIMESTAMP '2024-12-30 00:00:00') AS articles_today, 0 AS active_clusters,
(SELECT count(*) FROM articles WHERE isDuplicate) AS duplicates_hidden, (SELECT strftime(max(startedAt), '%Y-%m-%d %H:%M:%S') FROM poll_logs) AS latest_poll_at""",
        "articles",
        "feeds",
        "poll_logs",
    ),
)
def agg15(spark: SparkSession, sf: str) -> DataFrame:
    """One pass over each table; the day is the last one of the test articles."""
    today = F.lit("2024-12-30 00:00:00").cast("timestamp")
    a = role(spark, sf, "articles").agg(F.count_distinct(F.nullif("topic", F.lit(""))).alias("topics"), F.count_if(F.col("pubDate") >= today).alias("articles_today"), F.count_if("isDuplicate").alias("duplicates_hidden"))
    f = role(spark, sf, "feeds").agg(F.count("*").alias("total_feeds"), F.count_if("isActive").alias("active_feeds"), F.count_if((F.col("lastStatus") == "error") & F.col("isActive")).alias("failed_feeds"))
    polled = role(spark, sf, "poll_logs").agg(F.date_format(F.max("startedAt"), "yyyy-MM-dd HH:mm:ss").alias("latest_poll_at"))
    return a.crossJoin(F.broadcast(f)).crossJoin(F.broadcast(polled)).withColumn("active_clusters", F.lit(0))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(lower({x}), '^[^a-z0-9]+', ''), '^(breaking|watch|analysis|live|update):\s+', ''), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND w NOT IN (" + _STOP + "))"


@query(
    "AGG16_trends",
    with_roles(
        """, newest AS (SELECT * FROM articles WHERE pubDate >= TIMESTAMP '2024-12-01' ORDER BY pubDate DESC, createdAt DESC, id LIMIT 400),
t AS (SELECT id, """
        + _TOKENS.format(x="concat_ws(' ', title, contentSnippet, topic)")
        + """ AS w FROM newest), u AS (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM t),
five AS (SELECT id, w FROM (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(p)) AS r FROM u GROUP BY id, w) WHERE r <= 5),
labels AS (SELECT id, lower(trim(w)) AS key FROM five UNION SELECT id, lower(trim(topic)) FROM newest)
SELECT '30d-' || regexp_replace(key, '\\s+', '-', 'g') AS id, key, count(*) AS n, count(DISTINCT source) AS sources, string_agg(l.id, ',' ORDER BY l.id) AS ids, count(*) * 1 + 0.5 * count(DISTINCT source) AS score
FROM labels l JOIN newest USING (id) WHERE length(key) >= 4 AND key NOT IN ('news', 'alert', 'alerts', 'world', 'tech', 'report', 'update', 'company', 'industry', 'article', 'monitoring') GROUP BY key ORDER BY score DESC, key LIMIT 12""",
        "articles",
    ),
)
def agg16(spark: SparkSession, sf: str) -> DataFrame:
    return reports.trends(role(spark, sf, "articles"), "30d", 30, "2024-12-01")


@query("AGG17_retention_counts", with_roles(f"SELECT count(*) FILTER (WHERE feedId NOT IN ('src0', 'src5') AND pubDate < CAST('{AS_OF}' AS timestamp) - INTERVAL 180 DAY) AS standard, count(*) FILTER (WHERE feedId IN ('src0', 'src5') AND pubDate < CAST('{AS_OF}' AS timestamp) - INTERVAL 300 DAY) AS extended FROM articles", "articles"))
def agg17(spark: SparkSession, sf: str) -> DataFrame:
    return reports.retention_counts(role(spark, sf, "articles"), AS_OF, ["src0", "src5"], 180, 300)


_REASON = "CASE WHEN contains(lower(title), 'job') THEN 'career' WHEN contains(lower(title), 'collector') THEN 'collector' ELSE 'keep' END"


@query("AGG18_reason_counts", with_roles(f"SELECT {_REASON} AS reason, count(*) AS n FROM news GROUP BY reason", "news"))
def agg18(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "news").groupBy(F.expr(_REASON).alias("reason")).agg(F.count("*").alias("n"))


@query("AGG19_reasons_by_domain", with_roles("SELECT source AS domain, reason, count(*) AS n FROM (SELECT source, unnest(list_filter([CASE WHEN thumbnail IS NULL THEN 'missing' END, CASE WHEN thumbnail = '' THEN 'empty' END, CASE WHEN contains(coalesce(thumbnail, ''), 'logo') THEN 'generic' END], lambda x: x IS NOT NULL)) AS reason FROM articles) GROUP BY ALL ORDER BY n DESC, domain, reason LIMIT 20", "articles"))
def agg19(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("thumbnail")
    reasons = F.array_compact(F.array(F.when(t.isNull(), "missing"), F.when(t == "", "empty"), F.when(F.contains(F.coalesce(t, F.lit("")), F.lit("logo")), "generic")))
    return role(spark, sf, "articles").select(F.col("source").alias("domain"), F.explode(reasons).alias("reason")).groupBy("domain", "reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain", "reason").limit(20)


@query(
    "AGG20_vendor_activity",
    with_roles(
        f""", g AS (SELECT feedId, max(pubDate) AS last, count(*) FILTER (WHERE pubDate >= CAST('{AS_OF}' AS timestamp) - INTERVAL 365 DAY) AS year,
count(*) FILTER (WHERE pubDate >= CAST('{AS_OF}' AS timestamp) - INTERVAL 730 DAY) AS two_years, CAST(least(6, ceil(count(*) / 10)) AS BIGINT) AS archive_depth FROM articles GROUP BY feedId)
SELECT feedId, CAST(last AS VARCHAR) AS latest, year, two_years, archive_depth,
CASE WHEN last >= CAST('{AS_OF}' AS timestamp) - INTERVAL 30 DAY THEN 40 WHEN last >= CAST('{AS_OF}' AS timestamp) - INTERVAL 90 DAY THEN 28 WHEN last >= CAST('{AS_OF}' AS timestamp) - INTERVAL 180 DAY THEN 18 WHEN last >= CAST('{AS_OF}' AS timestamp) - INTERVAL 365 DAY THEN 10 ELSE 0 END
+ least(30, year * 2) + least(20, two_years - year) + least(10, archive_depth * 2) AS score FROM g""",
        "articles",
    ),
)
def agg20(spark: SparkSession, sf: str) -> DataFrame:
    return reports.activity(role(spark, sf, "articles"), "feedId", AS_OF)


_TERMS = ("the", "ung", "tion", "zzz")
_EXAMPLES = "coalesce((SELECT string_agg(id, ',' ORDER BY textLength DESC, id) FROM (SELECT id, textLength FROM articles WHERE contains(lower(title), '{t}') ORDER BY textLength DESC, id LIMIT 5)), '')"


@query(
    "AGG21_term_coverage",
    with_roles(" UNION ALL ".join(f"SELECT '{t}' AS term, count(*) FILTER (WHERE contains(lower(title), '{t}')) AS matching, coalesce(sum(textLength) FILTER (WHERE contains(lower(title), '{t}')), 0)::BIGINT AS total, {_EXAMPLES.format(t=t)} AS examples FROM articles" for t in _TERMS), "articles"),
)
def agg21(spark: SparkSession, sf: str) -> DataFrame:
    return reports.term_coverage(role(spark, sf, "articles"), list(_TERMS), "textLength")


@query("AGG22_states", with_roles("SELECT count(*) FILTER (WHERE isActive AND lastStatus = 'success') AS healthy, count(*) FILTER (WHERE lastStatus = 'error') AS failing, count(*) FILTER (WHERE NOT isActive) AS inactive FROM feeds", "feeds"))
def agg22(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "feeds").agg(F.count_if(F.expr("isActive and lastStatus = 'success'")).alias("healthy"), F.count_if(F.col("lastStatus") == "error").alias("failing"), F.count_if(~F.col("isActive")).alias("inactive"))




@query("AGG24_changed_by_feed", with_roles("SELECT feedId, count(*) AS changed FROM articles WHERE topic IS DISTINCT FROM CASE WHEN contains(lower(title), 'on') THEN 'Banknotes' ELSE topic END GROUP BY feedId ORDER BY changed DESC, feedId", "articles"))
def agg24(spark: SparkSession, sf: str) -> DataFrame:
    new = F.when(F.contains(F.lower("title"), F.lit("on")), F.lit("Banknotes")).otherwise(F.col("topic"))
    return role(spark, sf, "articles").where(~F.col("topic").eqNullSafe(new)).groupBy("feedId").agg(F.count("*").alias("changed")).orderBy(F.desc("changed"), "feedId")


@query(
    "AGG25_keywords",
    with_roles(
        r""", t AS (SELECT id, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '^[^a-z0-9]+', ''), '^(breaking|watch|analysis|live|update):\s+', ''), '[^\p{L}\p{N}\s]', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for', 'with', 'that', 'from', 'this', 'have', 'your', 'into', 'about', 'after', 'their', 'they', 'will', 'would', 'said', 'over', 'more', 'than', 'been', 'also', 'amid', 'under', 'news', 'alert')) AS w FROM news),
u AS (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM t), c AS (SELECT id, w, count(*) AS c, min(p) AS p FROM u GROUP BY id, w)
SELECT id, string_agg(w, ' ' ORDER BY c DESC, p) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, p) AS r FROM c) WHERE r <= 5 GROUP BY id""",
        "news",
    ),
)
def agg25(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "news").select("id", F.array_join(inferred_keywords(F.col("title"), 5), " ").alias("keywords"))


@query("AGG26_rollup_extension", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg26(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


@query("STR9_daily_windows", "SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def str9(spark: SparkSession, sf: str) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return table(spark, sf, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("string").alias("day"), "event_type", "n")
