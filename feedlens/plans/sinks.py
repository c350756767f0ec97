"""Queries of the sink operators: each returns what would be stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.operators import merge, paging
from feedlens.operators.filters import expired
from feedlens.plans.articles import _EXPIRED, _PROFILED, AS_OF
from feedlens.plans.registry import query
from feedlens.sources.tables import role, with_roles
from feedlens.streaming.ingest import work_folder


@query("SNK1_insert", with_roles("SELECT id, topic, 'pending' AS status FROM articles WHERE n % 5 <> 0 UNION ALL SELECT 'new' || id, 'General', 'pending' FROM articles WHERE n % 5 = 0", "articles"))
def snk1(spark: SparkSession, sf: str) -> DataFrame:
    a = role(spark, sf, "articles")
    table = a.where("n % 5 != 0").select("id", "topic", F.lit("pending").alias("status"))
    return merge.insert(table, a.where("n % 5 = 0").select(F.concat(F.lit("new"), "id").alias("id")), {"topic": "General", "status": "pending"})


@query("SNK2_sparse_update", with_roles("SELECT id, CASE WHEN n % 10 = 0 THEN 'updated ' || id ELSE title END AS title, fetchStatus FROM articles", "articles"))
def snk2(spark: SparkSession, sf: str) -> DataFrame:
    a = role(spark, sf, "articles")
    updates = a.where("n % 10 = 0").select("id", F.concat(F.lit("updated "), "id").alias("title"), F.lit(None).cast("string").alias("fetchStatus"))
    return merge.sparse_update(a.select("id", "title", "fetchStatus"), updates)


_SNK3 = """, s AS (SELECT id, title, 'https://c/' || n AS c, thumbnail, contentSnippet AS sn, n FROM articles),
i AS (SELECT CASE WHEN n % 2 = 0 THEN CAST(n AS VARCHAR) ELSE 'x' || n END AS id, 'new ' || n AS title, 'https://c/' || CASE WHEN n % 4 = 3 THEN n + 1000000000000 ELSE n END AS c, 'https://t/' || n AS thumbnail, n FROM articles WHERE n % 3 < 2)
SELECT s.id, CASE WHEN a.id IS NOT NULL THEN a.title ELSE s.title END AS title, CASE WHEN a.id IS NOT NULL THEN a.thumbnail WHEN b.id IS NOT NULL AND coalesce(s.thumbnail, '') = '' THEN b.thumbnail ELSE s.thumbnail END AS thumbnail,
 CASE WHEN a.id IS NOT NULL THEN 'updated' WHEN b.id IS NOT NULL THEN 'backfilled' ELSE 'kept' END AS action FROM s LEFT JOIN i a ON a.id = s.id LEFT JOIN i b ON b.c = s.c AND b.n % 2 = 1
UNION ALL SELECT i.id, i.title, i.thumbnail, 'inserted' FROM i WHERE i.n % 4 = 3"""


@query("SNK3_keyed_merge", with_roles(_SNK3, "articles"))
def snk3(spark: SparkSession, sf: str) -> DataFrame:
    a = role(spark, sf, "articles")
    link = lambda n: F.concat(F.lit("https://c/"), n.cast("string"))
    none = F.array().cast("array<string>").alias("classifications")
    stored = a.select("id", "title", "link", link(F.col("n")).alias("canonicalLink"), "pubDate", "createdAt", "source", "feedId", "topic", "thumbnail", "contentSnippet", none)
    n = F.col("n")
    incoming = a.where("n % 3 < 2").select(
        F.when(n % 2 == 0, n.cast("string")).otherwise(F.concat(F.lit("x"), n.cast("string"))).alias("id"), F.concat(F.lit("new "), n.cast("string")).alias("title"), "link",
        link(F.when(n % 4 == 3, n + 1000000000000).otherwise(n)).alias("canonicalLink"), "pubDate", "createdAt", "source", "feedId", "topic", F.concat(F.lit("https://t/"), n.cast("string")).alias("thumbnail"), "contentSnippet", none, n.alias("arrival"),
    )
    return merge.keyed_merge(stored, incoming).select("id", "title", "thumbnail", "action")


@query("SNK4_backfill_flags", with_roles("SELECT id, coalesce(thumbnail, '') = '' AS fill_thumbnail, length(coalesce(summaryShort, '')) < 40 AS fill_snippet FROM articles", "articles"))
def snk4(spark: SparkSession, sf: str) -> DataFrame:
    return role(spark, sf, "articles").select("id", (F.coalesce("thumbnail", F.lit("")) == "").alias("fill_thumbnail"), (F.length(F.coalesce("summaryShort", F.lit(""))) < merge.SHORT_SNIPPET).alias("fill_snippet"))


@query("SNK5_array_merge", with_roles("SELECT id, CASE WHEN n % 3 = 0 THEN 'x' ELSE keywords END AS merged, n % 3 = 0 AS changed FROM articles", "articles"))
def snk5(spark: SparkSession, sf: str) -> DataFrame:
    old = F.split("keywords", ",")
    new = F.when(F.col("n") % 3 == 0, F.array(F.lit("x"))).when(F.col("n") % 3 == 1, old)
    return role(spark, sf, "articles").select("id", merge.array_merge(old, new).alias("m")).select("id", F.array_join("m.value", ",").alias("merged"), F.col("m.changed").alias("changed"))


@query("SNK6_replace_on_sync", with_roles("SELECT feedId, count(*) AS n FROM (SELECT feedId FROM articles WHERE n % 5 < 4 AND feedId NOT IN (SELECT feedId FROM articles WHERE n % 5 = 4 AND feedId IN ('src1', 'src2')) UNION ALL SELECT feedId FROM articles WHERE n % 5 = 4 AND feedId IN ('src1', 'src2', 'src3')) GROUP BY feedId", "articles"))
def snk6(spark: SparkSession, sf: str) -> DataFrame:
    a = role(spark, sf, "articles")
    batch = a.where("n % 5 = 4 and feedId in ('src1', 'src2', 'src3')").select("id", "feedId", (F.col("feedId") != "src3").alias("hasDate"))
    return merge.replace_on_sync(a.where("n % 5 < 4").select("id", "feedId"), batch).groupBy("feedId").agg(F.count("*").alias("n"))


@query("SNK7_feedback_upsert", with_roles("SELECT \"articleId\", \"clientId\", CASE WHEN CAST(\"articleId\" AS BIGINT) % 2 = 0 THEN 'fixed' ELSE reason END AS reason FROM feedback UNION ALL SELECT 'n1', 'client0', 'late'", "feedback"))
def snk7(spark: SparkSession, sf: str) -> DataFrame:
    f = role(spark, sf, "feedback")
    again = f.where("cast(articleId as bigint) % 2 = 0").withColumn("reason", F.lit("fixed"))
    new = spark.createDataFrame([("n1", "client0", "early", "2024-06-01 00:00:00"), ("n1", "client0", "late", "2024-06-02 00:00:00")], "articleId string, clientId string, reason string, createdAt string").withColumn("createdAt", F.col("createdAt").cast("timestamp"))
    return merge.upsert_latest(f, again.unionByName(new), ["articleId", "clientId"], "createdAt", "reason").select("articleId", "clientId", "reason")


@query("SNK8_feedback_ttl", with_roles("SELECT \"articleId\", \"clientId\" FROM feedback WHERE NOT (createdAt < TIMESTAMP '2024-06-10' - INTERVAL 5 DAY) AND NOT (\"articleId\" = '5' AND \"clientId\" = 'client2')", "feedback"))
def snk8(spark: SparkSession, sf: str) -> DataFrame:
    f = role(spark, sf, "feedback")
    return f.where("not (createdAt < timestamp'2024-06-10' - interval 5 days) and not (articleId = '5' and clientId = 'client2')").select("articleId", "clientId")


@query("SNK9_items", with_roles("SELECT id, CASE WHEN workflowStatus = 'Completed' THEN false ELSE isActive END AS active FROM items UNION ALL SELECT 'new9', true", "items"))
def snk9(spark: SparkSession, sf: str) -> DataFrame:
    items = role(spark, sf, "items").select("id", "title", "isActive", "workflowStatus")
    new = spark.createDataFrame([("new9", "Slovenia passport", True, "Open")], items.schema)
    both = merge.upsert_latest(items, new, ["id"], "title", "id")
    return both.select("id", F.when(F.col("workflowStatus") == "Completed", False).otherwise(F.col("isActive")).alias("active"))


@query("SNK10_sync_matches", with_roles("SELECT \"articleId\", \"wishlistItemId\" FROM bridge WHERE CAST(\"articleId\" AS BIGINT) % 4 <> 0 UNION ALL SELECT \"articleId\", 'w0' FROM bridge WHERE CAST(\"articleId\" AS BIGINT) % 8 = 0", "bridge"))
def snk10(spark: SparkSession, sf: str) -> DataFrame:
    b = role(spark, sf, "bridge")
    number = F.col("articleId").cast("bigint")
    strong = b.where(number % 8 == 0).withColumn("wishlistItemId", F.lit("w0"))
    return merge.sync_matches(b, b.where(number % 4 == 0), strong).select("articleId", "wishlistItemId")


@query("SNK11_retention_delete", with_roles(f"SELECT id FROM articles WHERE NOT ({_EXPIRED})", "articles"))
def snk11(spark: SparkSession, sf: str) -> DataFrame:
    rows = role(spark, sf, "articles").withColumn("profileSignals", F.array(F.expr(_PROFILED)))
    return rows.where(~expired(AS_OF, ["src0", "src5"])).select("id")


@query("SNK12_loggable", with_roles("SELECT id FROM poll_logs WHERE status = 'error' OR \"newArticles\" > 20", "poll_logs"))
def snk12(spark: SparkSession, sf: str) -> DataFrame:
    return merge.loggable(role(spark, sf, "poll_logs").withColumn("newArticles", F.col("newArticles") - 20)).select("id")


@query("SNK13_cascade_delete", with_roles("SELECT 'articles' AS child, count(*) AS n FROM articles WHERE \"feedId\" NOT IN ('src1', 'src2') UNION ALL SELECT 'logs', count(*) FROM poll_logs WHERE \"feedId\" NOT IN ('src1', 'src2')", "articles", "poll_logs"))
def snk13(spark: SparkSession, sf: str) -> DataFrame:
    gone = spark.createDataFrame([("src1",), ("src2",)], "id string")
    left = merge.cascade_delete(gone, {"articles": (role(spark, sf, "articles"), "feedId"), "logs": (role(spark, sf, "poll_logs"), "feedId")})
    return left["articles"].agg(F.lit("articles").alias("child"), F.count("*").alias("n")).unionByName(left["logs"].agg(F.lit("logs").alias("child"), F.count("*").alias("n")))


@query("SNK14_delete_plan", with_roles("SELECT id, CASE WHEN contains(lower(title), 'job') THEN 'career' ELSE 'collector' END AS \"deleteReason\" FROM news WHERE regexp_matches(lower(title), 'job|collector')", "news"))
def snk14(spark: SparkSession, sf: str) -> DataFrame:
    t = F.lower("title")
    return merge.delete_plan(role(spark, sf, "news"), F.when(F.contains(t, F.lit("job")), "career").when(F.contains(t, F.lit("collector")), "collector")).select("id", "deleteReason")


@query("SNK15_consolidate", with_roles("SELECT id, isDuplicate OR (size > 1 AND NOT skipped AND r > 1) AS \"isDuplicate\", CASE WHEN size > 1 AND NOT skipped AND r > 1 THEN p END AS \"duplicateOf\" FROM (SELECT a.id, a.isDuplicate, coalesce(canonicalLink, '') <> '' AND true AS linked, CASE WHEN coalesce(canonicalLink, '') = '' THEN 1 ELSE count(*) OVER w END AS size, row_number() OVER (w ORDER BY createdAt, a.id) AS r, first_value(a.id) OVER (w ORDER BY createdAt, a.id) AS p, bool_or(f.id IS NOT NULL) OVER w AS skipped FROM articles a LEFT JOIN (SELECT DISTINCT \"articleId\" AS id FROM feedback) f ON f.id = a.id WINDOW w AS (PARTITION BY canonicalLink))", "articles", "feedback"))
def snk15(spark: SparkSession, sf: str) -> DataFrame:
    a = role(spark, sf, "articles")
    path = f"{work_folder(spark)}/plan"
    paging.consolidation_plan(a, role(spark, sf, "feedback").select(F.col("articleId").alias("id"))).write.parquet(path)
    plan = spark.read.parquet(path)
    # What was approved: one article of each group that isn't skipped stays.
    shown = plan.agg(F.count("*") - F.countDistinct("canonicalLink")).first()[0]
    return merge.apply_consolidation(a, plan, shown).select("id", "isDuplicate", "duplicateOf")


@query("SNK16_seed_actions", with_roles("SELECT action, count(*) AS n FROM (SELECT CASE WHEN id = 'src7' THEN 'retire' WHEN id IN ('src0', 'src5') THEN 'update' WHEN id IN ('src1', 'src2') THEN 'skip' ELSE 'keep' END AS action FROM feeds UNION ALL SELECT 'create' FROM (VALUES (1), (2))) GROUP BY action", "feeds"))
def snk16(spark: SparkSession, sf: str) -> DataFrame:
    now = role(spark, sf, "feeds").select("id", "name", "sourceGroup")
    desired = now.where("id in ('src1', 'src2')").unionByName(now.where("id in ('src0', 'src5')").withColumn("name", F.lit("renamed"))).unionByName(spark.createDataFrame([("new1", "a", "news"), ("new2", "b", "news")], now.schema))
    retired = spark.createDataFrame([("src7",)], "id string")
    return merge.seed_actions(now, desired, "id", retired).groupBy("action").agg(F.count("*").alias("n"))


@query("SNK17_bulk_import", with_roles("SELECT n, CASE WHEN n % 9 = 0 THEN 'invalid' WHEN k < 5 THEN 'duplicate_of_stored' WHEN r > 1 THEN 'duplicate_in_batch' WHEN sum(CASE WHEN n % 9 <> 0 AND k >= 5 AND r = 1 THEN 1 ELSE 0 END) OVER (ORDER BY n) > 20 THEN 'over_cap' ELSE 'added' END AS outcome FROM (SELECT n, n % 40 AS k, row_number() OVER (PARTITION BY n % 9 <> 0, n % 40 ORDER BY n) AS r FROM articles)", "articles"))
def snk17(spark: SparkSession, sf: str) -> DataFrame:
    rows = role(spark, sf, "articles").select("n", (F.col("n") % 40).cast("string").alias("key"))
    stored = spark.range(5).select(F.col("id").cast("string").alias("key"))
    return merge.import_outcomes(rows, stored, "key", "n", F.col("n") % 9 != 0, 20).select("n", "outcome")


#: Suppliers as a catalog of feeds: some without an address, some of one that a feed has, some that repeat another's.
_CATALOG = """SELECT s_suppkey AS n, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'link' ELSE 'RSS ' END AS mode,
  CASE WHEN s_suppkey % 5 = 0 THEN ' ' WHEN s_suppkey % 3 = 0 THEN 'https://src' || CAST(s_nationkey AS STRING) || '.example.com/rss' ELSE 'https://catalog.example.com/' || CAST(s_suppkey % 60 AS STRING) END AS url FROM {supplier}"""


@query(
    "SNK18_catalog_import",
    with_roles(
        ", c AS (" + _CATALOG.format(supplier="supplier") + """),
d AS (SELECT *, EXISTS (SELECT 1 FROM feeds f WHERE f.rssUrl = c.url) AS there, row_number() OVER (PARTITION BY trim(mode), trim(url) ORDER BY n) AS r FROM c)
SELECT n, CASE WHEN mode = 'link' THEN 'not_rss' WHEN trim(url) = '' THEN 'no_url' WHEN there OR r > 1 THEN 'existing' ELSE 'imported' END AS outcome FROM d""",
        "feeds",
    ),
)
def snk18(spark: SparkSession, sf: str) -> DataFrame:
    catalog = spark.sql(_CATALOG, supplier=spark.read.parquet(f"{sf}/supplier.parquet"))
    return merge.catalog_import(catalog, role(spark, sf, "feeds")).select("n", "outcome")


@query(
    "SNK20_mirror_plan",
    with_roles(
        """SELECT id, CASE id WHEN 'src1' THEN 'already_exists_by_name' WHEN 'src2' THEN 'would_reactivate_inactive' WHEN 'src4' THEN 'already_exists_by_url' WHEN 'src5' THEN 'would_reactivate_inactive' ELSE 'would_create' END AS status FROM feeds
UNION ALL SELECT * FROM (VALUES ('c1', CASE WHEN EXISTS (SELECT 1 FROM feeds WHERE id = 'src6') THEN 'already_planned_by_database_feed' ELSE 'would_create' END), ('c2', 'would_create'), ('c3', 'skipped'))""",
        "feeds",
    ),
)
def snk20(spark: SparkSession, sf: str) -> DataFrame:
    f = role(spark, sf, "feeds")
    url = "https://mirror.example.com/search?q=feed+"
    mirrors = {"src1": ("Mirror Feed src1", "https://other.example.com/1", True), "src2": ("Mirror two", url + "src2", False), "src4": ("Mirror four", url + "src4", True), "src5": ("Mirror Feed src5", "https://other.example.com/5", False)}
    taken = spark.createDataFrame([(f"m-{k}", *v) for k, v in mirrors.items()], "id string, name string, rssUrl string, isActive boolean")
    configured = spark.createDataFrame([("c1", " Feed  SRC6"), ("c2", "polymer notes"), ("c3", " ")], "id string, query string")
    return merge.mirror_plan(f.select("id", "name", "rssUrl", "isActive").unionByName(taken), configured).select("id", "status")


_NATIONS = "SELECT CASE WHEN n_regionkey = 1 THEN 'Canada' ELSE 'us' END AS region, CASE WHEN n_nationkey % 2 = 0 THEN 'https://src' || CAST(n_nationkey AS STRING) || '.example.com/rss' ELSE '' END AS url, CAST(NULL AS STRING) AS path FROM {nation}"


@query(
    "SNK21_legacy_cleanup",
    with_roles(", c AS (" + _NATIONS.format(nation="nation").replace("AS STRING", "AS VARCHAR") + ") SELECT f.id FROM feeds f WHERE contains(f.rssUrl, 'example.com/rss') AND coalesce((SELECT bool_or(c.region = 'Canada') FROM c WHERE c.url = f.rssUrl), regexp_matches(lower(f.name), 'src1|src3'))", "feeds"),
)
def snk21(spark: SparkSession, sf: str) -> DataFrame:
    catalog = spark.sql(_NATIONS, nation=spark.read.parquet(f"{sf}/nation.parquet"))
    return merge.legacy_feeds(role(spark, sf, "feeds"), catalog, "example.com/rss", "canada", ("src1", "src3")).select("id")
