"""Queries that run the streaming jobs on the test tables until all that has landed is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.operators import backlog
from feedlens.plans.registry import query
from feedlens.plans.rules import _RUL14 as WISHLIST_SQL
from feedlens.plans.rules import _SCORED as SCORED_SQL
from feedlens.plans.rules import ITEMS, SOURCE_RULES
from feedlens.plans.sources import _PARSED as PARSED_SQL
from feedlens.sources import html
from feedlens.sources.tables import role, table, with_roles
from feedlens.streaming import ingest


def _run(spark: SparkSession, sf: str) -> tuple[ingest.Tables, int]:
    """Lands the news items in three parts, the last of which repeats the first, and ingests each as one batch once it is there."""
    root = ingest.work_folder(spark)
    news = role(spark, sf, "news")
    tables, last = ingest.Tables(f"{root}/tables"), -1
    for k, part in enumerate((news.where("n % 2 = 0"), news.where("n % 2 = 1"), news.where("n % 2 = 0"))):
        part.write.parquet(f"{root}/landing/part{k}")
        landed = spark.readStream.schema(news.schema).option("recursiveFileLookup", "true").parquet(f"{root}/landing")
        done = ingest.ingest(landed, tables, SOURCE_RULES)
        done.awaitTermination()
        last = max(last, done.lastProgress["batchId"])
    return tables, last


@query(
    "STR1_stream_ingest",
    with_roles(
        """, base AS (SELECT *, lower(title || ' ' || link || ' ' || contentSnippet) AS x, lower(title || ' ' || link) AS hd, lower(title) AS ttl, lower(feedName) AS fd FROM news)
SELECT sha256(link) AS id, source FROM base WHERE CASE
 WHEN contains(fd, 'feed src1') THEN NOT contains(ttl, 'weather') AND (regexp_matches(hd, '(^|[^a-z0-9])biometric[\\s\\-/&]+passport([^a-z0-9]|$)') OR (NOT regexp_matches(x, '(^|[^a-z0-9])(job|collector)([^a-z0-9]|$)') AND regexp_matches(x, '(^|[^a-z0-9])(passport|banknote)([^a-z0-9]|$)')))
 WHEN contains(fd, 'feed src2') OR contains(fd, 'feed src3') THEN NOT contains(lower(link), '/item/7') AND source <> 'src3' AND regexp_matches(x, '(^|[^a-z0-9])(digital[\\s\\-/&]+identity|biometric)([^a-z0-9]|$)')
 ELSE true END""".replace("\\\\", "\\"),
        "news",
    ),
)
def str1(spark: SparkSession, sf: str) -> DataFrame:
    tables, last = _run(spark, sf)
    return ingest.newest_version(spark, tables, last).select("id", "source")


@query("STR3_idempotent_changes", with_roles("SELECT 3 AS batches, count(*) AS ids FROM (SELECT DISTINCT link FROM news WHERE source NOT LIKE 'src1%' AND source NOT IN ('src2', 'src3'))", "news"))
def str3(spark: SparkSession, sf: str) -> DataFrame:
    """A redelivered file adds a batch but no article: ids over the feeds without a rule, counted once each."""
    tables, last = _run(spark, sf)
    rows = ingest.newest_version(spark, tables, last).where("not source like 'src1%' and source not in ('src2', 'src3')")
    return rows.agg(F.lit(last + 1).alias("batches"), F.count("*").alias("ids"))


@query("STR7_change_feed", with_roles("SELECT type, count(*) AS n FROM (SELECT unnest(CASE WHEN n % 2 = 0 THEN ['article:new', 'article:update'] ELSE ['article:new'] END) AS type FROM news WHERE source NOT LIKE 'src1%' AND source NOT IN ('src2', 'src3')) GROUP BY type", "news"))
def str7(spark: SparkSession, sf: str) -> DataFrame:
    tables, last = _run(spark, sf)
    free = ingest.newest_version(spark, tables, last).where("not source like 'src1%' and source not in ('src2', 'src3')").select("id")
    return spark.read.parquet(tables.changes).join(free, "id", "left_semi").groupBy("type").agg(F.count("*").alias("n"))


def _settled(spark: SparkSession, rows: DataFrame, counted, mode: str = "complete") -> DataFrame:  # noqa: ANN001
    """The rows as a stream of four files, one a batch, through `counted`; what the sink holds when all is processed."""
    root = ingest.work_folder(spark)
    rows.repartition(4).write.parquet(f"{root}/landing")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landing")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    done = counted(stream).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    done.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out if mode == "append" else out.where(F.col("batch") == done.lastProgress["batchId"])


#: Longer than any of the tables' logs: no row is late.
_EVER = "3650 days"


@query("STR4_late_windows", with_roles("SELECT CAST(date_trunc('day', startedAt) AS VARCHAR) AS day, status, count(*) AS n FROM poll_logs GROUP BY ALL", "poll_logs"))
def str4(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts of the logs as a stream; every landed row counts, because the watermark is as long as the table."""
    logs = role(spark, sf, "poll_logs").select("startedAt", "status")
    last = _settled(spark, logs, lambda s: ingest.windowed_counts(s, "startedAt", "1 day", "status", late=_EVER))
    return last.select(F.col("w.start").cast("string").alias("day"), "status", "n")


@query(
    "STR9_sliding_windows",
    with_roles("SELECT CAST(date_trunc('day', startedAt) - CAST(k AS INTEGER) * INTERVAL 1 DAY AS VARCHAR) AS first, status, count(*) AS n FROM poll_logs, (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL", "poll_logs"),
)
def str9_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Counts in windows of three days, a new one each day, of the logs as a stream."""
    logs = role(spark, sf, "poll_logs").select("startedAt", "status")
    last = _settled(spark, logs, lambda s: ingest.sliding_counts(s, "startedAt", "3 days", "1 day", "status", late=_EVER))
    return last.select(F.col("w.start").cast("string").alias("first"), "status", "n")


@query(
    "STR9_sessions",
    with_roles(
        """, m AS (SELECT feedId, startedAt, CASE WHEN startedAt - lag(startedAt) OVER (PARTITION BY feedId ORDER BY startedAt) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM poll_logs),
s AS (SELECT feedId, startedAt, sum(new) OVER (PARTITION BY feedId ORDER BY startedAt ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, row_number() OVER () AS r FROM m))
SELECT feedId, CAST(epoch_us(min(startedAt)) AS BIGINT) AS first, CAST(epoch_us(max(startedAt)) AS BIGINT) AS last, count(*) AS n FROM s GROUP BY feedId, k""",
        "poll_logs",
    ),
)
def str9_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a feed's logs, of which none is more than six hours after the one before, of the logs as a stream."""
    logs = role(spark, sf, "poll_logs").select("startedAt", "feedId")
    last = _settled(spark, logs, lambda s: ingest.sessions(s, "startedAt", "6 hours", "feedId", late=_EVER))
    return last.select("feedId", F.unix_micros("w.start").alias("first"), (F.unix_micros("w.end") - 6 * 3_600_000_000).alias("last"), "n")


@query("STR9_stream_dedupe", with_roles("SELECT DISTINCT feedId, status, CAST(CAST(startedAt AS DATE) AS VARCHAR) AS day FROM poll_logs", "poll_logs"))
def str9_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """One log of each feed, status and day, of the logs as a stream; the state remembers all keys, because no row is late."""
    logs = role(spark, sf, "poll_logs").select("startedAt", "feedId", "status", F.to_date("startedAt").cast("string").alias("day"))
    return _settled(spark, logs, lambda s: ingest.first_of_each(s, "startedAt", ["feedId", "status", "day"], _EVER), "append").select("feedId", "status", "day")


#: Waiting articles: every second has no snippet, and each stands at the address of the page of its number.
_WAITING = """SELECT n.id, n.n, n.title, coalesce(p.url, n.link) AS link, CASE WHEN n.n % 2 = 0 THEN 'Short.' ELSE n.contentSnippet END AS contentSnippet, '' AS thumbnail, n.pubDate, n.topic, n.source, n.feedName,
  CASE n.n % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'partial' ELSE 'enriched' END AS fetchStatus FROM {news} n LEFT JOIN {pages} p ON p.page_id = n.n"""
_BACKLOG = (
    ", " + PARSED_SQL.removeprefix("WITH ")
    + ", waits AS (" + _WAITING.format(news="news", pages="pages") + """),
fixed AS (SELECT a.* REPLACE (CASE WHEN length(a.contentSnippet) < 40 AND length(s.snippet) > length(a.contentSnippet) THEN s.snippet ELSE a.contentSnippet END AS contentSnippet,
  CASE WHEN s.link IS NULL THEN 'failed' WHEN s.snippet <> '' THEN 'enriched' ELSE 'partial' END AS fetchStatus)
  FROM waits a LEFT JOIN (SELECT url AS link, max(snippet) AS snippet FROM x GROUP BY url) s ON s.link = a.link WHERE a.fetchStatus <> 'enriched')
""" + SCORED_SQL.replace("FROM news", "FROM fixed")
    + """, matched AS (WITH """ + WISHLIST_SQL.removeprefix(", ").replace("FROM news", "FROM fixed") + """)
SELECT f.id, f.fetchStatus AS status, sha256(f.contentSnippet) AS snippet, coalesce((SELECT string_agg(rule, ',' ORDER BY s DESC, k) FROM hits h WHERE h.id = f.id), '') AS classes, m."itemId" AS item FROM fixed f LEFT JOIN matched m ON m."articleId" = f.id"""
)


@query("STR6_backlog_reprocess", with_roles(_BACKLOG, "news"))
def str6(spark: SparkSession, sf: str) -> DataFrame:
    """The backlog of articles through scrape, update, classification and matching."""
    pages = table(spark, sf, "pages")
    waiting = spark.sql(_WAITING, news=role(spark, sf, "news"), pages=pages)
    scraped = html.metadata(html.parsed(pages)).join(pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("link")), "page_id")
    items = spark.createDataFrame(list(ITEMS), "id string, title string, isActive boolean, workflowStatus string")
    out = backlog.rematched(backlog.reprocessed(waiting, scraped), items)
    return out.select("id", F.col("fetchStatus").alias("status"), F.sha2("contentSnippet", 256).alias("snippet"), F.array_join("classifications", ",").alias("classes"), F.col("itemId").alias("item"))
