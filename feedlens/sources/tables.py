"""Role tables of the monitor over the test parquet files.

Each adapter is one portable SELECT, so the SQL twins of the queries can use the same text as a common table
expression. Production tables have the same columns and are read with spark.read.parquet alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Headlines that make the rule engines fire; picked by document number.
HEADLINES = (
    "Central bank issues new banknote series with security thread",
    "Slovenia launches new biometric passport with polycarbonate page",
    "Digital identity wallet rollout begins in three regions",
    "Border control authority deploys biometric entry exit system",
    "Breaking: Police arrest suspect over counterfeit banknotes",
    "Job vacancy: developer guide for login portal",
    "New national id card redesign unveiled by ministry",
    "Collector guide to banknote values at auction",
    "Visa infinite credit card launches samsung wallet offer",
    "Security printing firm wins contract for optically variable ink",
    "Passport ranking and visa-free travel advice for summer",
    "Watch: Polymer banknote production starts at printing works",
    "Driving licence standard updated for mobile licence holders",
    "Weather report and sports update",
    "Identity verification platform announces partnership",
    "Croatia residence permit design introduces security features 2024",
)

ARTICLES = """
SELECT CAST(doc_id AS STRING) AS id, doc_id AS n, split_part(text, chr(10), 1) AS title, text AS contentSnippet,
  'https://www.site' || CAST(doc_id % 20 AS STRING) || '.example.com/news/' || CAST(doc_id % 700 AS STRING) || '?utm_source=rss' AS link,
  CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN NULL ELSE 'https://Site' || CAST(doc_id % 20 AS STRING) || '.example.com/news/' || CAST(doc_id % 350 AS STRING) END AS canonicalLink,
  CAST('2024-01-01 00:00:00' AS timestamp) + CAST(doc_id % 365 AS INT) * INTERVAL '1' DAY AS pubDate,
  CAST('2024-01-01 00:00:00' AS timestamp) + CAST(doc_id % 365 AS INT) * INTERVAL '1' DAY + CAST(doc_id % 5 AS INT) * INTERVAL '1' HOUR AS createdAt,
  source, source AS feedId, 'Feed ' || source AS feedName,
  CASE lang WHEN 'en' THEN 'Banknotes' WHEN 'fr' THEN 'Identity Documents' WHEN 'de' THEN 'Digital Identity' ELSE '' END AS topic, lang AS language,
  lang || ',' || source AS keywords, doc_id % 11 = 0 AS isDuplicate,
  CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'partial' WHEN 2 THEN 'enriched' ELSE 'failed' END AS fetchStatus,
  CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN '' WHEN doc_id % 6 = 2 THEN 'https://cdn.example.com/logo-placeholder.png' ELSE 'https://cdn.example.com/' || CAST(doc_id AS STRING) || '.jpg' END AS thumbnail,
  CASE WHEN doc_id % 9 = 0 THEN '' ELSE substr(text, 1, 120) END AS summaryShort, length(text) AS textLength
FROM {documents}
"""

FEEDS = """
SELECT source AS id, 'Feed ' || source AS name, 'https://' || source || '.example.com/rss' AS rssUrl, source <> 'src3' AS isActive,
  CASE WHEN source IN ('src1', 'src2') THEN 'error' WHEN source = 'src4' THEN '' ELSE 'success' END AS lastStatus,
  CASE WHEN source LIKE 'src1%' THEN 'website' ELSE 'rss' END AS sourceType,
  CASE WHEN source IN ('src0', 'src5') THEN 'vendors' WHEN source IN ('src6', 'src7') THEN 'central_banks' ELSE 'news' END AS sourceGroup,
  CASE WHEN source IN ('src0', 'src5') THEN 'vendors,security_printer' WHEN source IN ('src6', 'src7') THEN 'central_bank' ELSE 'border_control,passport_authority,identity_verification,researcher' END AS affinities,
  CAST('2024-01-01 00:00:00' AS timestamp) + CAST(min(doc_id) % 365 AS INT) * INTERVAL '1' DAY AS createdAt
FROM {documents} GROUP BY source
UNION ALL SELECT 'src99', 'Feed src99', 'https://src99.example.com/rss', true, 'success', 'rss', 'news', '', CAST('2024-01-01 00:00:00' AS timestamp)
"""

POLL_LOGS = """
SELECT event_id AS id, 'src' || CAST(user_id % 20 AS STRING) AS feedId, CAST(ts AS timestamp) AS startedAt, event_type AS status,
  CAST(floor(value) AS INT) AS newArticles, props AS errorMessage FROM {events}
"""

NEWS = """
SELECT CAST(d.doc_id AS STRING) AS id, d.doc_id AS n, h.title, d.text AS contentSnippet,
  'https://' || d.source || '.example.com/item/' || CAST(d.doc_id AS STRING) AS link, d.source, d.source AS feedId, 'Feed ' || d.source AS feedName,
  CAST('2024-01-01 00:00:00' AS timestamp) + CAST(d.doc_id % 365 AS INT) * INTERVAL '1' DAY AS pubDate, '' AS topic
FROM {documents} d JOIN (SELECT * FROM (VALUES """ + ", ".join(f"({k}, '{h}')" for k, h in enumerate(HEADLINES)) + f""") AS v(k, title)) h ON d.doc_id % {len(HEADLINES)} = h.k
"""

BRIDGE = """
SELECT CAST(doc_id AS STRING) AS articleId, 'w' || CAST(doc_id % 5 AS STRING) AS wishlistItemId, CASE WHEN doc_id % 3 = 0 THEN 'strong' ELSE 'weak' END AS confidence FROM {documents} WHERE doc_id % 2 = 0
"""

ITEMS = """
SELECT 'w' || CAST(item_id AS STRING) AS id, text AS title, item_id % 4 <> 1 AS isActive, CASE WHEN item_id % 3 = 2 THEN 'Completed' ELSE 'Open' END AS workflowStatus FROM {benchmark}
"""

FEEDBACK = """
SELECT CAST(doc_id AS STRING) AS articleId, 'client' || CAST(doc_id % 3 AS STRING) AS clientId, CASE WHEN toxic = 1 THEN 'spam' ELSE 'off_topic' END AS reason,
  CAST('2024-06-01 00:00:00' AS timestamp) + CAST(doc_id % 10 AS INT) * INTERVAL '1' DAY AS createdAt FROM {labels} WHERE toxic = 1 OR quality = 0
"""

ROLES = {"articles": (ARTICLES, "documents"), "feeds": (FEEDS, "documents"), "poll_logs": (POLL_LOGS, "events"), "news": (NEWS, "documents"), "bridge": (BRIDGE, "documents"), "items": (ITEMS, "benchmark"), "feedback": (FEEDBACK, "labels")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A plain test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role table of the monitor."""
    text, base = ROLES[name]
    return spark.sql(text, **{base: table(spark, sf_dir, base)})


def with_roles(sql: str, *names: str) -> str:
    """SQL text preceded by the role tables that it reads."""
    return "WITH " + ", ".join(f"{n} AS ({ROLES[n][0].format(**{ROLES[n][1]: ROLES[n][1]})})" for n in names) + "\n" + sql
