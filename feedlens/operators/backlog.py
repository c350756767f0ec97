"""The backlog: articles that wait for enrichment meet what a scrape found, are updated, classified anew and matched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions.text import corrected_date, presentable
from feedlens.operators import matching, rules
from feedlens.operators.merge import SHORT_SNIPPET

WAITING = ("pending", "partial")


def reprocessed(articles: DataFrame, scraped: DataFrame) -> DataFrame:
    """Waiting articles (id, title, link, contentSnippet, thumbnail, pubDate, topic, source, feedName, fetchStatus) after a scrape
    (link, image, snippet, publishedAt, fetchStatus), with domains and classifications.

    An unusable thumbnail and a short snippet are filled, a publisher's date more than a day older counts, and the status is the
    scrape's; an article whose page wasn't there has failed and keeps what it has. Of several scrapes of a link one is taken.
    """
    found = scraped.groupBy("link").agg(F.max_by(F.struct("image", "snippet", "publishedAt", F.col("fetchStatus").alias("status")), F.struct("publishedAt", "image", "snippet")).alias("s"))
    met = articles.where(F.col("fetchStatus").isin(*WAITING)).join(found, "link", "left")
    short = F.length(F.coalesce("contentSnippet", F.lit(""))) < SHORT_SNIPPET
    filled = met.withColumns({
        "thumbnail": F.when(~presentable(F.col("thumbnail")) & presentable(F.col("s.image")), F.col("s.image")).otherwise(F.col("thumbnail")),
        "contentSnippet": F.when(short & (F.length("s.snippet") > F.length(F.coalesce("contentSnippet", F.lit("")))), F.col("s.snippet")).otherwise(F.col("contentSnippet")),
        "pubDate": F.coalesce(corrected_date(F.col("pubDate"), F.col("s.publishedAt")), "pubDate"),
        "fetchStatus": F.coalesce("s.status", F.lit("failed")),
    })
    out = filled.withColumn("_c", rules.classified())
    return out.select(*[F.col("_c.topic").alias(c) if c == "topic" else F.col(c) for c in articles.columns], F.col("_c.domains").alias("domains"), F.col("_c.classes").alias("classifications"))


def rematched(updated: DataFrame, items: DataFrame) -> DataFrame:
    """updated with itemId and matchedTerms of the one wishlist item that an article now names; null without one."""
    found = matching.wishlist_matches(updated, items).withColumnRenamed("articleId", "id")
    return updated.join(found, "id", "left")
