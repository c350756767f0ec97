"""Rows as the API and the store see them: articles with their decisions, and feed items as article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.text import canonical_url, host_of, inferred_keywords, normal_title, presentable, sanitized, summary_short
from feedlens.operators import rules

_NONE = "array<string>"


def _filled(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def _list(rows: DataFrame, *names: str) -> Column:
    """The first of these array columns that the table has and the row holds."""
    return F.coalesce(*[F.col(n) for n in names if n in rows.columns], F.array().cast(_NONE))


def article_dto(articles: DataFrame, affinities: Column, placeholder: str = "placeholder") -> DataFrame:
    """Articles with resolved address and image, lists that are never null, tags (keywords where there are none), and the
    decision of each profile: array<struct<profile, matched, reason>>. Absolute canonical links stand, others follow the link."""
    base = F.regexp_extract("link", "^([a-zA-Z]+://[^/?#]+)", 1)
    canonical = F.when(_filled("canonicalLink").isNull(), F.col("link")).when(F.col("canonicalLink").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("canonicalLink")).when(F.col("canonicalLink").startswith("/"), F.concat(base, "canonicalLink")).otherwise(F.col("link"))
    domains, signals, classes = (_list(articles, c) for c in ("domains", "profileSignals", "classifications"))
    said = F.concat_ws(" ", "title", "contentSnippet", "source")
    each = []
    for p in rules.PROFILES:
        d = rules.profile_decision(p, affinities, domains, signals, classes, said)
        each.append(F.struct(F.lit(p).alias("profile"), d["accepted"].alias("matched"), d["reason"].alias("reason")))
    return articles.select(
        "id", "title", "link", canonical.alias("canonicalLink"), F.when(presentable(F.col("thumbnail")), F.col("thumbnail")).otherwise(placeholder).alias("thumbnail"), F.coalesce(_filled("topic"), F.lit("General")).alias("topic"),
        domains.alias("domains"), signals.alias("profileSignals"), classes.alias("classifications"), _list(articles, "tags", "keywords").alias("tags"), F.array(*each).alias("profileDecisions"),
    )


def article_rows(items: DataFrame) -> DataFrame:
    """Items (title, link, description, source, tags, topic, feedName) as article rows; items without a link are none.

    keywords are the tags, then those of the classes found, then six that the texts suggest, each once.
    """
    title, snippet = sanitized(F.col("title"), "Untitled Article", numeric=False), sanitized(F.col("description"), numeric=False)
    source = F.coalesce(_filled("source"), F.nullif(host_of(F.col("link")), F.lit("")), F.lit("Unknown"))
    tags = F.coalesce(F.col("tags"), F.array().cast(_NONE))
    rows = items.where(_filled("link").isNotNull()).withColumns({"title": title, "contentSnippet": snippet, "source": source, "tags": tags, "canonicalLink": canonical_url(F.col("link"))})
    rows = rows.withColumn("c", rules.classified(keywords=F.col("tags")))
    keywords = F.array_distinct(F.concat("tags", "c.tags", inferred_keywords(F.concat_ws(" ", "title", "contentSnippet", "topic"), 6)))
    return rows.select(
        F.sha2("canonicalLink", 256).alias("id"), "title", normal_title(F.col("title")).alias("normalizedTitle"), "link", "canonicalLink", "source", "contentSnippet",
        summary_short(F.coalesce(_filled("contentSnippet"), F.col("title"))).alias("summaryShort"), keywords.alias("keywords"), F.col("c.topic").alias("topic"), F.col("c.domains").alias("domains"),
        F.col("c.signals").alias("profileSignals"), F.col("c.classes").alias("classifications"),
    )
