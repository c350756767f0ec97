"""Report operators that take any table: ages, shares, sizes, coverage, activity and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions.text import tokens

#: Labels too general to be a trend.
GENERIC_LABELS = ("news", "alert", "alerts", "world", "tech", "report", "update", "company", "industry", "article", "monitoring")


def _before(column: str, as_of: str, days: int):  # noqa: ANN202
    return F.col(column) < F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")


def ages(rows: DataFrame, column: str, as_of: str, days: tuple[int, ...], by: list[str] | None = None) -> DataFrame:
    """How many rows are older than each number of days, in one pass."""
    return rows.groupBy(*(by or [])).agg(*[F.count_if(_before(column, as_of, d)).alias(f"older_{d}") for d in days])


def shares(rows: DataFrame, by: str) -> DataFrame:
    """Counts and percent of all rows; the total comes from the counts, not from a second scan."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))
    return counts.crossJoin(total).select(by, "n", F.when(F.col("total") > 0, F.round(F.col("n") * 100.0 / F.col("total"), 2)).otherwise(0.0).alias("percent"))


def column_sizes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Average and largest bytes of each column: one pass, then one row a column."""
    size = lambda c: F.octet_length(F.coalesce(F.col(c), F.lit("")))
    one = rows.agg(F.array(*[F.struct(F.lit(c).alias("name"), F.round(F.avg(size(c)), 4).alias("average"), F.max(size(c)).cast("bigint").alias("largest")) for c in columns]).alias("x"))
    return one.select(F.inline("x"))


def retention_counts(articles: DataFrame, as_of: str, extended_feeds: list[str], days: int = 365, long_days: int = 1095) -> DataFrame:
    """Expired articles of both scopes. With an empty scope the extended count has no scope of its own, so both overlap."""
    scope = F.col("feedId").isin(extended_feeds) if extended_feeds else None
    old, very_old = _before("pubDate", as_of, days), _before("pubDate", as_of, long_days)
    return articles.agg(F.count_if(old if scope is None else ~scope & old).alias("standard"), F.count_if(very_old if scope is None else scope & very_old).alias("extended"))


def activity(articles: DataFrame, by: str, as_of: str) -> DataFrame:
    """Latest date, items of the last one and two years, depth of the archive, and a score of recency, volume and depth."""
    at = lambda d: F.lit(as_of).cast("timestamp") - F.expr(f"interval {d} days")
    g = articles.groupBy(by).agg(
        F.max("pubDate").alias("last"), F.count_if(F.col("pubDate") >= at(365)).alias("year"), F.count_if(F.col("pubDate") >= at(730)).alias("two_years"), F.count("*").alias("n")
    )
    last = F.col("last")
    step = F.when(last >= at(30), 40).when(last >= at(90), 28).when(last >= at(180), 18).when(last >= at(365), 10).otherwise(0)
    g = g.withColumn("archive_depth", F.least(F.lit(6), F.ceil(F.col("n") / 10)))
    volume = F.least(F.lit(30), F.col("year") * 2) + F.least(F.lit(20), F.col("two_years") - F.col("year"))
    score = step + volume + F.least(F.lit(10), F.col("archive_depth") * 2)
    return g.select(by, last.cast("string").alias("latest"), "year", "two_years", "archive_depth", score.alias("score"))


def term_coverage(articles: DataFrame, terms: list[str], measure: str, key: str = "id", examples: int = 5) -> DataFrame:
    """Articles and a measure's sum for each term, and the keys of the articles that measure most.

    The sums are conditional sums of one pass. The examples are a rank within each term, which Spark limits before its shuffle.
    """
    hit = lambda t: F.contains(F.lower("title"), F.lit(t))
    each = [F.struct(F.lit(t).alias("term"), F.count_if(hit(t)).alias("matching"), F.coalesce(F.sum(F.when(hit(t), F.col(measure))), F.lit(0)).cast("bigint").alias("total")) for t in terms]
    sums = articles.agg(F.array(*each).alias("x")).select(F.inline("x"))
    met = F.array_compact(F.array(*[F.when(hit(t), F.lit(t)) for t in terms]))
    most = Window.partitionBy("term").orderBy(F.desc_nulls_last(measure), key)
    heads = articles.select(key, measure, F.explode(met).alias("term")).withColumn("r", F.row_number().over(most)).where(F.col("r") <= examples)
    named = heads.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("r", F.col(key).alias("k")))).alias("s"))
    named = named.select("term", F.array_join(F.transform("s", lambda x: x["k"]), ",").alias("examples"))
    return sums.join(named, "term", "left").select("term", "matching", "total", F.coalesce("examples", F.lit("")).alias("examples"))


def trends(articles: DataFrame, timeframe: str, days: int, since: str, newest: int = 400, top: int = 12) -> DataFrame:
    """Labels of the newest articles: the topic and the five most frequent words of title, text and topic (ties: the first).

    A label counts once an article, weighted by recency, plus half a point for each distinct source; ids are those of its
    articles, at most `newest`. Words are counted as rows, so that a long text costs no more than its words.
    """
    head = articles.where(F.col("pubDate") >= F.lit(since).cast("timestamp")).orderBy(F.desc("pubDate"), F.desc("createdAt"), "id").limit(newest)
    words = head.select("id", F.posexplode(tokens(F.concat_ws(" ", "title", "contentSnippet", "topic"))).alias("at", "label"))
    counted = words.groupBy("id", "label").agg(F.count("*").alias("c"), F.min("at").alias("at"))
    own = Window.partitionBy("id").orderBy(F.desc("c"), "at")
    five = counted.withColumn("r", F.row_number().over(own)).where("r <= 5").select("id", "label")
    labels = five.unionByName(head.select("id", F.col("topic").alias("label"))).select("id", F.lower(F.trim("label")).alias("key")).distinct()
    useful = labels.where((F.length("key") >= 4) & ~F.col("key").isin(*GENERIC_LABELS)).join(head.select("id", "source"), "id")
    g = useful.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))
    score = F.col("n") * (1 + max(0, 7 - days)) + F.col("sources") * 0.5
    named = F.concat(F.lit(f"{timeframe}-"), F.regexp_replace("key", "\\s+", "-"))
    return g.select(named.alias("id"), "key", "n", "sources", "ids", score.alias("score")).orderBy(F.desc("score"), "key").limit(top)
