"""Canonical dedupe, paging, set operations and persisted snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.operators.contract import SnapshotError


def canonical_key() -> Column:
    """lower(trim(first non-empty of canonical link, link, id))."""
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return F.lower(F.coalesce(filled("canonicalLink"), filled("link"), F.col("id")))


def newest_first() -> list[Column]:
    return [F.desc("pubDate"), F.desc("createdAt"), F.asc("id")]


def dedupe_canonical(articles: DataFrame) -> DataFrame:
    """The newest article of each canonical key; ties go to the smallest id. One shuffle on the key."""
    order = Window.partitionBy("canonicalKey").orderBy(*newest_first())
    return articles.withColumn("canonicalKey", canonical_key()).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def page(articles: DataFrame, number: int = 1, size: int = 200, most: int = 200) -> DataFrame:
    """A page in the feed order; size is clamped to 1..most. Planned as a top-k, never as a full sort."""
    size = max(1, min(size, most))
    return articles.orderBy(*newest_first()).offset((max(1, number) - 1) * size).limit(size)


def candidates(articles: DataFrame, most: int) -> DataFrame:
    """The newest `most` candidates, deduped; truncated tells whether the limit was reached."""
    head = articles.orderBy(*newest_first()).limit(most)  # a top-k: what follows is bounded by it
    return dedupe_canonical(head.withColumn("truncated", F.count("*").over(Window.partitionBy()) >= most))


def canonical_page(articles: DataFrame, matches: Column, number: int = 1, size: int = 200, most: int = 1500) -> DataFrame:
    """The article API's page: filter, order, candidate limit, dedupe, then the page; with total (of the deduped) and
    truncated. The filter comes first, so a match isn't lost to a newer twin that doesn't match, and it reaches the scan."""
    found = candidates(articles.where(matches), most)
    return page(found.withColumn("total", F.count("*").over(Window.partitionBy())), number, size)


def numbered(rows: DataFrame, part: Column, *order: str) -> DataFrame:
    """rows with pos, their number from 1 in an order that `part` doesn't break (a day of a leading timestamp, say): numbers
    within each part plus the counts of the parts before, so that only one row a part meets in one task. Rows of a null
    part are numbered first."""
    dealt = rows.withColumn("_part", part)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(before.withColumnRenamed("_part", "_at"), F.col("_part").eqNullSafe(F.col("_at"))).drop("_at").withColumn("pos", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def composite(components: list[DataFrame], most: int | None = None) -> DataFrame:
    """Union of components, each canonical key from the first component that has it; refuses more than `most` rows."""
    tagged = [c.withColumn("component", F.lit(k)) for k, c in enumerate(components)]
    every = tagged[0]
    for more in tagged[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("canonicalKey").orderBy("component", *newest_first())
    one = every.withColumn("canonicalKey", canonical_key()).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    if most is not None and one.limit(most + 1).count() > most:
        raise SnapshotError("composite_limit")
    return one


def append_page(before: DataFrame, page_rows: DataFrame) -> DataFrame:
    """Rows of a further page whose key isn't there yet, after those that are."""
    key = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.nullif(F.col("canonicalLink"), F.lit("")), F.col("link"))
    new = page_rows.withColumn("_k", key).join(before.select(key.alias("_k")).distinct(), "_k", "left_anti").drop("_k")
    return before.unionByName(new)


def consolidation_plan(articles: DataFrame, protected: DataFrame) -> DataFrame:
    """Groups of one canonical link: the oldest stays, the others point at it; a group with a protected article is skipped whole."""
    group = Window.partitionBy("canonicalLink")
    guarded = protected.select("id").distinct().withColumn("_p", F.lit(True))
    rows = articles.where("canonicalLink is not null and canonicalLink != ''").join(guarded, "id", "left")
    rows = rows.select(
        "id", "canonicalLink", F.row_number().over(group.orderBy("createdAt", "id")).alias("r"), F.count("*").over(group).alias("size"),
        F.coalesce(F.bool_or(F.col("_p")).over(group), F.lit(False)).alias("skipped"), F.first("id").over(group.orderBy("createdAt", "id")).alias("primaryId"),
    )
    return rows.where("size > 1 and not skipped").select("id", "canonicalLink", "primaryId", (F.col("r") > 1).alias("isDuplicate"))


def snapshot(articles: DataFrame, path: str, most: int) -> DataFrame:
    """Writes the ordered items once under a scope's path, so that pages are range filters on pos; refuses more than most."""
    if articles.limit(most + 1).count() > most:
        raise ValueError(f"the snapshot would hold more than {most} items")
    ordered = articles.orderBy(*newest_first()).limit(most)
    ordered.withColumn("pos", F.row_number().over(Window.orderBy(*newest_first()))).write.mode("overwrite").parquet(path)
    return articles.sparkSession.read.parquet(path)


def snapshot_page(items: DataFrame, first: int, size: int) -> DataFrame:
    return items.where(F.col("pos").between(first, first + size - 1)).orderBy("pos")
