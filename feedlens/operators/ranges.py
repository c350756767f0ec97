"""Complete retrieval under a bound: a date scope is halved until each range holds few enough rows.

The ranges that halving can reach are the same whatever the rows are: each day lies in one range a level. So one count a day
gives the rows of every such range at once, and each day keeps the first range, from the whole scope down, that isn't halved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.operators.contract import SnapshotError
from feedlens.operators.paging import newest_first

#: Halvings of a scope; 2**20 days are more than the calendar has.
_LEVELS = 20


def _nested(day: Column, first: Column, last: Column, least_days: int) -> Column:
    """The ranges (lo, hi) that hold a day, from the scope down to the one that is too short to halve. Days are numbers."""

    def halved(found: Column, _: Column) -> Column:
        now = F.element_at(found, F.lit(-1))
        span = now["hi"] - now["lo"]
        middle = now["lo"] + (span / 2).cast("int")
        half = F.when(day <= middle, F.struct(now["lo"].alias("lo"), middle.alias("hi"))).otherwise(F.struct((middle + 1).alias("lo"), now["hi"].alias("hi")))
        return F.when(span <= max(1, least_days), found).otherwise(F.concat(found, F.array(half)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_LEVELS)), F.array(F.struct(first.alias("lo"), last.alias("hi"))), halved)


def day_ranges(rows: DataFrame, time: str, first: str, last: str, bound: int, least_days: int = 7) -> DataFrame:
    """day, lo, hi, n and over for each day with rows in the scope: its range, the range's rows and whether these exceed the bound.

    A range of more than `bound` rows is halved, the first half taking the middle day, as long as it spans more than
    `least_days`. Rows of a null time lie in no range. One row a day is counted before anything is compared.
    """
    number = lambda x: F.datediff(x, F.lit("1970-01-01").cast("date"))
    counts = rows.select(number(F.to_date(time)).alias("d")).where(F.col("d").between(number(F.lit(first).cast("date")), number(F.lit(last).cast("date"))))
    each = counts.groupBy("d").agg(F.count("*").alias("c"))
    nested = each.select("d", "c", F.posexplode(_nested(F.col("d"), number(F.lit(first).cast("date")), number(F.lit(last).cast("date")), least_days)).alias("level", "r"))
    sized = nested.withColumn("n", F.sum("c").over(Window.partitionBy("r")))
    final = (F.col("n") <= bound) | (F.col("r.hi") - F.col("r.lo") <= max(1, least_days))
    kept = sized.where(final).groupBy("d").agg(F.min_by(F.struct("r.lo", "r.hi", "n"), "level").alias("x"))
    as_day = lambda x: F.date_add(F.lit("1970-01-01").cast("date"), x)
    return kept.select(as_day(F.col("d")).alias("day"), as_day(F.col("x.lo")).alias("lo"), as_day(F.col("x.hi")).alias("hi"), "x.n", (F.col("x.n") > bound).alias("over"))


def candidate_key() -> Column:
    """canonical: and the canonical link, or id: and the id; null without either."""
    filled = lambda c: F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))
    return F.coalesce(F.concat(F.lit("canonical:"), filled("canonicalLink")), F.concat(F.lit("id:"), filled("id")))


def complete(articles: DataFrame, first: str, last: str, bound: int, least_days: int = 7) -> DataFrame:
    """The articles of a scope with their range (lo, hi, n, over), one of each candidate key: that of the earliest range, in it
    the newest. Articles without a key are left out."""
    days = day_ranges(articles, "pubDate", first, last, bound, least_days)
    met = articles.withColumn("day", F.to_date("pubDate")).join(days, "day").withColumn("key", candidate_key()).where("key is not null")
    order = Window.partitionBy("key").orderBy("lo", *newest_first())
    return met.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "day")


def require_complete(ranges: DataFrame) -> None:
    """Refuses a scope with a range that can't be halved and still exceeds the bound."""
    if ranges.where("over").limit(1).count():
        raise SnapshotError("source_limit")
