"""The ingest stream: landed items are normalised, classified, gated and merged, micro-batch by micro-batch.

Identity is deterministic (a hash of the canonical address), so a redelivered batch changes nothing; the only state is
the merge target. Late items are merged whatever their age; a watermark only bounds the state of aggregations.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedlens.functions.text import canonical_url, normal_text
from feedlens.operators import rules
from feedlens.operators.merge import latest


def work_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's shared spark.checkpoint.dir; where that is unset a temporary one on a local master, and an
    error on a cluster, whose executors wouldn't see each other's files in it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root or tempfile.mkdtemp(prefix='feedlens-')}/stream-{uuid.uuid4().hex}"


def normalized(items: DataFrame) -> DataFrame:
    """Items (title, link, contentSnippet, source, feedName, topic, pubDate) to article rows with a deterministic id."""
    rows = items.withColumns({"title": normal_text(F.col("title")), "canonicalLink": canonical_url(F.col("link"))})
    return rows.withColumn("id", F.sha2("canonicalLink", 256)).withColumn("c", rules.classified())


def gated(articles: DataFrame, source_rules: tuple[rules.SourceRule, ...], feed_url: str = "") -> DataFrame:
    return articles.withColumn("rssUrl", F.lit(feed_url)).withColumn("gate", rules.source_relevance(source_rules))


FIELDS = ("id", "title", "canonicalLink", "source", "feedId", "pubDate", "topic")


@dataclass(frozen=True)
class Tables:
    """Folders of the merge target, the rejected items and the change feed.

    The target is dealt into buckets by id. A batch writes new files of the buckets that it touches alone, and then a manifest
    of the batch that says where each bucket's files are; without its manifest a batch has changed nothing. Choose as many
    buckets as make one some hundred megabytes.
    """

    root: str
    buckets: int = 16

    def articles(self, batch: int) -> str:
        return f"{self.root}/articles/v={batch}"

    def manifest(self, batch: int) -> str:
        return f"{self.root}/manifest/v={batch}"

    def folder(self, bucket: int, batch: int) -> str:
        return f"{self.articles(batch)}/bucket={bucket}"

    @property
    def changes(self) -> str:
        return f"{self.root}/changes"

    @property
    def rejected(self) -> str:
        return f"{self.root}/rejected"

    def placed(self, spark: SparkSession, batch: int) -> dict[int, int]:
        """The batch that wrote each bucket's files, as of a batch: one number a bucket."""
        if batch < 0:
            return {}
        return {r.bucket: r.version for r in spark.read.schema("bucket int, version int").parquet(self.manifest(batch)).collect()}

    def read(self, spark: SparkSession, placed: dict[int, int], schema: str) -> DataFrame:
        """The rows of some buckets."""
        paths = [self.folder(b, v) for b, v in sorted(placed.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def merge_batch(tables: Tables, source_rules: tuple[rules.SourceRule, ...]):  # noqa: ANN201
    """The foreachBatch step: batch n starts from the manifest of n - 1, so a repeated batch overwrites itself.

    Files that neither n nor n - 1 uses are dropped after n's manifest is there.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # What is kept for both outputs; the texts that it was found in stay behind.
        judged = gated(normalized(batch), source_rules).withColumn("topic", F.col("c.topic")).select(*FIELDS, "gate").persist()
        good = latest(judged.where("gate.accepted").select(*FIELDS), ["id"], F.col("pubDate"), "title")
        good = good.withColumn("bucket", _bucket(tables.buckets)).persist()
        before = tables.placed(spark, number - 1)
        touched = [r.bucket for r in good.select("bucket").distinct().collect()]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in good.schema if f.name != "bucket")
        old = tables.read(spark, {b: before[b] for b in touched if b in before}, schema).withColumn("bucket", _bucket(tables.buckets))
        merged = good.unionByName(old.join(good.select("id"), "id", "left_anti"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(tables.articles(number))
        kind = F.when(F.col("_b").isNull(), "article:new").otherwise("article:update")
        news = good.join(old.select("id", F.lit(True).alias("_b")), "id", "left").select("id", kind.alias("type"), F.lit(number).alias("batch"))
        news.write.mode("overwrite").parquet(f"{tables.changes}/batch={number}")
        judged.where("not gate.accepted").select("id", "gate.reason").write.mode("overwrite").parquet(f"{tables.rejected}/batch={number}")
        now = before | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(tables.manifest(number))
        for b, v in tables.placed(spark, number - 2).items() if number > 1 else ():
            if before.get(b) != v:
                _drop(spark, tables.folder(b, v))
        good.unpersist()
        judged.unpersist()

    return run


def ingest(items: DataFrame, tables: Tables, source_rules: tuple[rules.SourceRule, ...] = ()) -> StreamingQuery:
    """Runs what has landed and stops: a scheduler starts it again, and it never runs twice at once on one checkpoint."""
    return items.writeStream.foreachBatch(merge_batch(tables, source_rules)).option("checkpointLocation", f"{tables.root}/checkpoint").trigger(availableNow=True).start()


ARTICLES = "id string, title string, canonicalLink string, source string, feedId string, pubDate timestamp, topic string"


def newest_version(spark: SparkSession, tables: Tables, last: int) -> DataFrame:
    """The merge target as of a batch."""
    return tables.read(spark, tables.placed(spark, last), ARTICLES)


def windowed_counts(events: DataFrame, time: str, width: str, by: str, late: str = "1 day") -> DataFrame:
    """Counts in tumbling windows of a stream or a table; on a stream the watermark bounds the open windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"))


def sliding_counts(events: DataFrame, time: str, width: str, slide: str, by: str, late: str = "1 day") -> DataFrame:
    """Counts in overlapping windows: each row counts in every window that it lies in."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide).alias("w"), by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, gap: str, by: str, late: str = "1 day") -> DataFrame:
    """Counts in sessions: rows of one key of which none is more than `gap` after the one before."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))


def first_of_each(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """One row of each key: state holds the keys seen within `late` of the newest time, and an equal key later than that counts
    as new."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
