"""The stream's bucketed target, stateful windows, and snapshots in a shared folder."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from feedlens.operators import paging, snapshots
from feedlens.operators.contract import SnapshotError
from feedlens.streaming import ingest

ITEM = "title string, link string, contentSnippet string, source string, feedName string, feedId string, topic string, pubDate timestamp"


def items(spark, *numbers, title="Item"):
    rows = [(f"{title} {k}", f"https://a.example/{k}", "", "s", "f", "s", "", None) for k in numbers]
    return spark.createDataFrame(rows, ITEM).withColumn("pubDate", F.lit("2024-01-01").cast("timestamp"))


def folders(root) -> dict:
    return {f"{p.parent.name}/{p.name}": sorted(x.name for x in p.glob("*.parquet")) for p in Path(root).glob("articles/v=*/bucket=*")}


def test_a_batch_rewrites_touched_buckets_alone(spark, tmp_path):
    tables = ingest.Tables(str(tmp_path), buckets=8)
    step = ingest.merge_batch(tables, ())
    step(items(spark, *range(40)), 0)
    first = folders(tmp_path)
    assert len(first) == 8 and ingest.newest_version(spark, tables, 0).count() == 40
    step(items(spark, 7, title="New"), 1)
    second = folders(tmp_path)
    assert {k: v for k, v in second.items() if k.startswith("v=0")} == first and len(second) == 9
    now = ingest.newest_version(spark, tables, 1)
    assert now.count() == 40 and now.where("title = 'New 7'").count() == 1
    # The same batch again changes nothing; its change feed says the same.
    step(items(spark, 7, title="New"), 1)
    assert ingest.newest_version(spark, tables, 1).count() == 40 and set(folders(tmp_path)) == set(second)
    assert [tuple(r) for r in spark.read.parquet(tables.changes).groupBy("batch", "type").count().orderBy("batch").collect()] == [(0, "article:new", 40), (1, "article:update", 1)]
    step(items(spark, 100), 2)
    step(items(spark, 7, 101), 3)
    # What batch 1 replaced was needed to repeat it, and is dropped afterwards.
    replaced = (set(second) - set(first)).pop().replace("v=1", "v=0")
    assert replaced not in folders(tmp_path)
    assert ingest.newest_version(spark, tables, 3).count() == 42


def test_an_empty_batch_keeps_the_table(spark, tmp_path):
    tables = ingest.Tables(str(tmp_path), buckets=4)
    step = ingest.merge_batch(tables, ())
    step(items(spark).limit(0), 0)
    assert ingest.newest_version(spark, tables, 0).count() == 0
    step(items(spark, 1), 1)
    step(items(spark).limit(0), 2)
    assert ingest.newest_version(spark, tables, 2).count() == 1


def test_late_keys_count_as_new_after_the_watermark(spark, tmp_path):
    """State goes one batch after the watermark has passed it, and the watermark follows the batch before."""
    days = ["2024-01-01", "2024-01-01", "2024-01-02", *["2024-02-01"] * 5]
    for k, day in enumerate(days):
        spark.createDataFrame([(day, "a")], "t string, k string").select(F.col("t").cast("timestamp").alias("t"), "k").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("t timestamp, k string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = []

    def keep(batch, number):
        out.extend(r.t.isoformat()[:10] for r in batch.collect())

    ingest.first_of_each(stream, "t", ["k"], "3 days").writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert len(out) == 2 and {d[:7] for d in out} == {"2024-01", "2024-02"}


def articles(spark, n):
    rows = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("").alias("canonicalLink"), F.lit("").alias("link"), F.timestamp_seconds(F.col("id") * 60).alias("pubDate"))
    return rows.withColumn("createdAt", F.col("pubDate"))


def test_snapshot_pages(spark, tmp_path):
    clock = [1000.0]
    names = iter(["one", "two", "one", "one", "one", " ", "three", "four", "five"])
    store = snapshots.SnapshotStore(spark, str(tmp_path / "s"), ttl=60, most_snapshots=2, most_items=7, now=lambda: clock[0], new_id=lambda: next(names))
    page = store.serve("scope", lambda: articles(spark, 7), limit=3)
    assert (page.id, page.page, page.pages, page.total, [r.id for r in page.rows.collect()]) == ("one", 1, 3, 7, ["6", "5", "4"])
    assert [r.id for r in store.serve("scope", None, page.id, "2", 3).rows.collect()] == ["3", "2", "1"]
    with pytest.raises(SnapshotError, match="scope_mismatch"):
        store.read_page("one", "other")
    last = store.serve("scope", None, "one", 99, 3)
    assert (last.id, last.page, [r.id for r in last.rows.collect()]) == ("", 3, ["0"]) and store.size() == 0
    with pytest.raises(SnapshotError, match="unavailable"):
        store.serve("scope", None, "one", 1, 3)
    store.create("a", articles(spark, 1))
    with pytest.raises(SnapshotError, match="token_failed"):
        store.create("a", articles(spark, 1))
    with pytest.raises(SnapshotError, match="scope_invalid"):
        store.create(" ", articles(spark, 1))
    clock[0] += 61
    with pytest.raises(SnapshotError, match="unavailable"):
        store.read_page("two", "a")
    with pytest.raises(SnapshotError, match="too_large"):
        store.create("a", articles(spark, 8))
    assert store.size() == 0 and store._names() == []
    assert store.create("a", articles(spark, 0)) == "four" and store.create("b", articles(spark, 2)) == "five"
    with pytest.raises(SnapshotError, match="capacity"):
        store.create("c", articles(spark, 1))
    empty = store.serve("a", None, "four", "x", None)
    assert (empty.page, empty.pages, empty.limit, empty.total, empty.id, empty.rows.count()) == (1, 1, 1, 0, "", 0)
    with pytest.raises(TypeError):
        store.serve("a", None)


def test_composite_is_bounded(spark):
    parts = [articles(spark, 5), articles(spark, 8)]
    assert paging.composite(parts, 8).groupBy("component").count().orderBy("component").collect()[1][1] == 3
    with pytest.raises(SnapshotError, match="composite_limit"):
        paging.composite(parts, 7)


def test_numbers_include_rows_of_a_null_part(spark):
    rows = spark.createDataFrame([("b", "2024-01-02"), ("a", None), ("c", "2024-01-01"), ("d", None)], "id string, day string")
    assert [r.id for r in paging.numbered(rows, F.col("day"), "day", "id").orderBy("pos").collect()] == ["a", "d", "c", "b"]


def test_the_backlog_is_filled_classified_and_matched(spark):
    from feedlens.operators import backlog

    kind = "id string, title string, link string, contentSnippet string, thumbnail string, pubDate string, topic string, source string, feedName string, fetchStatus string"
    said = [
        ("1", "Slovenia launches new passport", "u1", "", None, "2024-05-10", "", "s", "f", "pending"), ("2", "Weather", "u2", "A stored snippet that is long enough to stay as it is.", "https://a.com/x.jpg", "2024-05-10", "t", "s", "f", "partial"),
        ("3", "Weather", "gone", None, None, None, "", "s", "f", "partial"), ("4", "Weather", "u1", "", None, None, "", "s", "f", "enriched"),
    ]
    articles = spark.createDataFrame(said, kind).withColumn("pubDate", F.col("pubDate").cast("timestamp"))
    found = [("u1", "https://a.com/p.jpg", "Biometric passport with a security thread, a longer snippet.", "2024-05-01", "enriched"), ("u1", "", "", None, "partial"), ("u2", "https://a.com/y.jpg", "Another", "2024-05-09", "partial")]
    scraped = spark.createDataFrame(found, "link string, image string, snippet string, publishedAt string, fetchStatus string").withColumn("publishedAt", F.col("publishedAt").cast("timestamp"))
    items = spark.createDataFrame([("w", "Slovenia passport", True, "Open")], "id string, title string, isActive boolean, workflowStatus string")
    rows = {r.id: r for r in backlog.rematched(backlog.reprocessed(articles, scraped), items).collect()}
    assert set(rows) == {"1", "2", "3"}
    one, two, three = rows["1"], rows["2"], rows["3"]
    assert (one.thumbnail, one.fetchStatus, str(one.pubDate)[:10], one.itemId) == ("https://a.com/p.jpg", "enriched", "2024-05-01", "w") and one.contentSnippet.startswith("Biometric")
    assert "passports" in one.classifications and one.topic == "Identity Documents"
    assert (two.thumbnail, two.fetchStatus, str(two.pubDate)[:10], two.itemId) == ("https://a.com/x.jpg", "partial", "2024-05-10", None) and two.contentSnippet.startswith("A stored")
    assert (three.fetchStatus, three.contentSnippet, three.topic) == ("failed", None, "General")
