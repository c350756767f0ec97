"""Rules that the SQL twins don't reach: edge cases, refusals and invariants."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedlens.functions import text as T
from feedlens.operators import filters, matching, merge, paging, reports, rules
from feedlens.operators.filters import ArticleQuery, predicate
from feedlens.sources import html


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_titles_and_entities(spark):
    assert one(spark, T.normal_title(F.col("t")), t="  ** BREAKING: New <b>note</b> &amp; coin!") == "new note coin"
    assert one(spark, T.sanitized(F.col("t")), t="&#72;&#x69; &amp;lt;b&gt;") == "Hi <b>"
    assert one(spark, T.sanitized(F.col("t"), "none"), t="  ") == "none"


def test_urls(spark):
    assert one(spark, T.canonical_url(F.col("u")), u="https://www.google.com/url?q=1&url=https%3A%2F%2FWWW.Site.com%2Fa%3Futm_source%3Dx%26b%3D1#top") == "https://site.com/a?b=1"
    assert one(spark, T.canonical_url(F.col("u")), u="http://a.com?ved=1") == "http://a.com/"
    assert one(spark, T.canonical_url(F.col("u")), u=" not a url ") == "not a url"


def test_dates(spark):
    for said, day in (("on 5 March 2024", "2024-03-05"), ("Mar 7, 2023", "2023-03-07"), ("am 1.12.2022", "2022-12-01"), ("2024-02-30 or", None), ("no date", None)):
        assert one(spark, F.to_date(html.text_date(F.col("t"))).cast("string"), t=said) == day


def test_wishlist_needs_exactly_one_item(spark):
    items = spark.createDataFrame([("a", "Slovenia passport 2024", True, "Open"), ("b", "Croatia ID card", True, "Open"), ("c", "Slovenia passport", False, "Open"), ("d", "Slovenian visa March 2024", True, "Open")], "id string, title string, isActive boolean, workflowStatus string")
    said = [
        ("1", "Slovenian passport launched in 2024", "2024-05-01"), ("2", "Slovenia passport launched. In 2023.", "2024-05-01"), ("3", "Croatia issues identity cards. Slovenia issues passport 2024", "2024-05-01"),
        ("4", "Slovenia passport office issues 2024 passport", "2024-05-01"), ("5", "Croatia launches new ID card", "2024-05-01"), ("6", None, "2024-05-01"),
    ]
    articles = spark.createDataFrame(said, "id string, title string, pubDate string").withColumns({"pubDate": F.col("pubDate").cast("timestamp"), "contentSnippet": F.lit("")})
    found = {(r.articleId, r.itemId) for r in matching.wishlist_matches(articles, items).collect()}
    assert found == {("1", "a"), ("5", "b")}


def _event(k, key, day, **more):
    base = {"id": k, "title": "t", "summary": "", "identityEventKey": key, "pubDate": day, "domain": "banknote", "topicFamily": "f", "canonicalEventType": "banknote_redesign", "country": "Ghana", "primaryEntity": "", "authority": "", "grouped": True, "confidence": "high"}
    return base | more


def test_event_pairs(spark):
    rows = [
        _event(1, "a", "2024-01-01"), _event(2, "b", "2024-01-11"), _event(3, "c", "2024-01-12"), _event(4, "b", "2024-01-02", canonicalEventType="commemorative_note"),
        _event(5, "d", "2024-01-03", country="Kenya", authority="x"), _event(6, "e", "2024-01-03", country="Mali", authority="x"), _event(7, "f", "2024-01-04", confidence="low"),
    ]
    events = spark.createDataFrame(rows, "id bigint, title string, summary string, identityEventKey string, pubDate string, domain string, topicFamily string, canonicalEventType string, country string, primaryEntity string, authority string, grouped boolean, confidence string")
    events = events.withColumns({"pubDate": F.col("pubDate").cast("timestamp"), "systems": F.array().cast("array<string>")})
    found = {(r.a, r.b): r.reason for r in matching.event_pairs(events).collect()}
    assert found[(1, 2)] == found[(1, 4)] == "high_confidence_entity_or_country"
    assert found[(2, 4)] == "not_cross_bucket"
    assert found[(5, 6)] == "conflicting_primary_entity_or_country"
    assert (1, 3) not in found
    assert found[(1, 7)] == "high_confidence_entity_or_country"  # the left fingerprint counts


def test_normal_forms_of_odd_texts(spark):
    blank = T.BLANK
    said = ["", " \u00a0\ufeff\t x \x0b y\n\n", "\ufeff", "  ...Breaking:  Live: News\nmore", "watch:x", "UPDATE:\n\u2003y", "a <<< b > c < d", "\u00c9t\u00e9 a a b a", None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(said)], "k int, x string")
    old = F.regexp_replace(F.regexp_replace(F.lower("x"), "^[^a-z0-9]+", ""), "^(breaking|watch|analysis|live|update):\\s+", "")
    same = rows.where(~T.trimmed(F.col("x")).eqNullSafe(F.regexp_replace("x", f"^{blank}+|{blank}+$", "")) | ~T.title_lead(F.col("x")).eqNullSafe(old))
    assert same.collect() == []
    assert rows.where("k = 7").select(T.inferred_keywords(F.lit("beta beta alpha gamma gamma"), 2).alias("w")).first().w == ["beta", "gamma"]


def test_long_texts_are_lowered_once(spark):
    columns = ("title", "contentSnippet", "link", "source", "feedName", "topic")
    rows = spark.range(1).select(*[F.col("id").cast("string").alias(c) for c in columns]).localCheckpoint()
    plan = rows.select(rules.classified())._jdf.queryExecution().analyzed().toString()
    assert plan.count("coalesce(contentSnippet#") == 1


def test_pairs_of_alike_events(spark, monkeypatch):
    """Pairs and their counts against every pair of ids decided alone; rows of alike events are far fewer than events."""
    monkeypatch.setattr(matching, "ALIKE", 7)
    rows = [_event(f"e{k:03}", "ab"[k % 2], f"2024-01-{1 + 9 * (k % 3):02}", country="Ghana" if k % 5 else "Mali", authority="x" if k % 4 else "", confidence=None if k % 2 else "high" if k % 3 else "low", grouped=k % 7 != 0) for k in range(120)]
    events = spark.createDataFrame([*rows, _event("e120", "a", None)], "id string, title string, summary string, identityEventKey string, pubDate string, domain string, topicFamily string, canonicalEventType string, country string, primaryEntity string, authority string, grouped boolean, confidence string")
    events = events.withColumns({"pubDate": F.col("pubDate").cast("timestamp"), "systems": F.array(F.lit("s"))})
    ids = events.where("pubDate is not null").select("id")
    every = matching.decided(ids.select(F.col("id").alias("a")).join(ids.select(F.col("id").alias("b")), F.expr("a < b")), events).where("reason != 'outside_10_day_window'")
    days = events.select("id", F.unix_seconds("pubDate").alias("s"))
    near = every.join(days.alias("x"), F.expr("a = x.id")).join(days.alias("y"), F.expr("b = y.id")).where("abs(x.s - y.s) <= 864000")
    wanted = sorted((r.a, r.b, r.reason) for r in near.collect())
    assert sorted((r.a, r.b, r.reason) for r in matching.event_pairs(events).collect()) == wanted and len({w[2] for w in wanted}) >= 4
    assert {r.reason: r.n for r in matching.pair_counts(events).collect()} == {k: sum(w[2] == k for w in wanted) for k in {w[2] for w in wanted}}
    monkeypatch.setattr(matching, "ALIKE", 512)
    many = events.where("pubDate is not null").crossJoin(spark.range(50).withColumnRenamed("id", "copy")).withColumn("id", F.concat("id", F.lit("-"), "copy")).drop("copy")
    assert matching._met(many).count() == matching._met(many.where("id < 'e120'")).count() < 84 * 84


def test_plans_refuse_other_counts(spark):
    table = spark.range(5).select(F.col("id").cast("string").alias("id"))
    plan = table.where("id < '2'")
    assert merge.apply_delete(table, plan, 2).count() == 3
    with pytest.raises(ValueError):
        merge.apply_delete(table, plan, 3)


def test_snapshot_bounds(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").cast("string").alias("id"), F.current_timestamp().alias("pubDate"), F.current_timestamp().alias("createdAt"))
    with pytest.raises(ValueError):
        paging.snapshot(rows, str(tmp_path / "a"), 9)
    items = paging.snapshot(rows, str(tmp_path / "b"), 10)
    assert [r.pos for r in paging.snapshot_page(items, 3, 4).collect()] == [3, 4, 5, 6]


def test_unified_reports_the_first_failure(spark):
    x = rules.unified(F.lit(True), F.lit(False), F.lit(False), F.lit(True))
    assert one(spark, x["failedStage"]) == "profilePolicy"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3), st.sampled_from(["", "a", "B", "b "])), min_size=1, max_size=12))
def test_dedupe_keeps_one_of_each_key(spark, rows):
    df = spark.createDataFrame([(str(k), f"l{n}", c, f"2024-01-0{d + 1}") for k, (n, d, c) in enumerate(rows)], "id string, link string, canonicalLink string, pubDate string")
    df = df.withColumns({"pubDate": F.col("pubDate").cast("timestamp"), "createdAt": F.col("pubDate").cast("timestamp")})
    found = paging.dedupe_canonical(df).collect()
    keys = {(c.strip().lower() or f"l{n}") for n, _, c in rows}
    assert {r.canonicalKey for r in found} == keys and len(found) == len(keys)


def test_filters_shrink(spark):
    df = spark.createDataFrame([("1", "A b", None), ("2", "b", "x")], "id string, title string, topic string").withColumns({c: F.lit(None).cast("string") for c in ("source", "feedName", "link", "canonicalLink", "contentSnippet")})
    assert df.where(predicate(ArticleQuery(search="B"))).count() == 2
    assert df.where(predicate(ArticleQuery(search="b a"))).count() == 1
    assert df.where(predicate(ArticleQuery(search="%"))).count() == 0


def test_page_filters_before_it_dedupes(spark):
    """An older article that matches isn't lost to its newer twin that doesn't; total counts what is left."""
    rows = [("1", "old match", "k", "2024-01-01"), ("2", "newer twin", "k", "2024-01-02"), ("3", "match too", "m", "2024-01-03")]
    df = spark.createDataFrame(rows, "id string, title string, canonicalLink string, pubDate string").withColumns({"pubDate": F.col("pubDate").cast("timestamp"), "createdAt": F.col("pubDate").cast("timestamp"), "link": F.lit("")})
    found = paging.canonical_page(df, F.contains("title", F.lit("match")), 1, 200, 2).collect()
    assert [(r.id, r.total, r.truncated) for r in found] == [("3", 2, True), ("1", 2, True)]
    assert not paging.canonical_page(df, F.contains("title", F.lit("match")), 1, 200, 3).first().truncated


def test_numbers_run_through_the_parts(spark):
    df = spark.range(50).select((F.col("id") * 7 % 50).alias("k"))
    found = paging.numbered(df, F.floor(F.col("k") / 9), "k").collect()
    assert all(r.pos == r.k + 1 for r in found) and len(found) == 50


def test_import_cap(spark):
    rows = spark.createDataFrame([(k, str(k % 6)) for k in range(12)], "n bigint, key string")
    out = {r.n: r.outcome for r in merge.import_outcomes(rows, spark.createDataFrame([("0",)], "key string"), "key", "n", F.col("n") != 2, 2).collect()}
    assert [out[k] for k in range(6)] == ["duplicate_of_stored", "added", "invalid", "added", "over_cap", "over_cap"] and out[7] == "duplicate_in_batch"
    assert {r.outcome for r in merge.import_outcomes(rows, spark.createDataFrame([], "key string"), "key", "n", F.lit(True), 0).collect()} == {"over_cap", "duplicate_in_batch"}


def test_signals_by_name():
    assert filters.signal_keywords(" identity-theft ") == ("identity theft", "stolen identity")
    assert filters.signal_keywords("no such signal") == () == filters.signal_keywords(None)


def test_mirror_plan_to_be_applied(spark):
    feeds = spark.createDataFrame([("a", "Mint News", "https://a.example.com", True), ("m", "Mirror mint news", "https://m.example.com", False)], "id string, name string, rssUrl string, isActive boolean")
    asked = spark.createDataFrame([("c", "MINT news"), ("d", "coins"), ("e", None)], "id string, query string")
    found = {r["id"]: r["status"] for r in merge.mirror_plan(feeds, asked, apply=True).collect()}
    assert found == {"a": "pending_reactivate", "c": "already_planned_by_database_feed", "d": "pending_create", "e": "skipped"}


def test_trend_words_of_long_and_missing_texts(spark):
    rows = [("1", "s1", "Banknotes", "polymer", "mint " * 3000, "2024-12-05"), ("2", "s2", "Banknotes", None, None, "2024-12-06"), ("3", "s2", None, "polymer", "", "2024-11-01")]
    articles = spark.createDataFrame(rows, "id string, source string, topic string, title string, contentSnippet string, day string").selectExpr("*", "timestamp(day) as pubDate", "timestamp(day) as createdAt")
    found = {r["key"]: (r["id"], r["n"], r["sources"], r["ids"], r["score"]) for r in reports.trends(articles, "7d", 7, "2024-12-01").collect()}
    assert found == {"banknotes": ("7d-banknotes", 2, 2, "1,2", 3.0), "polymer": ("7d-polymer", 1, 1, "1", 1.5), "mint": ("7d-mint", 1, 1, "1", 1.5)}
