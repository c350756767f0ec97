"""Source rules by table, the default stream's reasons and ranges under a bound."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from feedlens.operators import ranges, relevance, source_rules
from feedlens.operators.contract import SnapshotError

ARTICLE = "feedId string, title string, contentSnippet string, source string, link string, expected string"


def test_source_rules(spark):
    names = list(dict.fromkeys(r[1] for r in source_rules.parsed(source_rules.RULES)))
    feeds = spark.createDataFrame([(f"f{k}", n if k % 2 else None, None if k % 2 else f"https://{u}") for k, (n, u) in enumerate(zip(names, ("www.BankOfEngland.co.uk/rss", "", "tech.gov.sg/x", "", "www.resbank.co.za/rss", "", "printing works newsroom", ""), strict=True))] + [("none", "Other feed", "")], "id string, name string, rssUrl string")
    said = [
        ("f0", "Wildlife on the next banknotes", "A design theme.", None, None, "included-term"),
        ("f0", "Policy report", "The committee sets the interest rate outlook for cash.", None, None, "excluded-term:interest rate"),
        ("f0", "Foreign currency reserves: a market notice", "About foreign-currency reserves.", None, None, "excluded-term:foreign currency reserves"),
        ("f0", None, None, None, None, "missing-allowlist-term"),
        ("f1", "Designs for new banknotes", "After the monetary policy discussion.", None, None, "protected-source-term:banknotes"),
        ("f1", "Monetary policy decision on cash", "Rates unchanged.", None, None, "excluded-term:monetary policy"),
        ("f2", "Singpass launches passkeys", "", None, None, "included-term"),
        ("f2", "Technology scholarships", "Talent.", None, None, "excluded-term:scholarships"),
        ("f3", "A seamless e-Channel service", "", None, None, "included-term"),
        ("f3", "Twenty arrested: identity cards", "Overstayers and an illegal worker.", None, None, "excluded-term:arrested, illegal worker, overstayers"),
        ("f4", "Cost of cash study", "", None, None, "included-term"),
        ("f5", "Passport WEBINAR", "", None, "https://a.example/Events/one/", "rejected-page:path-pattern:/events/, title:webinar"),
        ("f5", "Passport news", "", "The Sponsored-Desk", "https://a.example/b", "excluded-publisher:sponsored desk"),
        ("f6", "Banknote series: careers", "", None, "https://a.example/news/1", "protected-source-term:banknote series"),
        ("f6", "Banknote series: careers", "", None, "https://a.example/b", "excluded-term:careers"),
        ("f6", "Banknote", "", None, "https://a.example/?print=1", "rejected-page:link-pattern:?print=1"),
        ("f6", "Banknote", "", None, "https://a.example/NEWS/", "rejected-page:path:/news"),
        ("f7", "Passport/reform - tender results", "", None, "https://a.example/b", "protected-source-term:passport reform"),
        ("f7", "Passport", "", None, "https://x.com/intent/tweet", "rejected-non-article-link:x.com/intent/"),
        ("none", "Anything", "", None, None, "no-source-rule"), ("gone", "Anything", "", None, None, "no-source-rule"),
    ]
    rows = spark.createDataFrame(said, ARTICLE)
    found = source_rules.assessed(rows, feeds, source_rules.rule_table(spark))
    assert [(r.title, r.reason) for r in found.collect() if r.reason != r.expected] == [] and found.count() == len(said)
    assert found.where("accepted != (reason like 'included%' or reason like 'protected%' or reason = 'no-source-rule')").count() == 0


def test_first_rule_wins_and_rules_are_data(spark):
    table = spark.createDataFrame([(1, "b", "key", 0, "news"), (0, "a", "key", 0, "daily news"), (0, "a", "include", 0, "C++ (new)"), (1, "b", "include", 0, None), (1, "b", "include", 1, "x.y")], "rule int, name string, class string, at int, value string")
    feeds = spark.createDataFrame([("1", "The Daily News", ""), ("2", "Weekly news", "")], "id string, name string, rssUrl string")
    rows = spark.createDataFrame([("1", "on c++ (new) today", "", "", "", ""), ("1", "x.y", "", "", "", ""), ("2", "a x.y b", "", "", "", ""), ("2", "xzy", "", "", "", "")], ARTICLE)
    assert [(r.rule, r.accepted) for r in source_rules.assessed(rows, feeds, table).orderBy("feedId", F.desc("accepted")).collect()] == [("a", True), ("a", False), ("b", True), ("b", False)]
    assert source_rules.assessed(rows, feeds, table.limit(0)).where("reason != 'no-source-rule'").count() == 0


#: title, snippet, feed, stored labels, links, reason
STREAM = [
    ("Big blaze in town", "The fire brigade was called.", "OVD north", "", "", "emergency_dispatch_alert_context"),
    ("Man held on warrant at bridge", "He was arrested.", "CBP Newsroom", "", "", "cbp_individual_enforcement_without_document_or_biometric_system"),
    ("Biometric check finds fugitive", "The border post uses a new passport platform.", "CBP Newsroom", "", "", "digital_identity_title_subject_and_event"),
    ("Cocaine found", "A joint action.", "Frontex Newsroom", "", "", "frontex_drugs_enforcement_without_document_or_biometric_system"),
    ("New school opens", "Funding.", "Yukon DMV", "", "", "dmv_feed_missing_motor_vehicle_or_licensing_subject"),
    ("Banknotes with ultraviolet art", "A clip.", "Bing Mirror - notes", "", "https://msn.com/en/vi-AB12", "mirrored_consumer_video_context"),
    ("Reserve bank issues banknotes", "A new series.", "Bing Mirror - notes", "", "https://msn.com/en/vi-AB12", "banknotes_title_subject_and_event"),
    ("Police raid home press", "Banknotes printed, one suspect.", "", "", "", "banknotes_missing_title_subject_or_event"),
    ("Counterfeit banknotes ring broken", "Police seized notes from the counterfeit ring.", "", "", "", "banknotes_title_subject_and_event"),
    ("Young man arrested with banknotes", "Freshly printed.", "", "", "", "banknotes_missing_title_subject_or_event"),
    ("Markets retreat", "Policy is uncertain.", "", "bank_notes", "", "banknotes_missing_title_subject_or_event"),
    ("Home display with face id", "A biometric lock for the smart-home.", "", "", "", "consumer_smart_home_biometric_context"),
    ("Drive-through biometrics for the channel tunnel", "Travellers wait.", "", "", "", "digital_identity_title_subject_and_event"),
    ("Fears at the crossing", "Travellers wait.", "Entry Exit System", "", "", "digital_identity_missing_title_subject_or_event"),
    ("Leader not given passport", "He is a convicted offender.", "", "", "", "personal_criminal_passport_context"),
    ("Mail seeking new passport", "Forwarded to the capital.", "", "", "", "individual_passport_request_context"),
    ("Mail " + "seeking " + "x " * 60 + "passport", "Forwarded.", "", "", "", "identity_documents_missing_title_subject_or_event"),
    ("Ousted leader loses travel documents", "After the return plan.", "", "", "", "personal_political_passport_eligibility_context"),
    ("Passport dispute", "Ministry denies a new passport to a man.", "", "", "", "individual_passport_decision_context"),
    ("National passport reform", "Rules for a convicted offender. A regulation is issued.", "", "", "", "identity_documents_title_subject_and_event"),
    ("Celebrity shows passport", "The authority issued it before the holiday.", "", "", "", "identity_documents_missing_title_subject_or_event"),
    ("City park opens", None, None, None, None, "family_neutral"), (None, None, None, None, None, "family_neutral"),
    ("The épassports of art", "No subject: a letter stands before it, but ASCII edges count.", "", "", "", "identity_documents_missing_title_subject_or_event"),
]


def test_default_stream_reasons(spark):
    rows = spark.createDataFrame(STREAM, "title string, snippet string, feed string, stored string, meta string, expected string")
    fields = {c: F.col(c) for c in ("title", "feed", "stored", "meta")} | {"content": F.concat_ws(" ", "title", "snippet")}
    found = rows.select("*", relevance.default_stream(fields).alias("d")).collect()
    assert [(r.title, r.d.reason) for r in found if r.d.reason != r.expected] == []
    assert all(r.d.accepted == (r.d.reason == "family_neutral" or r.d.reason.endswith("title_subject_and_event")) for r in found)
    assert {s.reason for s in relevance.STEPS} == {r[5] for r in STREAM} - {"family_neutral"}


def halved(days, first, last, bound, least):
    """Ranges by recursion."""
    n = sum(first <= d <= last for d in days)
    span = (last - first).days
    if n <= bound or span <= max(1, least):
        return [(first, last, n)]
    middle = first + timedelta(span // 2)
    return halved(days, first, middle, bound, least) + halved(days, middle + timedelta(1), last, bound, least)


@pytest.mark.parametrize(("bound", "least"), [(1000, 7), (40, 7), (3, 1), (3, 0), (1, 30)])
def test_ranges_against_recursion(spark, bound, least):
    rng = random.Random(bound)
    first, last = date(2023, 1, 5), date(2024, 3, 1)
    days = [first + timedelta(int(rng.triangular(-10, 440, 60))) for _ in range(300)] + [date(2023, 6, 1)] * 30
    rows = spark.createDataFrame([(d,) for d in days] + [(None,)], "pubDate date").withColumn("pubDate", F.col("pubDate").cast("timestamp"))
    out = ranges.day_ranges(rows, "pubDate", str(first), str(last), bound, least)
    found = {(r.lo, r.hi, r.n) for r in out.select("lo", "hi", "n").distinct().collect()}
    assert found == {r for r in halved(days, first, last, bound, least) if r[2]}
    assert out.where("day not between lo and hi or over != (n > %d)" % bound).count() == 0


def test_complete_keeps_every_candidate_once(spark):
    said = [(k, str(k % 70) if k % 3 else " ", f"2024-01-{1 + k % 28:02d} 05:00:00") for k in range(300)] + [(None, None, "2024-01-02 00:00:00"), (400, "z", None)]
    rows = spark.createDataFrame(said, "id bigint, canonicalLink string, pubDate string").withColumn("pubDate", F.col("pubDate").cast("timestamp")).withColumn("createdAt", F.col("pubDate"))
    out = ranges.complete(rows, "2024-01-01", "2024-01-31", 40, 1)
    keys = [f"canonical:{c}" if c and c.strip() else f"id:{k}" for k, c, t in said if t and (k is not None or c)]
    assert sorted(r.key for r in out.collect()) == sorted(set(keys))
    assert out.where("over").count() == 0
    ranges.require_complete(out)
    with pytest.raises(SnapshotError, match="source_limit"):
        ranges.require_complete(ranges.complete(rows, "2024-01-01", "2024-01-31", 5, 1))
    assert ranges.complete(rows.limit(0), "2024-01-01", "2024-01-31", 5).count() == 0
