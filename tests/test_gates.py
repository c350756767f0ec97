"""Gates, interests, event conflicts, catalog imports and article rows: reasons and edge cases that the queries don't reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlens.operators import gates, interests, matching, merge, projections, rules


def test_discovery_feeds(spark):
    alert = "https://www.google.com/alerts/feeds/1"
    said = [
        ("OVD", alert, "New OVD", "An optical variable device for a passport.", "ovd_document_security_context"), ("ovd", alert, "OVD units sent", "A fire.", "ovd_missing_document_security_context"),
        ("Security features", alert, "Security ink", "For document security.", "security_features_document_security_context"), ("Security features", alert, "Bank of Ghana acts", "A banknote was issued.", "security_features_document_security_context"),
        ("Security features", alert, "Phone", "Security features of a phone.", "security_features_missing_document_security_context"), ("Banknotes", alert, "New banknotes", "A polymer series.", "banknotes_concrete_context"),
        ("Banknotes", alert, "Nothing", "A polymer banknotes series.", "banknotes_missing_concrete_context"), ("Passports", alert, "x", "Passports were forged.", "passports_concrete_context"),
        ("Passports", alert, "x", "A passport to happiness.", "passports_missing_concrete_context"), ("Passports", "https://a.com/x", "x", "", "discovery_feed_quality_not_applicable"), ("Other", alert, "x", "", "discovery_feed_quality_not_applicable"),
        (None, None, None, None, "discovery_feed_quality_not_applicable"),
    ]
    rows = spark.createDataFrame(said, "name string, url string, title string, body string, expected string")
    d = gates.discovery_quality(F.col("name"), F.col("url"), F.col("title"), F.concat_ws(" ", "title", "body"))
    assert [(r.title, r.d.reason) for r in rows.select("*", d.alias("d")).collect() if r.d.reason != r.expected] == []


def test_evidence_reads_dashes_as_blanks(spark):
    text = gates.evidence_text(F.lit("Post-Quantum"), F.lit("OpenID / e_id"))
    found = spark.range(1).select(gates.profile_evidence("identity_verification", text).alias("e"), gates.profile_evidence("researcher", text).alias("r")).first()
    assert found.e.passed and found.e.anchors == ["openid"] and found.e.events == ["post-quantum"] and not found.r.passed


def test_trade_site_and_vehicle_noise(spark):
    at = "https://www.identityweek.net/a"
    said = [(at, "Join the keynote", "biometrics"), (at, "JP Morgan speaks", "kyc"), (at, "News", "weather"), (at, "News", "Liveness check"), ("https://a.com", "Join the", ""), (None, None, None)]
    rows = spark.createDataFrame(said, "link string, title string, text string")
    found = rows.select(gates.identity_week(F.lit(True), F.col("link"), F.col("title"), F.col("text"))["reason"].alias("r")).collect()
    assert [r.r.removeprefix("identity_week_") for r in found] == ["event_or_generic_corporate_noise"] * 2 + ["missing_verification_focus", "verification_focus", "quality_not_applicable", "quality_not_applicable"]
    assert spark.range(1).select(gates.vehicle_noise(F.lit("The Honda Passport SUV")), gates.vehicle_noise(F.lit("Honda factory and a passport office")), gates.vehicle_noise(F.lit(None))).first()[:] == (True, False, False)


def test_interest_scores(spark):
    terms = spark.createDataFrame(interests.parsed("passports | strong: new passport | negative: honda passport | intent_negative: ranking, visa-free\nvisas | strong: evisa | medium: visa | weak: c++"), "interest string, kind string, term string")
    rows = spark.createDataFrame([
        ("a", "A new passport", "", "", "", "Ministry"), ("b", "Passport ranking: visa-free and new passport", "", "", "", ""), ("c", "eVisa", "visa", "", "evisa", "a blog"), ("d", None, None, None, None, None), ("e", "about C++ only", "", "", "", ""),
    ], "id string, title string, tags string, meta string, body string, sourceText string").withColumn("pubDate", F.when(F.col("id") != "d", F.lit("2024-12-01").cast("timestamp")))
    found = {(r.id, r.interest): r for r in interests.scored(rows, terms, F.lit("2024-12-31").cast("timestamp")).collect()}
    assert len(found) == 5 * len(interests.SHARES)
    a, b, c, d, e = (found[k] for k in (("a", "passports"), ("b", "passports"), ("c", "visas"), ("d", "passports"), ("e", "visas")))
    assert round(a.core, 6) == round(1.1 * (16 + 21), 6) and a.included and a.direct
    assert b.core == 1.1 * 16 - 40 - 500 and b.score == 0 and b.penalty > 500 and not b.included
    assert round(c.core, 6) == round(0.9 * (16 + 6 + 6), 6) and c.score == -35 + 125 + 25
    assert d.core == 0 and d.score == 0 and not d.included and round(e.core, 6) == 3.6


def test_conflicts_keep_pairs_apart(spark):
    base = {"title": "t", "summary": "", "pubDate": "2024-01-01", "domain": "banknote", "topicFamily": "f", "canonicalEventType": "banknote_redesign", "country": "Ghana", "primaryEntity": "", "authority": "", "grouped": True, "confidence": "high"}
    events = spark.createDataFrame([base | {"id": k, "identityEventKey": f"k{k}", "excluded": k == 4} for k in range(1, 6)]).withColumns({"pubDate": F.col("pubDate").cast("timestamp"), "systems": F.array().cast("array<string>")})
    conflicts = spark.createDataFrame([(3, 1), (1, 3), (None, 2), (5, 9)], "a bigint, b bigint")
    kept = {(r.a, r.b) for r in matching.event_pairs(events, conflicts).where("reason like 'high%'").collect()}
    assert kept == {(1, 2), (2, 3), (1, 5), (2, 5), (3, 5)}
    assert {r.reason for r in matching.event_pairs(events, conflicts).where("a = 4 or b = 4 or (a = 1 and b = 3)").collect()} == {"existing_conflict_or_exclusion"}
    given = matching.decided(spark.createDataFrame([(3, 1), (1, 2), (1, 77)], "a bigint, b bigint"), events, conflicts)
    assert {(r.a, r.b, r.reason) for r in given.collect()} == {(3, 1, "existing_conflict_or_exclusion"), (1, 2, "high_confidence_entity_or_country")}


def test_catalog_entries_are_imported_once(spark):
    catalog = spark.createDataFrame([(1, "a", "rss", "u1"), (2, "b", " RSS", " u1 "), (3, "c", "link", "u2"), (4, "d", "rss", None), (5, "e", None, "u3"), (6, "f", "rss", "there")], "n int, name string, mode string, url string")
    feeds = spark.createDataFrame([("there",), (None,)], "rssUrl string")
    assert [r.outcome for r in merge.catalog_import(catalog, feeds).orderBy("n").collect()] == ["imported", "existing", "not_rss", "no_url", "not_rss", "existing"]


def test_legacy_feeds_by_entry_path_or_name(spark):
    feeds = spark.createDataFrame([("1", "x", "https://proxy.a/dmv/on"), ("2", "x", "https://proxy.a/dmv/ny"), ("3", "Yukon", "https://proxy.a/q"), ("4", "Yukon", "https://b.c/q"), ("5", "Ontario", "https://proxy.a/dmv/ny"), ("6", None, None)], "id string, name string, rssUrl string")
    catalog = spark.createDataFrame([("Canada", "", "/DMV/on"), ("us", None, "/dmv/ny")], "region string, url string, path string")
    assert {r.id for r in merge.legacy_feeds(feeds, catalog, "proxy.a/", "canada", ("yukon", "ontario")).collect()} == {"1", "3"}


def test_article_rows_and_dtos(spark):
    kind = "title string, link string, description string, source string, tags array<string>, topic string, feedName string"
    items = spark.createDataFrame([("<b>New</b> banknotes", "https://www.a.com/1?utm_source=x", "Banknotes &amp; coins. More.", "", ["currency", "T"], "", ""), (None, "https://b.com", None, "S", None, "", "Notafilia"), ("x", " ", "", "", None, "", "")], kind)
    rows = {r.link: r for r in projections.article_rows(items).collect()}
    assert len(rows) == 2
    one, two = rows["https://www.a.com/1?utm_source=x"], rows["https://b.com"]
    assert (one.title, one.source, one.summaryShort, one.canonicalLink) == ("New banknotes", "a.com", "Banknotes & coins.", "https://a.com/1")
    assert one.keywords[:3] == ["currency", "T", "banknote"] and one.domains == ["banknotes"] and one.topic == "Banknotes"
    assert (two.title, two.source, two.summaryShort) == ("Untitled Article", "S", "Untitled Article")
    articles = spark.createDataFrame([("1", "t", "https://a.com/x", "/c", None, None, None)], "id string, title string, link string, canonicalLink string, thumbnail string, topic string, contentSnippet string").withColumn("source", F.lit("s"))
    dto = projections.article_dto(articles, F.array(F.lit("researcher"))).first()
    assert (dto.canonicalLink, dto.thumbnail, dto.topic, dto.tags) == ("https://a.com/c", "placeholder", "General", [])
    assert {d.profile: d.reason for d in dto.profileDecisions}["researcher"] == "article_industry_evidence_missing" and len(dto.profileDecisions) == len(rules.PROFILES)


def test_keywords_by_count_then_place(spark):
    from feedlens.functions.text import inferred_keywords

    said = "beta alpha beta alphabet gamma alphabet delta ab " + " ".join(f"word{k}" for k in range(50))
    assert spark.range(1).select(inferred_keywords(F.lit(said), 4), inferred_keywords(F.lit(""), 3), inferred_keywords(F.lit(None).cast("string"), 3)).first()[:2] == (["beta", "alphabet", "alpha", "gamma"], [])


def test_feedback_input(spark):
    rows = spark.createDataFrame([("1", " c ", "spam", "x" * 200, [" a", "", None] + ["i"] * 70), ("1", "c" * 161, "spam", None, None), ("", "c", "spam", None, None), ("1", "c", "other", None, None), (None, None, None, None, None)], "articleId string, clientId string, reason string, context string, interests array<string>")
    v = [r.v for r in rows.select(rules.feedback_input(("spam",)).alias("v")).collect()]
    assert [x.valid for x in v] == [True, False, False, False, False] and len(v[0].context) == 160 and len(v[0].interests) == 60 and v[1].interests == []


def test_subgroups_direct_hybrid_and_doubts(spark):
    from feedlens.operators import subgroups

    table = "substrates | strong: polymer note | weak: polymer | related: production\novd | strong: hologram | weak: optical | related: security device\nsecure_documents | strong: secure document | weak: permit | related: border"
    rows = spark.createDataFrame([
        ("a", "A polymer note", "", "", ""), ("b", "production", "", "", ""), ("c", "security device", "", "", ""), ("d", "permit", "permit", "permit", "permit"), ("e", "polymer note hologram", "hologram", "hologram", "hologram"), ("f", None, None, None, None),
    ], "id string, title string, tags string, meta string, body string")
    domain = rows.select("id", F.when(F.col("id").isin("b", "c", "d"), 40).otherwise(F.when(F.col("id") == "f", 0).otherwise(10)).alias("production"), F.lit(0).alias("excluded"))
    found = {(r.id, r.subgroup): r for r in subgroups.assessed(rows, subgroups.term_table(spark, table), domain).collect()}
    assert len(found) == 18 and found["a", "substrates"].direct and not found["a", "ovd"].included
    assert found["b", "substrates"].hybrid and not found["b", "substrates"].direct and found["b", "substrates"].doubt == ""
    assert found["c", "ovd"].hybrid and found["c", "ovd"].doubt == "generic_security_device_only"
    assert found["d", "secure_documents"].direct and found["d", "secure_documents"].doubt == "generic_document_security_only"
    assert not any(found["f", s].included for s in ("substrates", "ovd", "secure_documents"))
    total = {r.subgroup: (r.total, r.direct, r.hybrid, r.overlap) for r in subgroups.subgroup_summary(subgroups.assessed(rows, subgroups.term_table(spark, table), domain)).collect()}
    assert total == {"substrates": (3, 2, 1, 1), "ovd": (2, 1, 1, 1), "secure_documents": (1, 1, 0, 0)}


def test_actions_by_counts(spark):
    from feedlens.operators import subgroups

    said = [(2, 0, 0, 1, "keep_as_kyc"), (1, 0, 2, 0, "keep_as_kyc"), (1, 0, 3, 0, "ambiguous_keep_for_now"), (0, 1, 2, 0, "demote_from_kyc"), (0, 1, 0, 2, "demote_from_kyc"), (0, 1, 1, 1, "require_stronger_kyc_evidence"), (0, 0, 2, 0, "demote_from_kyc"), (0, 0, 0, 0, "ambiguous_keep_for_now")]
    rows = spark.createDataFrame(said, "s int, w int, i int, a int, x string")
    assert rows.where(subgroups.kyc_action(*[F.col(c) for c in "swia"]) != F.col("x")).count() == 0
    said = [
        (2, 0, 0, 0, 0, 0, 0, "Genuine Passport Article"), (2, 0, 0, 1, 0, 0, 0, "Passport-heavy but multi-category"), (0, 0, 0, 0, 2, 0, 0, "Generic Identity Document Article"), (0, 0, 0, 0, 0, 0, 2, "Identity Verification Article"),
        (0, 1, 0, 0, 0, 2, 2, "Border Control Article"), (0, 0, 1, 0, 0, 0, 1, "Likely Passport False Positive"), (0, 1, 0, 1, 0, 0, 0, "Generic Identity Document Article"), (0, 1, 1, 0, 0, 0, 0, "Passport-heavy but multi-category"),
    ]
    rows = spark.createDataFrame(said, "s int, m int, w int, c int, r int, b int, v int, x string")
    assert rows.where(subgroups.passport_class(*[F.col(c) for c in "smwcrbv"]) != F.col("x")).count() == 0
