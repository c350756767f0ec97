"""Scores of interests: weighted terms by profile and kind, intent, authority of the source, recency, and a penalty for a better
fitting interest.

Terms are a table (interest, kind, term). They are looked up in each article by its own words, so that texts stay where they
are; what moves is one row for each article and term found, with its count of fields, which then meets the weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlens.operators.rules import bound
from feedlens.operators.source_rules import term_regex

FIELDS = ("title", "tags", "meta", "body")
#: Points of a term by kind and field; intents count once, wherever they are said.
WEIGHTS = {
    "strong": (16, 9, 8, 6), "medium": (10, 6, 5, 3), "weak": (4, 2, 2, 1), "negative": (-18, -10, -8, -6),
}
INTENT = {"intent_strong": 15, "intent_weak": 4, "intent_negative": -20}
#: How much of a profile's points an interest takes.
SHARES = {"passports": 1.1, "residence_permits": 1.15, "visas": 0.9, "border_control": 1.2}
AUTHORITY = {"very_high": 120, "high": 60, "medium": 12, "none": 0, "low": -35, "very_low": -80}
LEAST = 18
#: Authored terms, in the form of a production table.
TERMS = """
passports | strong: biometric passport, passport issuance, passport redesign, passport security | medium: passport, passports, travel document | weak: data page, chip | negative: honda passport, passport ranking, travel advice | intent_strong: new passport design, passport page | intent_weak: launches, unveiled | intent_negative: visa-free, summer travel
residence_permits | strong: residence permit, residence permits, residence card | medium: permit card, long-term residence | weak: migration, migration office | negative: parking permit, building permit | intent_strong: residence permit design | intent_weak: introduces | intent_negative: permit fees, how to apply
visas | strong: visa sticker, evisa, visa document | medium: visa, visas, consular | weak: embassy | negative: visa infinite, credit card, visa-free | intent_strong: electronic visa | intent_weak: launches, rollout | intent_negative: wallet offer, travel advice
border_control | strong: border control, entry exit system, egate | medium: border, frontex, customs | weak: airport, deploys | negative: border collie, cross-border payment | intent_strong: border control authority | intent_weak: deploys | intent_negative: tourism, holiday
"""
SOURCES = """
very_high: bundesdruckerei, icao | high: passport office, ministry | low: blog, forum | very_low: casino, coupons | medium: news
"""


def parsed(text: str) -> list[tuple[str, str, str]]:
    """Rows (interest, kind, term) of terms written as above."""
    out = []
    for line in text.strip().split("\n"):
        interest, *kinds = [x.strip() for x in line.split(" | ")]
        for entry in kinds:
            kind, _, terms = entry.partition(": ")
            out += [(interest, kind, t.strip()) for t in terms.split(", ")]
    return out


def term_table(spark: SparkSession, text: str = TERMS) -> DataFrame:
    return spark.createDataFrame(parsed(text), "interest string, kind string, term string")


def found_terms(articles: DataFrame, terms: DataFrame) -> DataFrame:
    """id, term and, for each field, whether it says the term: a row for each article and distinct term that occurs."""
    every = terms.select(F.lower(F.trim("term")).alias("t")).where("t != ''").distinct()
    listed = every.select("t", F.regexp_extract("t", "^[a-z0-9]*", 0).alias("first")).agg(F.collect_list(F.struct("t", "first")).alias("terms"))  # one row
    fields = [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f) for f in FIELDS]
    rows = articles.select("id", *fields).crossJoin(listed)

    def said(x: Column) -> Column:
        tried = F.filter(x["terms"], lambda t: (t["first"] == "") | F.array_contains(x["known"], t["first"]))
        hits = F.transform(tried, lambda t: F.struct(t["t"].alias("term"), *[F.rlike(x[f], term_regex(t["t"])).alias(f) for f in FIELDS]))
        return F.filter(hits, lambda h: h["title"] | h["tags"] | h["meta"] | h["body"])

    words = F.array_distinct(F.split(F.concat_ws(" ", *FIELDS), "[^a-z0-9]+"))
    known = F.array_intersect(words, F.transform("terms", lambda t: t["first"]))
    return rows.select("id", F.explode(bound(F.struct(*FIELDS, "terms", known.alias("known")), said)).alias("h")).select("id", "h.*")


def recency(published: Column, as_of: Column) -> Column:
    """Points by age; an article without a date is taken for an old one."""
    age = (F.unix_seconds(as_of) - F.unix_seconds(published)) / 86400
    return F.when(age.isNull(), -45).when(age <= 30, 125).when(age <= 90, 70).when(age <= 180, 30).when(age > 365 * 5, -260).when(age > 365 * 3, -180).when(age > 365, -90).otherwise(0)


def authority(text: Column, sources: str = SOURCES) -> Column:
    """The level of the first kind, in the table's order, of which a term occurs in what names the source."""
    out = None
    for entry in sources.strip().split(" | "):
        level, _, terms = entry.partition(": ")
        said = F.exists(F.array(*[F.lit(t.strip()) for t in terms.split(", ")]), lambda t: F.rlike(F.lower(text), term_regex(t)))
        out = F.when(said, level) if out is None else out.when(said, level)
    return out.otherwise("none")


def scored(articles: DataFrame, terms: DataFrame, as_of: Column) -> DataFrame:
    """articles (id, title, tags, meta, body, sourceText, pubDate) to a row for each id and interest: core, penalty, score, strong (how
    many strong terms), direct, included.

    core: shares of a profile's points, with a third of a good source's authority, and intent, where two negatives rule an
    article out. penalty: by how much another interest's core is larger. score adds authority and recency, and is at least 0.
    Null texts are empty; equal terms of one interest and kind count once; ids are one article each.
    """
    spark = articles.sparkSession
    points = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    intents = F.create_map(*[x for k, v in INTENT.items() for x in (F.lit(k), F.lit(v))])
    met = found_terms(articles, terms).join(terms.select("interest", "kind", F.lower(F.trim("term")).alias("term")).distinct(), "term")
    weight = sum((F.when(F.col(f), F.coalesce(F.get(points[F.col("kind")], F.lit(k)), F.lit(0))).otherwise(0) for k, f in enumerate(FIELDS)), F.lit(0))
    sums = met.groupBy("id", "interest").agg(
        F.sum(weight).alias("profile"), F.sum(F.coalesce(intents[F.col("kind")], F.lit(0))).alias("intent"), F.count_if(F.col("kind") == "intent_negative").alias("negatives"),
        F.count_if(F.col("kind").isin("strong", "intent_strong")).alias("strong"), F.bool_or(F.col("kind").isin("medium", "intent_weak", "weak")).alias("some"),
    )
    interests = spark.createDataFrame(list(SHARES.items()), "interest string, share double")
    boost = F.create_map(*[x for k, v in AUTHORITY.items() for x in (F.lit(k), F.lit(v))])[authority(F.coalesce("sourceText", F.lit("")))]
    base = articles.select("id", boost.alias("boost"), recency(F.col("pubDate"), as_of).alias("recent")).crossJoin(F.broadcast(interests))
    rows = base.join(sums, ["id", "interest"], "left").fillna(0, ["profile", "intent", "negatives", "strong"]).fillna(False, ["some"]).withColumn("direct", F.col("strong") > 0)
    own = F.col("share") * (F.col("profile") + F.greatest(F.lit(0.0), F.col("boost") * 0.35)) + F.col("intent") - F.when(F.col("negatives") >= 2, 500).otherwise(0)
    by_id = Window.partitionBy("id")
    ranked = rows.withColumn("core", own).withColumn("tops", F.slice(F.sort_array(F.collect_list("core").over(by_id), asc=False), 1, 2))
    best_other = F.when(F.col("core") == F.get("tops", F.lit(0)), F.get("tops", F.lit(1))).otherwise(F.get("tops", F.lit(0)))
    penalty = F.greatest(F.lit(0.0), F.coalesce(best_other, F.lit(0.0)) - F.col("core"))
    rounded = lambda x: F.floor(x + 0.5)
    score = F.greatest(F.lit(0), F.col("boost") + F.col("recent") + F.greatest(F.lit(-120), rounded(F.col("core"))) - F.least(F.lit(110), rounded(F.col("penalty"))))
    out = ranked.withColumn("penalty", penalty).withColumn("score", score)
    return out.select("id", "interest", "core", "penalty", "score", "strong", "direct", ((F.col("score") >= LEAST) & (F.col("direct") | F.col("some"))).alias("included"))
