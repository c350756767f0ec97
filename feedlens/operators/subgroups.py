"""Scored diagnostics: weighted domains, subgroups with the reasons for doubting them, and cascades over counts of evidence.

All of them count the terms of a table (owner, kind, term) that an article says, by field, with interests.found_terms().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlens.operators.interests import FIELDS, found_terms, parsed
from feedlens.operators.rules import cascade

#: Points of a term by kind and field: of a domain, and of a subgroup.
DOMAIN_WEIGHTS = {"strong": (5, 4, 3.5, 1.25), "weak": (2, 1.5, 1.25, 0.35)}
SUBGROUP_WEIGHTS = {"strong": (5.5, 4.5, 3.5, 1.5), "weak": (1.5, 1.5, 1, 0.35)}
DOMAIN_LEAST, SUBGROUP_LEAST = 7, 18
#: Authored terms, in the form of production tables.
DOMAINS = """
banknotes | strong: banknote, banknotes, polymer, note series | weak: central bank, currency, series, thread | excluded: auction, collector
identity_documents | strong: passport, id card, residence permit, driving licence | weak: document, page, issued, border | excluded: visa-free, credit card
digital_identity_biometrics | strong: biometric, digital identity, identity verification | weak: wallet, platform, licence | excluded: job, login portal
security_printing | strong: security printing, security thread, optically variable | weak: ink, printing, polycarbonate, security features | signal_strong: optically variable, security thread | signal_medium: polycarbonate, printing works | support: passport, banknote, production, contract | negative_tech: developer, samsung | excluded: weather
"""
SUBGROUPS = """
substrates | strong: polymer banknote, polycarbonate page | weak: polymer, polycarbonate, page | related: passport, production
inks_threads | strong: optically variable ink, security thread | weak: ink, thread | related: printing, banknote
ovd | strong: hologram, holographic | weak: optical | related: security device, security features, optically variable
secure_documents | strong: secure document, document security | weak: id card, permit, document | related: redesign, border
"""
KYC = """
kyc | strong: know your customer, customer due diligence, kyc compliance | weak: kyc, onboarding, verification | idv: identity verification, digital identity, biometric, identity | auth: login, authentication, login portal, password
"""
PASSPORTS = """
passports | strong: biometric passport, passport issuance, passport page | medium: passport, passports | weak: travel, visa-free | id_card: id card, national id card | residence: residence permit, permit design | border: border, entry exit, border control | idv: identity verification, digital identity
"""


def term_table(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parsed(text), "owner string, kind string, term string")


def evidence(articles: DataFrame, terms: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """A row for each article (id, title, tags, meta, body) and owner: for each kind a column struct<n, title, tags, meta, body,
    terms> of the distinct terms said, of those in each field, and which."""
    owners = terms.select("owner").distinct()
    said = found_terms(articles, terms).join(terms.select("owner", "kind", F.lower(F.trim("term")).alias("term")).distinct(), "term")
    each = []
    for k in kinds:
        here = F.col("kind") == k
        counts = [F.count_if(here).alias("n"), *[F.count_if(here & F.col(f)).alias(f) for f in FIELDS]]
        each.append(F.struct(*counts, F.sort_array(F.collect_set(F.when(here, F.col("term")))).alias("terms")).alias(k))
    found = said.groupBy("id", "owner").agg(*each)
    none = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("n", *FIELDS)], F.array().cast("array<string>").alias("terms"))
    every = articles.select("id").crossJoin(F.broadcast(owners)).join(found, ["id", "owner"], "left")
    return every.select("id", "owner", *[F.coalesce(k, none).alias(k) for k in kinds])


def _points(weights: dict[str, tuple]) -> Column:
    return sum((F.col(kind)[f] * float(w) for kind, ws in weights.items() for f, w in zip(FIELDS, ws, strict=True)), F.lit(0.0))


def _rounded(x: Column) -> Column:
    return F.floor(x + 0.5)


def domain_scores(articles: DataFrame, terms: DataFrame, boosted: Column | None = None) -> DataFrame:
    """id, owner (the domain), score, production, excluded, included: points by field; production adds, for articles that are
    `boosted`, four points and what signals with support earn, less technical terms that speak against it."""
    rows = evidence(articles, terms, ("strong", "weak", "excluded", "signal_strong", "signal_medium", "support", "negative_tech"))
    n = lambda k: F.col(k)["n"]
    if boosted is not None:
        rows = rows.join(articles.select("id", F.coalesce(boosted, F.lit(False)).alias("boosted")), "id")
    held = F.col("boosted") if boosted is not None else F.lit(False)
    some = n("support") > 0
    earned = (
        F.when((n("signal_strong") > 0) & some, 6 + n("signal_strong") * 4).otherwise(0) + F.when((n("signal_medium") > 0) & some, 3 + n("signal_medium") * 3).otherwise(0)
        + F.when((n("signal_strong") + n("signal_medium") >= 2) & some, 5).otherwise(0) + F.when((n("support") >= 2) & (n("signal_strong") + n("signal_medium") > 0), 4).otherwise(0)
        - F.when(n("negative_tech") > 0, F.when(some, 6).otherwise(14)).otherwise(0)
    )
    score = _points(DOMAIN_WEIGHTS) + F.when(held, 4).otherwise(0)
    excluded = F.col("excluded")["title"] + F.col("excluded")["tags"] + F.col("excluded")["meta"]
    rows = rows.select("id", "owner", score.alias("score"), _rounded(score + F.when(held, earned).otherwise(0)).alias("production"), excluded.alias("excluded"))
    return rows.withColumn("included", F.col("production") >= DOMAIN_LEAST)


def dominant_domain(scores: DataFrame, least: float = 8, margin: float = 2, clear: float = 14) -> DataFrame:
    """id and dominant: the domain of the largest score, if it reaches `least` and leads by `margin` or is `clear`; ties by name."""
    by = Window.partitionBy("id").orderBy(F.desc("score"), "owner")
    top = scores.select("id", "owner", "score", F.lead("score", 1, 0.0).over(by).alias("next"), F.row_number().over(by).alias("r")).where("r = 1")
    good = (F.col("score") >= least) & ((F.col("score") - F.col("next") >= margin) | (F.col("score") >= clear))
    return top.select("id", F.when(good, F.col("owner")).alias("dominant"))


def assessed(articles: DataFrame, terms: DataFrame, domain: DataFrame) -> DataFrame:
    """id, subgroup, score, direct, hybrid, included, doubt: subgroups by their terms and a domain's (id, production, excluded).

    direct: a strong term, or a weak one with a score that suffices; hybrid: without that, a domain's article with such a score
    and a weak or related term. doubt: why an included article probably isn't the subgroup's; empty if nothing says so.
    """
    rows = evidence(articles, terms, ("strong", "weak", "related")).join(domain.select("id", "production", "excluded"), "id")
    n = lambda k: F.col(k)["n"]
    score = F.greatest(F.lit(0), _rounded(F.col("production") * 0.65 + _points(SUBGROUP_WEIGHTS) - F.col("excluded") * 10))
    rows = rows.withColumn("score", score).withColumn("direct", (n("strong") > 0) | ((n("weak") > 0) & (F.col("score") >= SUBGROUP_LEAST)))
    hybrid = ~F.col("direct") & (F.col("production") >= DOMAIN_LEAST) & (F.col("score") >= SUBGROUP_LEAST) & ((n("weak") > 0) | (n("related") > 0))
    rows = rows.withColumn("hybrid", hybrid).withColumn("included", F.col("direct") | F.col("hybrid")).withColumn("weight", n("strong") * 4 + n("related") * 2 + n("weak"))
    mine = F.struct("score", F.col("owner").alias("name"), "weight")
    others = F.filter(F.collect_list(F.when(F.col("included"), mine)).over(Window.partitionBy("id")), lambda o: o["name"] != F.col("owner"))
    best = F.get(F.array_sort(F.transform(others, lambda o: F.struct((-o["score"]).alias("s"), o["name"].alias("name"), o["weight"].alias("weight")))), F.lit(0))
    rows = rows.withColumn("best", best)
    doubt = cascade(
        (~F.col("included"), True, ""),
        (~F.col("direct") & (n("weak") == 0) & (n("related") == 0), True, "no_subgroup_specific_evidence"),
        ((-F.col("best.s") >= F.col("score") + 30) & (F.col("best.weight") >= F.col("weight") + 2), True, F.concat(F.lit("looks_more_like_"), F.col("best.name"))),
        ((F.col("owner") == "ovd") & (n("strong") == 0) & F.array_contains(F.col("related")["terms"], "security device"), True, "generic_security_device_only"),
        ((F.col("owner") == "secure_documents") & (n("strong") == 0) & (n("weak") > 0), True, "generic_document_security_only"), accept="",
    )
    return rows.select("id", F.col("owner").alias("subgroup"), "score", "direct", "hybrid", "included", doubt["reason"].alias("doubt"))


def subgroup_summary(found: DataFrame) -> DataFrame:
    """For each subgroup its articles, those found directly or by hybrid evidence, shared with another subgroup, and doubted."""
    rows = found.where("included").withColumn("k", F.count("*").over(Window.partitionBy("id")))
    return rows.groupBy("subgroup").agg(
        F.count("*").alias("total"), F.count_if("direct").alias("direct"), F.count_if("hybrid").alias("hybrid"), F.count_if(F.col("k") > 1).alias("overlap"), F.count_if(F.col("doubt") != "").alias("likely_false_positives")
    )


def overlap_class(scores: DataFrame, heavy: dict[str, str], bridged: Column, lead: int = 80) -> DataFrame:
    """id and classification of articles that several interests include (id, interest, score, included, strong): of the leading
    one's name in `heavy` if it leads by far on two strong terms or more, else a legitimate overlap where `bridged`, or ambiguous."""
    by = Window.partitionBy("id").orderBy(F.desc("score"), "interest")
    rows = scores.where("included").select("*", bridged.alias("_b"), F.row_number().over(by).alias("r"), F.lead("score").over(by).alias("next"), F.count("*").over(Window.partitionBy("id")).alias("k"))
    top = rows.withColumn("any", F.bool_or("_b").over(Window.partitionBy("id"))).where("r = 1 and k > 1")
    names = F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair])[F.col("interest")]
    far = (F.col("score") >= F.col("next") + lead) & (F.col("strong") >= 2) & names.isNotNull()
    return top.select("id", F.when(far, names).when(F.col("any"), "Legitimate overlap").otherwise("Ambiguous").alias("classification"))


def kyc_action(strong: Column, weak: Column, idv: Column, auth: Column) -> Column:
    """What to do with an article listed under customer checks, by its counts of evidence."""
    none = strong == 0
    return (
        F.when((strong >= 2) | ((strong >= 1) & (idv <= strong + 1) & (auth == 0)), "keep_as_kyc").when(none & (weak > 0) & ((idv >= 2) | (auth >= 2)), "demote_from_kyc")
        .when(none & (weak > 0), "require_stronger_kyc_evidence").when(none & ((idv >= 2) | (auth >= 2)), "demote_from_kyc").otherwise("ambiguous_keep_for_now")
    )


def passport_class(strong: Column, medium: Column, weak: Column, id_card: Column, residence: Column, border: Column, idv: Column) -> Column:
    """What an article listed under passports is about, by its counts of evidence."""
    none, rivals = strong == 0, (id_card > 0) | (residence > 0)
    mixed = "Passport-heavy but multi-category"
    return (
        F.when((strong >= 2) & ~rivals & (border == 0) & (idv == 0), "Genuine Passport Article").when((strong >= 1) & (rivals | (border > 0)), mixed)
        .when((residence >= 2) & none, "Generic Identity Document Article").when((idv >= 2) & none & (medium == 0), "Identity Verification Article").when((border >= 2) & none, "Border Control Article")
        .when(none & (medium == 0) & (weak > 0), "Likely Passport False Positive").when(none & rivals, "Generic Identity Document Article").otherwise(mixed)
    )
