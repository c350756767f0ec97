"""Rule engines as generated expressions: classification, relevance gates, profile decisions, scored assessments.

Rules are data. Each engine compiles a rule table into columns, so that a cascade is one when() chain, a score one sum,
and Catalyst evaluates them beside the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.functions.text import has_term, words_of
from feedlens.operators.filters import any_of


@dataclass(frozen=True)
class ClassRule:
    id: str
    topic: str
    domain: str
    signal: str
    terms: tuple[str, ...]
    #: term -> terms of which one must occur too
    conditional: dict[str, tuple[str, ...]] | None = None
    source_terms: tuple[str, ...] = ()
    least: int = 1
    #: The signal counts only with one of these in the title, or of the next in the content.
    signal_title: tuple[str, ...] = ()
    signal_content: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    #: An article with one of these keywords has the domain, whatever its text says.
    keywords: tuple[str, ...] = ()


#: A small authored table of the monitor's ten classes; production tables are passed in the same form.
CLASSES = (
    ClassRule("banknotes", "Banknotes", "banknotes", "central_bank", ("banknote", "banknotes", "currency note", "polymer note", "note series"), source_terms=("banknotenews",), tags=("banknote", "currency"), keywords=("banknotes", "currency")),
    ClassRule("border_control", "Identity Documents", "identity_documents", "border_control", ("border control", "entry exit system", "egate", "port of entry"), signal_title=("border", "entry exit"), signal_content=("border control authority",)),
    ClassRule("identity_documents", "Identity Documents", "identity_documents", "passport_authority", ("identity document", "travel document", "residence permit")),
    ClassRule("passports", "Identity Documents", "identity_documents", "passport_authority", ("passport", "passports", "epassport"), tags=("passport",), keywords=("passports",)),
    ClassRule("id_cards", "Identity Documents", "identity_documents", "passport_authority", ("id card", "identity card", "national id"), least=1),
    ClassRule("visas", "Identity Documents", "identity_documents", "passport_authority", ("visa sticker", "evisa"), conditional={"visa": ("consular", "embassy", "immigration")}),
    ClassRule("biometrics", "Digital Identity & Biometrics", "digital_identity_biometrics", "identity_verification", ("biometric", "biometrics", "fingerprint", "facial recognition"), tags=("biometrics",), keywords=("biometrics",)),
    ClassRule("digital_identity", "Digital Identity & Biometrics", "digital_identity_biometrics", "identity_verification", ("digital identity", "identity wallet", "mobile licence", "eid")),
    ClassRule("identity_verification", "Digital Identity & Biometrics", "digital_identity_biometrics", "identity_verification", ("identity verification", "kyc", "document verification")),
    ClassRule("security_features", "Shared Security Printing", "security_printing", "security_printer", ("security thread", "optically variable", "hologram", "security printing", "security features", "polycarbonate")),
)


def _count(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, 1).otherwise(0) for c in conditions], F.lit(0))


def rule_score(rule: ClassRule, text: Column, local: Column, source: Column, words: Column | None = None) -> Column:
    """Distinct terms of the content, conditional terms that are corroborated, and source terms; 0 under the least."""
    content = _count([has_term(text, t, words=words) for t in rule.terms] + [has_term(local, t, words=words) & any_of([has_term(local, c, words=words) for c in with_any]) for t, with_any in (rule.conditional or {}).items()])
    from_source = _count([has_term(source, t) for t in rule.source_terms])
    if not rule.source_terms and rule.least <= 1:
        return content
    enough = lambda n: F.when(n["all"] >= F.when(n["source"] > 0, 1).otherwise(rule.least), n["all"]).otherwise(0)
    return bound(F.struct((content + from_source).alias("all"), from_source.alias("source")), enough)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Sources whose articles on banknotes are headed so.
BANKNOTE_SOURCES = ("banknotenews", "notafilia")


def classified(rules: tuple[ClassRule, ...] = CLASSES, keywords: Column | None = None) -> Column:
    """struct<topic, domains, signals, classes, tags> of a row with title, contentSnippet, link, source, feedName and topic.

    Rules are ordered by score, ties by their place in the table; the headline topic is the strongest rule's, but Banknotes
    where that rule matches and the topic or the source is of banknotes. keywords, an array, add domains alone.
    """
    listed = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.lower(F.trim(k))) if keywords is not None else None
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    title = F.lower(blank("title"))
    local = F.lower(F.concat_ws(" ", blank("title"), blank("contentSnippet")))
    source = F.lower(F.concat_ws(" ", blank("source"), blank("feedName")))

    def scored(row: Column) -> Column:
        each = []
        for k, r in enumerate(rules):
            allowed = F.lit(True)
            if r.signal_title:
                allowed = any_of([has_term(row["title"], t) for t in r.signal_title]) | any_of([has_term(row["text"], t, words=row["words"]) for t in r.signal_content])
            score = rule_score(r, row["text"], row["local"], row["source"], row["words"])
            each.append(F.struct((-score).alias("s"), F.lit(k).alias("k"), F.lit(r.id).alias("id"), F.lit(r.topic).alias("topic"), F.lit(r.domain).alias("domain"), F.when(allowed, F.lit(r.signal)).alias("signal"), F.array(*[F.lit(t) for t in r.tags]).cast("array<string>").alias("tags")))
        return bound(F.array_sort(F.filter(F.array(*each), lambda x: x["s"] < 0)), named)

    def named(hit: Column) -> Column:
        distinct = lambda name: F.array_distinct(F.array_compact(F.transform(hit, lambda x: x[name])))
        of_banknotes = (F.lower(F.trim(blank("topic"))) == "banknotes") | any_of([has_term(source, t) for t in BANKNOTE_SOURCES])
        topic = F.when(F.exists(hit, lambda x: x["id"] == "banknotes") & of_banknotes, F.lit("Banknotes")).otherwise(
            F.coalesce(F.get(hit, F.lit(0))["topic"], F.nullif(blank("topic"), F.lit("")), F.lit("General"))
        )
        domains = distinct("domain")
        if listed is not None:
            more = F.array_compact(F.array(*[F.when(F.arrays_overlap(listed, F.array(*[F.lit(k) for k in r.keywords])), F.lit(r.domain)) for r in rules if r.keywords]))
            domains = F.array_union(domains, more.cast("array<string>"))
        tags = F.array_distinct(F.flatten(F.transform(hit, lambda x: x["tags"])))
        return F.struct(topic.alias("topic"), domains.alias("domains"), distinct("signal").alias("signals"), F.transform(hit, lambda x: x["id"]).alias("classes"), tags.alias("tags"))

    def read(low: Column) -> Column:
        text = F.concat_ws(" ", low, F.lower(blank("link")))
        return bound(F.struct(title.alias("title"), low.alias("local"), text.alias("text"), source.alias("source"), words_of(text).alias("words")), scored)

    # A long text is put into lower case once.
    return bound(local, read)


def cascade(*gates: tuple[Column, bool, str | Column], accept: str = "accepted") -> Column:
    """struct<accepted, reason>: the first gate whose condition holds decides; none accepts with the last reason."""
    verdict = lambda ok, why: F.struct(F.lit(ok).alias("accepted"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))
    out = None
    for condition, ok, why in gates:
        condition = F.coalesce(condition, F.lit(False))
        out = F.when(condition, verdict(ok, why)) if out is None else out.when(condition, verdict(ok, why))
    return verdict(True, accept) if out is None else out.otherwise(verdict(True, accept))


def term_hits(text: Column, terms: tuple[str, ...], flexible: bool = True) -> Column:
    """The terms that occur, in the table's order."""
    return F.array_compact(F.array(*[F.when(has_term(text, t, flexible), F.lit(t)) for t in terms])) if terms else F.array().cast("array<string>")


@dataclass(frozen=True)
class SourceRule:
    keys: tuple[str, ...]
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    protected: tuple[str, ...] = ()
    exclude_sources: tuple[str, ...] = ()
    reject_titles: tuple[str, ...] = ()
    reject_links: tuple[str, ...] = ()


def source_relevance(rules: tuple[SourceRule, ...], global_links: tuple[str, ...] = ()) -> Column:
    """struct<accepted, reason>: non-article links, no rule, rejected pages, publishers, protected, excluded, included.

    The first rule with a key in the feed's name or address applies; terms look at title, link and snippet, protected
    terms at title and link, publisher terms at the source alone.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    feed = F.lower(F.concat_ws(" ", blank("feedName"), blank("rssUrl")))
    text = F.lower(F.concat_ws(" ", blank("title"), blank("link"), blank("contentSnippet")))
    head, title, link, source = F.lower(F.concat_ws(" ", blank("title"), blank("link"))), F.lower(blank("title")), F.lower(blank("link")), F.lower(blank("source"))
    inside = lambda column, parts: any_of([F.contains(column, F.lit(p)) for p in parts])
    said = lambda word, hits: F.concat(F.lit(f"{word}:"), F.array_join(hits, ", "))
    out = F.when(inside(link, global_links), F.struct(F.lit(False).alias("accepted"), F.lit("rejected-non-article-link").alias("reason")))
    for r in rules:
        verdict = cascade(
            (inside(title, r.reject_titles) | inside(link, r.reject_links), False, "rejected-page"),
            (F.size(term_hits(source, r.exclude_sources)) > 0, False, said("excluded-publisher", term_hits(source, r.exclude_sources))),
            (F.size(term_hits(head, r.protected)) > 0, True, said("protected-source-term", term_hits(head, r.protected))),
            (F.size(term_hits(text, r.exclude)) > 0, False, said("excluded-term", term_hits(text, r.exclude))),
            (F.size(term_hits(text, r.include)) > 0, True, "included-term"),
            (F.lit(True), False, "missing-allowlist-term"),
        )
        out = out.when(inside(feed, r.keys), verdict)
    return out.otherwise(F.struct(F.lit(True).alias("accepted"), F.lit("no-source-rule").alias("reason")))


#: Profiles and the domains that make an article eligible.
PROFILES = {
    "central_bank": ("banknotes",),
    "passport_authority": ("identity_documents",),
    "border_control": ("identity_documents",),
    "security_printer": ("banknotes", "identity_documents", "security_printing"),
    "identity_verification": ("digital_identity_biometrics",),
    "vendors": ("banknotes", "identity_documents", "digital_identity_biometrics", "security_printing"),
    "researcher": ("banknotes", "identity_documents", "digital_identity_biometrics", "security_printing"),
}
#: What a vendor's pages say that is no news.
VENDOR_NOISE = (
    r"\b(?:career|careers|vacanc(?:y|ies)|job|jobs)\b", r"\b(?:contact us|privacy policy|cookie policy|login|sign up)\b",
    r"\b(?:tutorial|how to|step-by-step|setup guide|developer guide|api tutorial|sdk integration)\b", r"\b(?:linkedin|banknote catalog|collector banknote|auction|for sale)\b",
)


def ascii_edges(pattern: str) -> str:
    """The pattern with word edges among ASCII letters, digits and "_", whatever the JVM takes for letters. An edge before a
    letter, a digit or a group begins a word, any other ends one, as it is in all patterns here."""
    return re.sub(r"\\b(?=[A-Za-z0-9(])", "(?<![A-Za-z0-9_])", pattern).replace(r"\b", "(?![A-Za-z0-9_])")


def profile_decision(profile: str, affiliated: Column, domains: Column, signals: Column, classes: Column, text: Column) -> Column:
    """struct<accepted, reason> of one profile: affinity, then vendor noise, then industry evidence or stored signal."""
    known = F.coalesce(F.arrays_overlap(domains, F.array(*[F.lit(d) for d in PROFILES[profile]])), F.lit(False))
    gates: list[tuple[Column, bool, str]] = [(~F.array_contains(affiliated, profile), False, "source_not_affiliated")]
    if profile == "vendors":
        gates.append((any_of([F.lower(text).rlike(ascii_edges(p)) for p in VENDOR_NOISE]), False, "vendor_quality_filter_rejected"))
    if profile in ("vendors", "researcher"):
        gates.append((~known | (F.size(classes) == 0), False, "article_industry_evidence_missing"))
        return cascade(*gates, accept="source_affinity_and_industry_evidence")
    gates += [(~F.array_contains(signals, profile), False, "article_signal_missing"), (~known, False, "profile_domain_missing")]
    return cascade(*gates, accept="source_affinity_and_article_evidence")


def affinities(explicit: Column, group: Column, curated: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Explicit affinities joined with those of the feed's group, each once."""
    table = curated or {"vendors": ("vendors", "researcher"), "central_banks": ("central_bank",)}
    none = F.array().cast("array<string>")
    more = none
    for k, names in table.items():
        more = F.when(group == k, F.array(*[F.lit(n) for n in names])).otherwise(more)
    return F.array_union(F.filter(F.coalesce(explicit, none), lambda x: x != ""), more)


def interest_groups(groups: Column) -> Column:
    """OR within a group, AND across groups; a group without a selection passes. groups: array<struct<selected, matched>>."""
    return F.forall(groups, lambda g: (F.size(g["selected"]) == 0) | F.coalesce(F.arrays_overlap(g["selected"], g["matched"]), F.lit(False)))


def unified(source: Column, profile: Column, interest: Column, quality: Column) -> Column:
    """struct<passed, failedStage>: the first stage, in this order, that doesn't pass."""
    failed = F.when(~source, "sourceScope").when(~profile, "profilePolicy").when(~interest, "interestRefinement").when(~quality, "qualityNoise").otherwise("")
    return F.struct((failed == "").alias("passed"), failed.alias("failedStage"))


def weighted_score(text: Column, strong: dict[str, float], weak: dict[str, float]) -> Column:
    """Sum of the weights of the terms that occur."""
    parts = [F.when(has_term(text, t), F.lit(float(w))).otherwise(0.0) for t, w in (strong | weak).items()]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def dominant(scores: dict[str, Column], least: float = 8, margin: float = 2, clear: float = 14) -> Column:
    """The top domain if it reaches `least` and leads by `margin` or is `clear` by itself; ties by name's place."""
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("s"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, s) in enumerate(scores.items())]))
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    top, next_ = -first["s"], -F.coalesce(second["s"], F.lit(0.0))
    return F.when((top >= least) & ((top - next_ >= margin) | (top >= clear)), first["name"])


def recency_points(days: Column, steps: tuple[tuple[int, int], ...] = ((7, 10), (30, 6), (90, 3))) -> Column:
    out = F.lit(0)
    for most, points in reversed(steps):
        out = F.when(days <= most, points).otherwise(out)
    return out


def feedback_input(reasons: tuple[str, ...], most_chars: int = 160, most_interests: int = 60) -> Column:
    """struct<valid, clientId, reason, context, interests> of a report (articleId, clientId, reason, context, interests)."""
    said = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    client, interests = said("clientId"), F.filter(F.transform(F.coalesce("interests", F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    valid = (said("articleId") != "") & (client != "") & (F.length(client) <= most_chars) & said("reason").isin(*reasons)
    return F.struct(valid.alias("valid"), client.alias("clientId"), said("reason").alias("reason"), F.left(said("context"), F.lit(most_chars)).alias("context"), F.slice(interests, 1, most_interests).alias("interests"))
