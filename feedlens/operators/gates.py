"""Gates of profiles and discovery feeds: each a struct<accepted, reason> of an article's texts and earlier findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.functions.text import host_of
from feedlens.operators.filters import any_of
from feedlens.operators.rules import ascii_edges, cascade

#: What discovery feeds are asked for.
BANKNOTE = r"\bbank\s?notes?\b|\bcurrency notes?\b|\bcedi notes?\b"
ISSUER = r"\b(?:bank of|central bank of|reserve bank of)\s+[a-z][a-z\s-]{2,50}\b"
BANKNOTE_EVENT = (
    r"\b(?:central bank|reserve bank|\becb\b|\bbsp\b|issued?|issuance|circulat(?:e|es|ed|ing|ion)|unveils?|introduces?|launches?|rollout|new bank\s?note|design|redesign|security (?:feature|features|ink|thread)|hologram"
    r"|counterfeit|anti-counterfeit|security printing|printed?|printing|production|future|series|denomination|polymer|substrate|commemorative)\b"
)
DOCUMENT_SECURITY = r"\b(?:passport|travel document|identity document|bank\s?note|currency note|cedi note|document security|anti-counterfeit|holographic?|optical variable device|security printing)\b"
OPTICAL = r"\bovd\b|\boptical variable devices?\b"
PASSPORT = r"\bpassports?\b|\btravel documents?\b"
PASSPORT_EVENT = (
    r"\b(?:issue(?:d|s|r|ance)?|renew(?:al|ed|s|ing)?|application|biometric|e-?passport|ai passport|passport project|forg(?:ed|ery)|fake|counterfeit|fraud|false use|border|immigration|document security|travel document"
    r"|passport control)\b"
)
DISCOVERY_FEEDS = ("ovd", "security features", "banknotes", "passports")
#: The terms of which a profile's article names one of each kind.
EVIDENCE = {
    "central_bank": (
        ("banknote", "bank note", "currency note", "counterfeit currency", "counterfeit deterrence"),
        ("unveil", "launch", "issue", "design", "withdraw", "counterfeit", "security", "polymer"),
    ),
    "passport_authority": (
        ("passport", "identity card", "id card", "driver license", "driver's license", "driving licence", "residence permit", "visa", "mobile driver license", "mobile driving licence", "mdl"),
        ("renew", "issu", "launch", "standard", "guideline", "security", "fraud", "digital", "biometric", "requirement", "trust service", "implementation", "joins"),
    ),
    "border_control": (
        ("border", "frontex", "customs", "migration", "ees", "etias", "border police", "grenzpolizei"),
        ("border check", "entry exit system", "ees", "etias", "crossing", "operation", "smuggling", "trafficking", "arrest", "seized", "surveillance", "coordination", "document inspection", "identity check"),
    ),
    "security_printer": (
        ("security print", "banknote", "passport", "identity document", "secure document"),
        ("substrate", "ink", "hologram", "holograph", "personalization", "personalisation", "production", "manufactur", "technology"),
    ),
    "vendors": (
        ("identity", "biometric", "authentication", "banknote", "passport", "security print", "security document", "credential"),
        ("launch", "contract", "partner", "deploy", "research", "platform", "solution", "product", "technology"),
    ),
    "identity_verification": (
        ("openid", "identity verification", "digital id", "digital identity", "digital wallet", "digital trust service", "authentication", "age assurance", "age verification", "biometric", "credential"),
        ("standard", "specification", "act", "review", "consultation", "launch", "deploy", "rollout", "roll out", "welcome", "welcomes", "joins", "fraud", "post-quantum", "recommendation"),
    ),
    "researcher": (
        ("banknote", "passport", "identity document", "digital identity", "biometric", "security print", "authentication"),
        ("research", "report", "study", "policy", "market", "technology", "fraud", "standard", "regulation"),
    ),
}
#: Titles that promote an event, and what an article on verification is about.
PROMOTION = ("speaker line up", "call for speakers", "join the", "conference", "keynote", "exhibitor", "sponsor", "stand ")
CORPORATE = ("jp morgan", "speaks out")
VERIFICATION = (
    "identity verification", "document verification", "biometric verification", "authentication", "identity token", "identity assertion", "age verification", "age assurance", "identity fraud", "identity proofing",
    "liveness", "kyc", "onboarding", "biometric", "biometrics",
)
VEHICLE = ("honda passport", "trailsport", "suv", "automotive", "vehicle", "awd", "mpg")


def _in(x: Column, terms: tuple[str, ...]) -> Column:
    return any_of([F.contains(x, F.lit(t)) for t in terms])


def _says(x: Column, pattern: str) -> Column:
    return F.coalesce(F.lower(x).rlike(ascii_edges(pattern)), F.lit(False))


def discovery_quality(feed_name: Column, feed_url: Column, title: Column, text: Column) -> Column:
    """Alert feeds of four names take only articles with the feed's subject in a context; text: title and summaries."""
    name = F.lower(F.trim(feed_name))
    alert = F.coalesce((F.regexp_extract(feed_url, "^[a-z]+://([^/?#]+)", 1) == "www.google.com") & F.regexp_extract(feed_url, "^[a-z]+://[^/?#]+([^?#]*)", 1).startswith("/alerts/feeds/"), F.lit(False))
    banknote = _says(text, BANKNOTE) & _says(text, BANKNOTE_EVENT) & (_says(title, BANKNOTE) | _says(title, ISSUER))
    secure = _says(text, DOCUMENT_SECURITY)
    return cascade(
        (~alert | ~F.coalesce(name.isin(*DISCOVERY_FEEDS), F.lit(False)), True, "discovery_feed_quality_not_applicable"),
        ((name == "ovd") & _says(text, OPTICAL) & secure, True, "ovd_document_security_context"), (name == "ovd", False, "ovd_missing_document_security_context"),
        ((name == "security features") & (banknote | secure), True, "security_features_document_security_context"), (name == "security features", False, "security_features_missing_document_security_context"),
        ((name == "banknotes") & banknote, True, "banknotes_concrete_context"), (name == "banknotes", False, "banknotes_missing_concrete_context"),
        (_says(text, PASSPORT) & _says(text, PASSPORT_EVENT), True, "passports_concrete_context"), (F.lit(True), False, "passports_missing_concrete_context"),
    )


def evidence_text(*columns: Column) -> Column:
    """Lower case, with dashes, slashes and underscores as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws(" ", *columns)), "[\\-–—_/]+", " "), "\\s+", " "))


def profile_evidence(profile: str, text: Column) -> Column:
    """struct<passed, anchors, events>: an article is a profile's if it names one of its anchors and one of its events."""
    flat = lambda t: t.replace("-", " ")
    found = lambda terms: F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, F.replace(t, F.lit("-"), F.lit(" "))))
    anchors, events = EVIDENCE[profile]
    passed = _in(text, tuple(map(flat, anchors))) & _in(text, tuple(map(flat, events)))
    return F.struct(passed.alias("passed"), F.slice(found(anchors), 1, 10).alias("anchors"), F.slice(found(events), 1, 10).alias("events"))


def domain_scope(primary: Column, selected: Column, identity_bridge: Column, banknote_bridge: Column) -> Column:
    """The article's domain is one, and of those selected; a technique's bridge stands for its domain."""
    bridged = (identity_bridge & F.array_contains(selected, "identity_documents")) | (banknote_bridge & F.array_contains(selected, "banknotes"))
    other = (F.coalesce(primary, F.lit("other")) == "other") & ~identity_bridge & ~banknote_bridge
    return cascade((other, False, "primary_domain_other"), ((F.size(selected) > 0) & ~F.array_contains(selected, F.coalesce(primary, F.lit("other"))) & ~bridged, False, "selected_main_domain_mismatch"), accept="domain_scope_passed")


def professional_guard(several: Column, digital: Column, authentication: Column) -> Column:
    """digital, authentication: whether their assessments pass; null where there is none."""
    return cascade((several, True, "professional_guard_not_applicable"), (~digital, False, "digital_identity_professional_guard"), (~authentication, False, "authentication_professional_guard"), accept="professional_guard_passed")


def shared_security(technique: Column, guard: Column, guard_reason: Column) -> Column:
    """guard: whether the professional guard passes; null where it doesn't apply."""
    return cascade((~technique, False, "shared_security_only_rejected"), (~guard, False, F.coalesce(F.nullif(guard_reason, F.lit("")), F.lit("security_printer_profile_guard_rejected"))), accept="shared_security_only_passed")


def shared_refinement(hard: Column, bridge: Column, banknotes_only: Column, technique: Column) -> Column:
    """bridge: whether the bridge passes; null where it doesn't apply."""
    bridged = hard & bridge.isNotNull() & ~banknotes_only
    return cascade(
        (bridged & bridge, True, "shared_security_bridge_passed"), (bridged, False, "shared_security_bridge_rejected"), (F.coalesce(technique, F.lit(True)), True, "shared_security_technique_passed"),
        (F.lit(True), False, "shared_security_technique_rejected"),
    )


def identity_document(scope: Column, technique: Column, border: Column, queue_terms: Column, operational_terms: Column, visa_noise: Column) -> Column:
    """Border profiles refuse travel queues without detail; visa_noise: why a visa article is a service's, null if it isn't."""
    queue = border & (((queue_terms > 0) & (operational_terms == 0)) | (queue_terms >= 2))
    return cascade((scope & queue, False, "border_control_travel_queue_noise"), (scope & visa_noise.isNotNull(), False, F.coalesce(F.nullif(visa_noise, F.lit("")), F.lit("visa_residence_permit_service_noise"))), (scope & technique, True, "identity_documents_passed"), (F.lit(True), False, "identity_documents_rejected"))


def vehicle_noise(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.contains(low, F.lit("honda")) & F.contains(low, F.lit("passport")) & _in(low, VEHICLE)


def identity_quality(assessment: Column, why: Column, text: Column) -> Column:
    """assessment: whether the bundle's quality passes; null where there is none."""
    return cascade((vehicle_noise(text), False, "identity_document_honda_passport_vehicle_noise"), (~assessment, False, F.coalesce(F.nullif(why, F.lit("")), F.lit("identity_document_bundle_quality_noise"))), accept="identity_document_quality_passed")


def digital_identity(selected: Column, matched: Column, technique: Column) -> Column:
    """selected: how many interests are asked for; matched: those found."""
    return cascade((((selected == 0) | (F.size(matched) > 0)) & F.coalesce(technique, F.lit(True)), True, "digital_identity_passed"), (F.lit(True), False, "digital_identity_rejected"))


def banknote(contaminated: Column, consumer: Column, central: Column, interests: Column, parent: Column, domain: Column, interest: Column, technique: Column) -> Column:
    """consumer: why it is a consumer's article, null if it isn't; central: whether the central bank's guard passes, null where that
    profile isn't active; parent: whether a parent interest acts as the gate of its domain."""
    prefix = F.when(parent, "banknote_parent_gate").otherwise("banknote_interest")
    none = F.size(interests) == 0
    return cascade(
        (contaminated, False, "banknote_contaminated"), (consumer.isNotNull(), False, F.coalesce(F.nullif(consumer, F.lit("")), F.lit("banknote_consumer_noise"))), (~central, False, "central_bank_profile_guard"),
        (none & domain & technique, True, "banknote_domain_passed"), (none, False, "banknote_domain_rejected"), (interest & technique, True, F.concat(prefix, F.lit("_passed"))), (F.lit(True), False, F.concat(prefix, F.lit("_rejected"))),
    )


def identity_week(active: Column, link: Column, title: Column, text: Column) -> Column:
    """One trade site's articles need a focus on verification and promote no event."""
    flat = lambda x: F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))
    here = active & F.coalesce(host_of(link).endswith("identityweek.net"), F.lit(False))
    return cascade(
        (~here, True, "identity_week_quality_not_applicable"), (_in(flat(title), (*PROMOTION, *CORPORATE)), False, "identity_week_event_or_generic_corporate_noise"),
        (~_in(flat(text), VERIFICATION), False, "identity_week_missing_verification_focus"), accept="identity_week_verification_focus",
    )
