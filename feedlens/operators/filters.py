"""The composable article filter: one validated description, one predicate column."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEARCHED = ("title", "source", "topic", "feedName", "link", "canonicalLink", "contentSnippet")

#: What each signal of the article API looks for.
SIGNALS = {
    "new-releases": ("issued", "released", "launched", "introduced", "unveiled"),
    "regulations": ("regulation", "law", "requirement", "compliance", "policy", "directive"),
    "design-changes": ("redesign", "new design", "updated design", "new series", "portrait"),
    "security-features": ("security feature", "hologram", "watermark", "microprint", "uv ink", "intaglio"),
    "technology": ("biometric", "verification", "digital id", "nfc", "mrz", "identity verification"),
    "fraud": ("fraud", "fraudulent", "forged passport", "fake passport", "identity theft"),
    "counterfeit": ("counterfeit", "fake notes", "forged notes", "counterfeit banknotes"),
    "withdrawal": ("withdrawal", "withdrawn from circulation", "legal tender", "demonetisation", "demonetization"),
    "redesign": ("redesign", "new family", "new artwork", "updated portrait"),
    "polymer": ("polymer", "substrate", "plastic banknote", "polymer migration"),
    "commemorative": ("commemorative", "anniversary note", "centennial"),
    "rollout": ("rollout", "launched", "implemented", "deployment", "go-live"),
    "delay": ("delay", "backlog", "queue", "technical outage", "technical problem"),
    "travel-disruption": ("travel disruption", "border delays", "airport delays", "entry disruption"),
    "criminal-misuse": ("terror", "terrorist", "criminal misuse", "fake passport", "forged passport"),
    "biometric": ("biometric", "biometrics", "biometric checks", "fingerprint", "facial recognition"),
    "identity-theft": ("identity theft", "stolen identity"),
    "border-control": ("border control", "customs", "immigration control", "border checks"),
}


def signal_keywords(signal: str | None) -> tuple[str, ...]:
    """A signal's keywords; one that nobody knows doesn't filter."""
    return SIGNALS.get((signal or "").strip(), ())


@dataclass(frozen=True)
class ArticleQuery:
    """Unset fields don't filter. feed_ids override feed_id; since overrides date_from; only_duplicates overrides exclude_duplicates."""

    topic: str | None = None
    feed_id: str | None = None
    feed_ids: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    since: str | None = None
    exclude_duplicates: bool = False
    only_duplicates: bool = False
    fetch_statuses: tuple[str, ...] = ()
    search: str = ""
    tag: str | None = None
    signal_keywords: tuple[str, ...] = ()
    wishlist_only: bool = False
    signals: dict[str, tuple[str, ...]] = field(default_factory=dict)


def holds(text: Column, token: str) -> Column:
    """Case-insensitive substring; a null column holds nothing and no sign is special."""
    return F.coalesce(F.contains(F.lower(text), F.lit(token.lower())), F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False)) if conditions else F.lit(False)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True)) if conditions else F.lit(True)


def search_predicate(search: str, columns: tuple[str, ...] = SEARCHED) -> Column:
    """Every blank-separated token must occur in at least one searched column."""
    return all_of([any_of([holds(F.col(c), token) for c in columns]) for token in search.split()])


def predicate(q: ArticleQuery) -> Column:
    parts: list[Column] = []
    if q.topic:
        parts.append(F.col("topic") == q.topic)
    ids = [x for x in dict.fromkeys(i.strip() for i in q.feed_ids) if x]
    if q.feed_ids:
        parts.append(F.col("feedId").isin(ids))
    elif q.feed_id:
        parts.append(F.col("feedId") == q.feed_id)
    first = q.since or q.date_from
    if first:
        parts.append(F.col("pubDate") >= F.lit(first).cast("timestamp"))
    if q.date_to:
        parts.append(F.col("pubDate") <= F.lit(q.date_to).cast("timestamp"))
    if q.only_duplicates:
        parts.append(F.col("isDuplicate"))
    elif q.exclude_duplicates:
        parts.append(~F.col("isDuplicate"))
    if q.fetch_statuses:
        parts.append(F.col("fetchStatus").isin(*q.fetch_statuses))
    if q.search.strip():
        parts.append(search_predicate(q.search))
    if q.tag:
        parts.append(F.array_contains("keywords", q.tag))
    if q.signal_keywords:
        parts.append(any_of([holds(F.col(c), k) for k in q.signal_keywords for c in SEARCHED]))
    return all_of(parts)


def wishlisted(articles: DataFrame, bridge: DataFrame, items: DataFrame) -> DataFrame:
    """Articles with a strong match to an active item that isn't completed: an EXISTS, so a semi join."""
    live = items.where("isActive and workflowStatus != 'Completed'").select(F.col("id").alias("wishlistItemId"))
    strong = bridge.where("confidence = 'strong'").join(live, "wishlistItemId", "left_semi").select(F.col("articleId").alias("id"))
    return articles.join(strong, "id", "left_semi")


def backlog() -> Column:
    """Articles whose enrichment is pending: no thumbnail, no short summary, or a status that says so."""
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return empty("thumbnail") | empty("summaryShort") | F.col("fetchStatus").isin("pending", "partial")


def expired(as_of: str, extended_feeds: list[str] | None, extended_profiles: tuple[str, ...] = ("vendors", "researcher", "security_printer"), days: int = 365, long_days: int = 1095) -> Column:
    """Past retention: a year, or three for feeds or profiles in the extended scope."""
    scope = F.col("feedId").isin(extended_feeds or []) if extended_feeds else F.lit(False)
    if extended_profiles:
        scope = scope | F.coalesce(F.arrays_overlap("profileSignals", F.array(*[F.lit(p) for p in extended_profiles])), F.lit(False))
    cut = lambda d: F.lit(as_of).cast("timestamp") - F.expr(f"interval {d} days")
    return F.when(scope, F.col("pubDate") < cut(long_days)).otherwise(F.col("pubDate") < cut(days))


def source_health() -> Column:
    """inactive > error > success > awaiting."""
    return F.when(~F.col("isActive"), "inactive").when(F.col("lastStatus") == "error", "error").when(F.col("lastStatus") == "success", "success").otherwise("awaiting")


def resolve_feed(feeds: DataFrame, wanted: str) -> DataFrame:
    """The feed created last (ties by id) that the text names by id, address, domain or name."""
    key = wanted.strip().lower()
    host = F.regexp_extract(F.lower("rssUrl"), "^[a-z]+://(?:www\\.)?([^/?#:]+)", 1)
    bare = F.regexp_replace(F.lower("rssUrl"), "/+$", "")
    return feeds.where((F.lower("id") == key) | (bare == key.rstrip("/")) | (host == key.removeprefix("www.")) | (F.lower("name") == key)).orderBy(F.desc("createdAt"), "id").limit(1)
