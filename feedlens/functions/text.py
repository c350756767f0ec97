"""Scalar text, title, URL and image functions as columns; Arrow functions only for what built-ins lack."""

from __future__ import annotations

import re
import unicodedata
from datetime import date, timedelta
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as JavaScript's trim sees it: Java's plus no-break space and the byte order mark.
BLANK = "[\\s\\x{00A0}\\x{FEFF}]"
#: Words that say nothing about a topic.
STOP_WORDS = (
    "the", "and", "for", "with", "that", "from", "this", "have", "your", "into", "about", "after", "their", "they",
    "will", "would", "said", "over", "more", "than", "been", "also", "amid", "under", "news", "alert",
)
#: Query parameters that a canonical address drops.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ved")


def trimmed(x: Column) -> Column:
    """Without the signs of BLANK at both ends; a pattern would be tried at each sign between them."""
    return F.btrim(x, F.lit(" \t\n\x0b\f\r\u00a0\ufeff"))


def normal_text(x: Column, fallback: str = "") -> Column:
    """The trimmed text, or the fallback where it is null or blank."""
    return F.coalesce(F.nullif(trimmed(x), F.lit("")), F.lit(fallback))


def stripped_html(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]++>", " ")


@F.pandas_udf(StringType())
def numeric_entities(x: pd.Series) -> pd.Series:
    """Decimal and hexadecimal character references to UTF-16 code units, as fromCharCode does."""
    unit = lambda n: chr(n & 0xFFFF) if not 0xD800 <= (n & 0xFFFF) < 0xE000 else "�"
    out = x.str.replace(r"&#(\d+);", lambda m: unit(int(m[1])), regex=True)
    return out.str.replace(r"&#[xX]([0-9a-fA-F]+);", lambda m: unit(int(m[1], 16)), regex=True)


def named_entities(x: Column) -> Column:
    """The six literal references, the ampersand first: a doubly escaped text is decoded twice."""
    for name, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return x


def sanitized(x: Column, fallback: str = "", numeric: bool = True) -> Column:
    """Trim, strip tags, decode references, collapse white space; numeric=False stays inside the JVM."""
    text = stripped_html(normal_text(x))
    text = named_entities(numeric_entities(text) if numeric else text)
    return normal_text(F.regexp_replace(text, f"{BLANK}+", " "), fallback)


def title_lead(x: Column) -> Column:
    """Lower case without leading signs and without a leading marker such as "breaking:"."""
    return F.regexp_extract(F.lower(x), "^[^a-z0-9]*+(?:(?:breaking|watch|analysis|live|update):\\s+)?((?s:.*))", 1)


def normal_title(x: Column, numeric: bool = False) -> Column:
    bare = F.regexp_replace(title_lead(sanitized(x, numeric=numeric)), "[^\\p{L}\\p{N}\\s]", " ")
    return F.trim(F.regexp_replace(bare, "\\s+", " "))


def unwrapped_link(x: Column) -> Column:
    """The target of a search engine's redirect link; other links stay."""
    host = F.lower(F.regexp_extract(x, "^https?://([^/?#:]+)", 1))
    path = F.regexp_extract(x, "^https?://[^/?#]+([^?#]*)", 1)
    target = F.try_url_decode(F.nullif(F.regexp_extract(x, "[?&]url=([^&#]*)", 1), F.lit("")))
    redirect = (F.contains(host, F.lit("google.")) & (path == "/url")) | ((F.regexp_replace(host, "^www\\.", "") == "bing.com") & (F.lower(path) == "/news/apiclick.aspx"))
    return F.when(redirect, F.coalesce(target, x)).otherwise(x)


def canonical_url(x: Column) -> Column:
    """Unwrapped, without fragment, tracking parameters and a leading www., host in lower case."""
    link = F.regexp_replace(trimmed(unwrapped_link(x)), "#.*$", "")
    names = "|".join(TRACKING)
    query = F.regexp_replace(F.regexp_extract(link, "\\?(.*)$", 1), f"(^|&)(?:{names})(?:=[^&]*)?(?=&|$)", "")
    query = F.regexp_replace(query, "^&+", "")
    before = F.regexp_replace(link, "\\?.*$", "")
    host = F.lower(F.regexp_extract(before, "^(https?://[^/]*)", 1))
    rest = F.regexp_replace(before, "^(?i:https?)://[^/]*", "")
    host = F.regexp_replace(host, "^(https?://)www\\.", "$1")
    whole = F.concat(host, F.when(rest == "", F.lit("/")).otherwise(rest), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(link.rlike("^(?i:https?)://"), whole).otherwise(F.coalesce(link, F.lit("")))


@F.pandas_udf(StringType())
def resolved_url(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b or "", (x or "").strip()) if (x or "").strip() else "" for b, x in zip(base, link, strict=True)])


def host_of(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(x, "^[A-Za-z]+://([^/?#:]+)", 1)), "^www\\.", "")


def tokens(x: Column) -> Column:
    return F.filter(F.split(normal_title(x), " "), lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))


def _bound(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with the value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def inferred_keywords(x: Column, most: int = 8) -> Column:
    """The most frequent tokens, by count, then by where each first occurs.

    Sorted tokens in a row are cut into runs of equal ones; only tokens as frequent as the last that is taken are looked for.
    """
    run = "(\\S+)(?: \\1(?= |$))*(?: |$)"

    def counted(row: Column) -> Column:
        token = lambda r: F.substring_index(r, " ", 1)
        return F.transform(row, lambda r: F.struct(((F.length(F.rtrim(r)) + 1) / (F.length(token(r)) + 1)).cast("int").alias("n"), token(r).alias("t")))

    def best(both: Column) -> Column:
        found, each = both["found"], both["each"]
        least = F.coalesce(F.get(F.sort_array(F.transform(each, lambda c: c["n"]), asc=False), F.lit(most - 1)), F.lit(0))
        near = _bound(least, lambda n: F.filter(each, lambda c: c["n"] >= n))
        placed = F.transform(near, lambda c: F.struct((-c["n"]).alias("c"), F.array_position(found, c["t"]).alias("at"), c["t"].alias("t")))
        return F.transform(F.slice(F.sort_array(placed), 1, most), lambda s: s["t"])

    runs = lambda found: F.regexp_extract_all(F.array_join(F.sort_array(found), " "), F.lit(run), F.lit(0))
    return _bound(tokens(x), lambda found: _bound(F.struct(found.alias("found"), counted(runs(found)).alias("each")), best))


def summary_short(x: Column, most: int = 220) -> Column:
    """The first sentence, or the whole text where no sentence ends, at most so many characters."""
    whole = trimmed(x)
    return F.left(F.coalesce(F.nullif(F.regexp_extract(whole, "^((?s:.*?)[.!?])(?:\\s|$)", 1), F.lit("")), whole), F.lit(most))


def term_pattern(term: str, flexible: bool = False) -> str:
    """ASCII terms stand between signs that aren't letters or digits; flexible lets blanks be dashes or slashes."""
    escaped = "".join(f"\\{c}" if c in ".*+?^${}()|[]\\-/" else c for c in term.strip().lower())
    return f"(^|[^a-z0-9]){'[\\s\\-/&]+'.join(escaped.split()) if flexible else escaped}([^a-z0-9]|$)"


def words_of(lowered: Column) -> Column:
    """The distinct runs of ASCII letters and digits: what has_term() takes as words where many terms are asked."""
    return F.array_distinct(F.split(lowered, "[^a-z0-9]+"))


def has_term(lowered: Column, term: str, flexible: bool = False, words: Column | None = None) -> Column:
    """Whether the term occurs. words: those of the text, or of one that holds it."""
    t = term.strip().lower()
    if not t:
        return F.lit(False)
    if flexible or all(c.isascii() and (c.isalnum() or c in " -\t") for c in t):
        # The pattern is only tried where the term's first word occurs.
        first = re.match("[a-z0-9]+", t)
        said = lowered.rlike(term_pattern(t, flexible))
        if first:
            said = (F.contains(lowered, F.lit(first[0])) if words is None else F.array_contains(words, first[0])) & said
        return F.coalesce(said, F.lit(False))
    return F.coalesce(F.contains(lowered, F.lit(t)), F.lit(False))


@F.pandas_udf(StringType())
def without_marks(x: pd.Series) -> pd.Series:
    """NFKD without combining marks; Spark has no such function."""
    return pd.Series(["".join(c for c in unicodedata.normalize("NFKD", t or "") if not 0x300 <= ord(c) <= 0x36F) for t in x])


def wish_text(x: Column) -> Column:
    """Lower case letters and digits alone, one spelling of license. Only texts with a sign beyond ASCII leave the JVM."""
    x = F.coalesce(x, F.lit(""))
    odd = x.rlike("[^\\x00-\\x7F]")
    bare = F.when(odd, without_marks(F.when(odd, x))).otherwise(x)
    low = F.regexp_replace(F.lower(bare), "(?<![A-Za-z0-9_])licence(?![A-Za-z0-9_])", "license")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def passages(*fields: Column) -> Column:
    """The normalised, non-empty passages of several fields, in order; wish_text is applied to whole fields' pieces."""
    pieces = F.flatten(F.array(*[F.split(F.coalesce(f, F.lit("")), "[.!?]+|\\n+") for f in fields]))
    return pieces


MONTHS = {m: k + 1 for k, m in enumerate("january february march april may june july august september october november december".split())}


def month_number(x: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in MONTHS.items() for v in pair]), F.lower(F.trim(x)))


def evidence_text(*fields: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws(" ", *fields)), "[-_]+", " "), "\\s+", " ")


def presentable(x: Column) -> Column:
    """A thumbnail that can be shown: an http address that is no placeholder."""
    return F.coalesce(x.rlike("^(?i:https?)://") & ~F.lower(x).rlike("placeholder|placehold\\.co|source-title-card"), F.lit(False))


def generic_image(x: Column) -> Column:
    return F.coalesce(F.lower(x).rlike("logo|favicon|sprite|default|avatar|icon[-_.]"), F.lit(False))


def corrected_date(stored: Column, published: Column) -> Column:
    """The publisher's date if it is more than a day older than the stored one."""
    return F.when(published < stored - F.expr("interval 24 hours"), published).otherwise(stored)


def history_windows(first: str, last: str, days: int = 90) -> list[tuple[str, str]]:
    a, end, out = date.fromisoformat(first), date.fromisoformat(last), []
    while a <= end:
        b = min(a + timedelta(days=days - 1), end)
        out.append((a.isoformat(), b.isoformat()))
        a = b + timedelta(days=1)
    return out


def scope_fingerprint(scope: dict) -> str:
    """A stable name of a query's scope: its sorted JSON, hashed."""
    import base64
    import hashlib
    import json

    return base64.urlsafe_b64encode(hashlib.sha256(json.dumps(scope, sort_keys=True, separators=(",", ":")).encode()).digest()).rstrip(b"=").decode()
