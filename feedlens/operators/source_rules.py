"""Source relevance by a table of rules: any number of sources, each with terms of several classes.

A rule table has a row for each entry: rule (its place), name, class, at (the entry's place in its class) and value. Rules are
gathered to one row a rule, feeds find their first rule by key, and articles meet their feed's rule in a join. Only terms
whose first word is among the article's words are tried as patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.functions.text import words_of
from feedlens.operators.rules import bound

CLASSES = ("key", "include", "exclude", "protected", "publisher", "exact_path", "path", "title", "link", "protected_path")
#: Link targets of sharing widgets, which are no articles.
SHARE_LINKS = ("linkedin.com/", "facebook.com/sharer", "x.com/intent/", "twitter.com/intent/", "wa.me/", "api.whatsapp.com/send")
#: Authored rules, in the form of a production table; `override` lets protected terms stand on any page.
RULES = """
Bank of England News | key: bank of england, bankofengland.co.uk | include: banknote, banknotes, cash, counterfeit, polymer | exclude: foreign currency reserves, interest rate, monetary policy
European Central Bank Press Releases | key: european central bank, ecb.europa.eu | include: banknote, banknotes, cash, digital euro | exclude: interest rates, monetary policy | protected: banknote, banknotes
GovTech Singapore Digital Identity News | key: govtech singapore, tech.gov.sg | include: digital identity, passkeys, singpass, verification | exclude: hackathon, scholarships
Hong Kong Immigration Department News | key: hong kong immigration, immd.gov.hk | include: e-channel, identity cards, passports, travel documents | exclude: arrested, illegal worker, overstayers
South African Reserve Bank News | key: south african reserve bank, resbank.co.za | include: banknote, banknotes, cash, coins | exclude: insurance, monetary policy, prudential authority
Identity Trade Press | key: identity trade press | include: biometric, border control, digital identity, passport | exclude: booth, meet us at | publisher: sponsored desk | title: webinar, white paper | path: /events/
Printing Works Newsroom | key: printing works newsroom | include: banknote, security printing | exclude: careers | protected: banknote series | protected_path: /news/ | exact_path: /news | link: ?print=1 | override: no
Ministry Bulletin | key: ministry bulletin | include: passport, residence permit | exclude: tender results | protected: passport reform | override: yes
"""


def parsed(text: str) -> list[tuple]:
    """Rows (rule, name, class, at, value) of rules written as above."""
    out = []
    for rule, line in enumerate(x for x in text.strip().split("\n") if x.strip()):
        name, *classes = [x.strip() for x in line.split(" | ")]
        for entry in classes:
            kind, _, values = entry.partition(": ")
            out += [(rule, name, kind, at, v.strip()) for at, v in enumerate(values.split(", "))]
    return out


def rule_table(spark: SparkSession, text: str = RULES) -> DataFrame:
    return spark.createDataFrame(parsed(text), "rule int, name string, class string, at int, value string")


def gathered(table: DataFrame) -> DataFrame:
    """One row a rule: an array of the lower-case entries of each class in order, and override. Entries of null or blank values go."""
    entry = F.struct("at", F.lower(F.trim("value")).alias("v"))
    rows = table.where(F.trim("value") != "")
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("class") == c, entry))), lambda x: x["v"]).alias(c) for c in CLASSES]
    return rows.groupBy("rule").agg(F.first("name").alias("name"), *lists, F.coalesce(F.bool_or((F.col("class") == "override") & (F.col("value") == "yes")), F.lit(False)).alias("override"))


def ruled_feeds(feeds: DataFrame, table: DataFrame) -> DataFrame:
    """feedId and rule of the feeds (id, name, rssUrl) that have one: the first whose key is part of name and address."""
    mark = F.lower(F.concat_ws(" ", F.nullif("name", F.lit("")), F.nullif("rssUrl", F.lit(""))))
    keys = table.where("class = 'key' and trim(value) != ''").agg(F.collect_list(F.struct("rule", F.lower(F.trim("value")).alias("v"))).alias("keys"))  # one row
    met = feeds.select(F.col("id").alias("feedId"), mark.alias("mark")).crossJoin(keys)
    rule = F.array_min(F.transform(F.filter("keys", lambda k: F.contains(F.col("mark"), k["v"])), lambda k: k["rule"]))
    return met.select("feedId", rule.alias("rule")).where("rule is not null")


def term_regex(term: Column) -> Column:
    """A term between characters other than a-z and 0-9; its blanks also match dashes, slashes and ampersands."""
    literal = F.regexp_replace(term, r"([\\.*+?^${}()|\[\]\-/&])", r"\\$1")
    return F.concat(F.lit("(^|[^a-z0-9])"), F.regexp_replace(literal, r"\s+", r"[\\s\\-/&]+"), F.lit("([^a-z0-9]|$)"))


def said(text: Column, words: Column, terms: Column) -> Column:
    """The terms that occur in a lower-case text, in order. A pattern is tried where the term's first word is one of the text's."""

    def found(firsts: Column) -> Column:
        known = F.array_intersect(words, F.filter(firsts, lambda x: x != ""))
        tried = lambda t: (F.regexp_extract(t, "^[a-z0-9]*", 0) == "") | F.array_contains(known, F.regexp_extract(t, "^[a-z0-9]*", 0))
        return F.filter(terms, lambda t: tried(t) & F.rlike(text, term_regex(t)))

    return bound(F.transform(terms, lambda t: F.regexp_extract(t, "^[a-z0-9]*", 0)), found)


def path_of(link: Column) -> Column:
    """The lower-case path of an address without slashes at its end, or "/"; empty without an address."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(link)), "^[a-z][a-z0-9+.-]*://[^/?#]*", ""), "[?#].*$", "")
    return F.when(F.trim(link) == "", "").otherwise(F.coalesce(F.nullif(F.regexp_replace(F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare)), "/+$", ""), F.lit("")), F.lit("/")))


def assessed(articles: DataFrame, feeds: DataFrame, table: DataFrame) -> DataFrame:
    """articles (title, link, contentSnippet, source, feedId) with rule, accepted and reason.

    In order: links of sharing widgets, no rule, pages, publishers, protected terms, excluded terms, and included terms or
    the lack of them. Reasons name all entries that matched. Null texts are empty.
    """
    lower = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    joined = lambda *cs: F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in cs]))
    fields = {"title": lower("title"), "link": lower("link"), "publisher": lower("source"), "head": joined("title", "link"), "text": joined("title", "link", "contentSnippet")}
    rules = gathered(table).withColumnRenamed("name", "ruleName").withColumnRenamed("title", "titles").withColumnRenamed("link", "links")
    ruled = ruled_feeds(feeds, table).join(rules, "rule")
    met = articles.join(ruled.select("feedId", F.struct("*").alias("_rule")), "feedId", "left")
    hits = lambda kind, found: F.transform(found, lambda x: F.concat(F.lit(f"{kind}:"), x))
    verdict = lambda ok, why: F.struct(F.lit(ok).alias("accepted"), why.alias("reason"))
    list_of = lambda word, found: F.concat(F.lit(f"{word}:"), F.array_join(found, ", "))
    some = lambda found: F.size(found) > 0

    def judged(x: Column) -> Column:
        r, inside = x["rule"], lambda column, parts: F.filter(parts, lambda p: F.contains(x[column], p))
        pages = F.concat(
            hits("path", F.filter(r["exact_path"], lambda p: x["path"] == F.regexp_replace(p, "/+$", ""))), hits("path-pattern", inside("path", r["path"])),
            hits("title", inside("title", r["titles"])), hits("link-pattern", inside("link", r["links"])),
        )
        publishers, shielded = said(x["publisher"], words_of(x["publisher"]), r["publisher"]), said(x["head"], x["words"], r["protected"])
        stands = r["override"] | (F.size(r["protected_path"]) == 0) | some(inside("path", r["protected_path"]))
        late = bound(said(x["text"], x["words"], r["exclude"]), lambda out: F.when(some(out), verdict(False, list_of("excluded-term", out))).when(some(said(x["text"], x["words"], r["include"])), verdict(True, F.lit("included-term"))).otherwise(verdict(False, F.lit("missing-allowlist-term"))))
        middle = bound(shielded, lambda out: F.when(some(out) & stands, verdict(True, list_of("protected-source-term", out))).otherwise(late))
        ruled_out = bound(publishers, lambda out: F.when(some(out), verdict(False, list_of("excluded-publisher", out))).otherwise(middle))
        own = bound(pages, lambda out: F.when(some(out), verdict(False, list_of("rejected-page", out))).otherwise(ruled_out))
        shared = F.filter(F.array(*[F.lit(p) for p in SHARE_LINKS]), lambda p: F.contains(x["link"], p))
        return F.when(some(shared), verdict(False, list_of("rejected-non-article-link", shared))).when(r.isNull(), verdict(True, F.lit("no-source-rule"))).otherwise(own)

    row = F.struct(*[v.alias(k) for k, v in fields.items()], path_of(F.coalesce(F.col("link"), F.lit(""))).alias("path"), words_of(fields["text"]).alias("words"), F.col("_rule").alias("rule"))
    out = met.withColumn("_v", bound(row, judged))
    return out.select(*[F.col(c) for c in articles.columns], F.col("_rule.ruleName").alias("rule"), "_v.accepted", "_v.reason")
