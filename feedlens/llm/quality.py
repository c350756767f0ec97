"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import WHITE, whole, words_of

#: Very common short words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it with as be on by this are at or from an was have not a "
    "le la les de des du et en un une que qui dans pour par sur est au "
    "der die das und in den von zu mit sich ist im dem ein eine auf "
    "el los las del y en que se por con para una es al"
)
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails where per * numerator lies over most * denominator, or under least * denominator."""

    name: str
    numerator: str
    denominator: str
    least: int | None = None
    most: int | None = None
    per: int = 100


#: The production thresholds, in whole hundredths so that no verdict hangs on rounding.
RULES = (
    Rule("few_words", "n_words", "one", least=5000),
    Rule("repeated_windows", "n_repeat_words", "n_words", most=50),
    Rule("short_or_long_words", "word_chars", "n_words", least=250, most=1500),
    Rule("symbols", "n_symbols", "n_words", most=20),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=50),
    Rule("stop_words", "n_stop_words", "n_words", least=2),
)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every input column plus the counts that rules name; built-in functions alone, nothing shuffled.

    Null text counts as empty (all counts 0). Input columns must not be named as the counts: passing() takes any. A window's identity is a 64-bit hash of its three words within
    one document; only documents that hold a repeated window sort their windows.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns]
    named = "_fq_"
    a = docs.select(*keep, whole(F.col(f"`{text}`")).alias(f"{named}t"))
    t = F.col(f"{named}t")
    a = a.select(
        "*",
        words_of(t).alias(f"{named}w"),
        F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias(f"{named}l"),
    )
    w, lines = F.col(f"{named}w"), F.col(f"{named}l")
    b = a.select(
        "*",
        F.when(F.size(w) >= 3, F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
        .otherwise(F.array().cast("array<bigint>"))
        .alias(f"{named}h"),
    )
    h = F.col(f"{named}h")
    c = b.select("*", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias(f"{named}s"))
    s = F.col(f"{named}s")
    d = c.select("*", F.filter(s, lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))).alias(f"{named}r"))
    e = d.select("*", F.sort_array(F.transform(f"{named}r", lambda x: x["i"])).alias(f"{named}p"))
    p = F.col(f"{named}p")
    covered = F.aggregate(
        F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + F.coalesce(x, F.lit(0)),
    )
    # The row number, never negative, keeps the optimizer from copying these expressions into a filter above them, where
    # they would be evaluated again, arrays inside lambdas once for each element.
    none = F.when(F.monotonically_increasing_id() < 0, 1).otherwise(0)
    return e.select(
        *keep,
        (F.size(w) + none).cast("bigint").alias("n_words"),
        F.length(F.translate(t, WHITE, "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS.split())))).cast("bigint").alias("n_stop_words"),
        F.lit(1).cast("bigint").alias("one"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of measured() breaks, as one array."""
    broken = []
    for r in rules:
        value, of = F.col(r.numerator) * r.per, F.col(r.denominator)
        fails = F.lit(False)
        if r.least is not None:
            fails = fails | (value < of * r.least)
        if r.most is not None:
            fails = fails | (value > of * r.most)
        broken.append(F.when(fails, F.lit(r.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"


def accepted(rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a row of measured() passes the base test and every rule."""
    return ~F.expr(BASE_FAILED) & (F.size(verdict(rules)) == 0)


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with all their columns, whatever these are called."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return measured(rows).where(accepted(rules)).select("row.*")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Document id, the counts, base_failed, the broken rules and kept.

    Null and empty texts have no words and fail; a very long text is one row like any other; repeated rows, a null doc_id
    included, each get a row; an empty table gives none; extra columns, whatever their names, don't reach the result.
    """
    if text != "text":
        docs = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    m = measured(docs.select("doc_id", "text")).select("*", verdict(rules).alias("broken"))
    failed = F.expr(BASE_FAILED)
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.size("broken") == 0)).alias("kept"), "n_lines", "n_stop_words", F.array_join("broken", ",").alias("broken"),
    )
