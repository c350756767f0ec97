"""PII: fixed shapes as seeds, then bootstrapped contextual extraction over a pattern-instance graph.

A pattern is the one or two words right before an identifier. Seeds are the valid base spans. In each round a pattern's
confidence is the score of its instances over their number, and an instance's score is the chance that at least
one of its confident patterns is right; so instances that seeds haven't named gain a score, and count as support of further
patterns in the next round, until scores stand still. Identifier-like strings in a confident pattern's slot become spans of
the kind "ctx". Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.common import dropped, stored, whole

KINDS = ("email", "ip", "card", "phone", "ctx")
#: Fixed shapes, written without backtracking: possessive where nothing is given back, and an address's local part
#: only from where a run begins or the last match ended.
SHAPES = (
    "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "[0-9](?:[\\x20-]?[0-9])++",
    "\\+[0-9][\\x20().0-9-]+[0-9]",
    # candidates: runs of letters, digits, _ / - with a digit, also several joined by single dots or blanks
    "(?<![A-Za-z0-9_/.-])[A-Za-z_/-]*+[0-9][A-Za-z0-9_/-]*+(?:[.\\x20][A-Za-z_/-]*+[0-9][A-Za-z0-9_/-]*+)*+",
)
#: The least digits of a candidate.
DIGITS = 5


@dataclass(frozen=True)
class Bootstrap:
    """The sum of changes of all confidences under which scores stand still, and the rounds after which it is an error that they
    don't (a confident pattern's gap closes by more than half a round); the least confidence of a pattern, and the least number
    of instances it must hold whose own score reaches that confidence; code points before an instance in which its pattern is
    looked for."""

    settled: float = 1e-4
    rounds: int = 100
    confidence: float = 0.6
    seeds: int = 3
    reach: int = 60


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    part_ok = lambda x: F.length(F.ltrim(x, F.lit("0"))) < 3
    parts = F.split(value, "\\.")
    ip = F.forall(parts, lambda x: part_ok(x) | ((F.length(F.ltrim(x, F.lit("0"))) == 3) & (F.ltrim(x, F.lit("0")) <= "255")))
    tens = F.aggregate(
        F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(digits, n + 1 - k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)),
        F.lit(0),
        lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x),
    )
    card = n.between(12, 19) & F.when(n.between(12, 19), tens % 10 == 0).otherwise(False)
    return F.when(kind == 1, ip).when(kind == 2, card).when(kind == 3, n.between(9, 15)).when(kind == 4, n >= DIGITS).otherwise(F.lit(True))


def _matches(k: int, rule: Bootstrap) -> Column:
    """Each match of one shape with its number, the length of the piece of text before it and that piece's end."""
    piece = lambda i: F.get(f"p{k}", i)

    def one(value: Column, i: Column) -> Column:
        return F.struct(F.lit(k).alias("kind"), i.alias("i"), value.alias("value"), F.length(piece(i)).cast("bigint").alias("gap"), F.right(piece(i), F.lit(rule.reach)).alias("before"))

    return F.transform(f"m{k}", one)


def occurrences(docs: DataFrame, rule: Bootstrap = Bootstrap()) -> DataFrame:
    """Valid base spans and free candidates: doc_id, tid, kind, start, end (code points), value and pattern.

    Matches and the pieces of text between them give the places by a running sum over a document's matches.
    """
    rows = docs.select("doc_id", F.xxhash64(whole(F.col("text"))).alias("tid"), whole(F.col("text")).alias("t"))
    rows = rows.select("*", *[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(f"m{k}") for k, p in enumerate(SHAPES)])
    rows = rows.select("doc_id", "tid", *[f"m{k}" for k in range(len(SHAPES))], *[F.when(F.size(f"m{k}") > 0, F.split("t", p, -1)).alias(f"p{k}") for k, p in enumerate(SHAPES)])
    found = [_matches(k, rule) for k in range(len(SHAPES))]
    # The outer form, because the plain one would have the optimizer evaluate all matches once more in a filter.
    each = rows.select("doc_id", "tid", F.explode_outer(F.concat(*found)).alias("x")).where("x is not null").select("doc_id", "tid", "x.*")
    each = each.repartition("doc_id", "tid").dropDuplicates(["doc_id", "tid", "kind", "i"])
    so_far = Window.partitionBy("doc_id", "tid", "kind").orderBy("i")
    size = F.length("value")
    placed = each.select("*", (F.sum(F.col("gap") + size).over(so_far) - size).alias("start")).select("*", (F.col("start") + size).cast("bigint").alias("end"))
    valid = placed.where(_valid(F.col("kind"), F.col("value")))
    order = Window.partitionBy("doc_id", "tid").orderBy("start", "kind")
    base = F.col("kind") < 4
    left = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    right = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    free = valid.select("*", left.alias("left"), right.alias("right")).where(base | ((F.coalesce("left", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("right") >= F.col("end"), F.lit(True)))))
    said = F.regexp_extract(F.lower("before"), "((?:\\p{L}+[^\\p{L}\\p{N}]{1,3}){1,2})$", 1)
    return free.select("doc_id", "tid", "kind", "start", "end", F.lower("value").alias("value"), F.btrim(F.regexp_replace(said, "[^\\p{L}]+", " ")).alias("pattern"))


def confident(spans: DataFrame, rule: Bootstrap = Bootstrap()) -> DataFrame:
    """The confident patterns, from the graph of distinct (pattern, instance) pairs, after the rounds of scoring."""
    edges = stored(spans.where("pattern != ''").groupBy("pattern", "value").agg(F.max(F.when(F.col("kind") < 4, 1.0).otherwise(0.0)).alias("seed")))
    seeds = edges.groupBy("value").agg(F.max("seed").alias("seed"))
    scored, before, patterns = seeds.select("value", F.col("seed").alias("score")), (-1, 0.0), None
    for _ in range(rule.rounds):
        each = edges.join(scored, "value")
        last, patterns = patterns, stored(
            each.groupBy("pattern")
            .agg(F.sum("score").alias("mass"), F.count("*").alias("n"), F.count(F.when(F.col("score") >= rule.confidence, True)).alias("support"))
            .select("pattern", "support", (F.col("mass") / (F.col("n") + 1)).alias("confidence"))
            .where(f"support >= {rule.seeds} and confidence >= {rule.confidence}")
        )
        if last is not None:
            dropped(last)
        # Scores and confidences only rise, so that the sum's change bounds each one's.
        found = tuple(patterns.agg(F.count("*"), F.coalesce(F.sum("confidence"), F.lit(0.0))).first())
        if found[0] == before[0] and found[1] - before[1] < rule.settled:
            break
        before = found
        gained = edges.join(patterns, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(1.0000001 - F.col("confidence"))))).alias("gain"))
        scored = seeds.join(gained, "value", "left").select("value", F.greatest("seed", F.coalesce("gain", F.lit(0.0))).alias("score"))
    else:
        raise RuntimeError(f"scores have not settled after {rule.rounds} rounds")
    dropped(edges)
    return patterns


def pii(docs: DataFrame, rule: Bootstrap = Bootstrap()) -> DataFrame:
    """doc_id and found, array<struct<start, kind, end>> in order, for every row of docs; kind by KINDS.

    Null text counts as empty. Spans of different kinds that start together are ordered by kind. Rows of equal doc_id and
    text, a null doc_id included, get the same result; a very long text is one row of matches; an empty table gives no
    rows; extra columns are left out.
    """
    spans = stored(occurrences(docs, rule))
    patterns = confident(spans, rule)
    more = spans.where("kind = 4").join(patterns.select("pattern"), "pattern", "left_semi")
    every = spans.where("kind < 4").select("doc_id", "tid", "start", "kind", "end").unionByName(more.select("doc_id", "tid", "start", "kind", "end"))
    by = every.groupBy("doc_id", "tid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    at = docs.select("doc_id", F.xxhash64(whole(F.col("text"))).alias("tid")).alias("d")
    out = at.join(by.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.tid = f.tid"), "left")
    return out.select("d.doc_id", F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("found"))


def digests(found: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("bigint")
    base = F.filter("found", lambda x: x["kind"] < 4)
    return found.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", shown), ",").alias("spans"), count(4).alias("n_ctx"),
    )
