"""What the methods of PII and licence scans find beyond the base, on planted cases and against brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from feedlens.llm import chat, common, decontaminate, licenses, mixing, pii, secrets
from tests.llm.test_llm import prose


def test_pii_scores_run_to_their_fixpoint(spark):
    """Nine mails make "contact" a pattern at 0.6; "badge" reaches it only after some rounds in which no pattern is added."""
    said = [f"please contact user{k}@mail.org now" for k in range(9)] + [f"please contact ST-{k}-77120 now" for k in range(5)] + [f"use badge ST-{k}-77120 here" for k in range(5)] + ["use badge QX-9-55510 here", "page 1234567"]
    out = pii.pii(spark.createDataFrame(list(enumerate(said)), "doc_id bigint, text string"))
    kinds = {r.doc_id: [s.kind for s in r.found] for r in out.collect()}
    assert kinds[19] == [4] and kinds[14] == [4] and kinds[20] == []


def test_pii_precision_and_recall_on_planted_identifiers(spark):
    """Staff numbers behind phrases that mails also follow, in prose that holds other numbers behind many other words."""
    rng = random.Random(11)
    rows, planted = [], set()
    lead = ["reach me at", "write to desk", "signed by officer"]
    for k in range(3000):
        text, kind = prose(rng, 40), k % 6
        if kind < 3:
            text += f" {rng.choice(lead)} user{k}@mail{k % 7}.org and so on"
        elif kind == 3:
            text += f" {rng.choice(lead)} EMP-{100000 + k} and so on"
            planted.add(k)
        else:
            text += f" {rng.choice(['counted', 'page', 'since', 'about'])} {rng.choice(['some', 'the', 'near'])} {200000 + k} of it"
        rows.append((k, text))
    out = pii.pii(spark.createDataFrame(rows, "doc_id bigint, text string")).where(F.exists("found", lambda s: s["kind"] == 4))
    found = {r.doc_id for r in out.collect()}
    assert len(found & planted) >= 0.95 * len(planted) and len(found - planted) <= 0.02 * len(found)


def test_neighbouring_spellings(spark):
    said = ["a licence licence licence b", "programme programme", "Owner owners OWNER"]
    out = [r.c for r in spark.createDataFrame([(s,) for s in said], "t string").select(licenses.canonical(F.col("t")).alias("c")).collect()]
    assert out == ["a license license license b", "program program", "holder holders holder"]


def test_long_licences_within_documents_against_brute_force(spark):
    rng = random.Random(5)
    long = [(n, t) for n, t in licenses.KNOWN if len(t) > licenses.LONG]
    picks = [long[k] for k in range(0, len(long), 5)]
    rows = []
    for k, (_, text) in enumerate(picks):
        words = text.split()
        other = rng.choice(long)[1]
        rows += [f"{prose(rng, 30)}\n{text}\n{prose(rng, 30)}", " ".join(words), " ".join(words[:-1]), " ".join(words[: len(words) // 2]) + " license", f"{text}\n{other}", f"{text} {text}", prose(rng, 50) + " permission"]
    rows += ["license " * 5000, "permission", "", None]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").withColumn("digest", F.lit("x"))
    body = {r.doc_id: f" {r.c} " for r in docs.select("doc_id", licenses.canonical(F.coalesce("text", F.lit(""))).alias("c")).collect()}
    table = spark.createDataFrame(long, "name string, text string").select("name", licenses.canonical(F.col("text")).alias("c")).collect()
    brute = {d: {r.name for r in table if f" {r.c} " in b} for d, b in body.items()}
    found = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in licenses.licenses(docs).collect()}
    assert {d: brute[d] - f for d, f in found.items() if brute[d] - f} == {}
    within = docs.select("doc_id", F.lit(0).alias("tid"), F.coalesce("text", F.lit("")).alias("text"))
    windows = {}
    for r in licenses._within(within, licenses.KNOWN).collect():
        windows.setdefault(r.doc_id, set()).add(r.license)
    cued = {d: b for d, b in brute.items() if b}
    assert windows == cued
    plan = licenses._within(within, licenses.KNOWN)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Python" not in plan


def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named as the operators' own."""
    long = "word number " * 60_000
    rows = [(None, "a b c d e f g h i j k", None), (None, None, None), (1, "", "x"), (1, "", "x"), (2, long, "x"), (3, "a b c d e f g h i j k", "x"), (3, "a b c d e f g h i j k", "x"), (4, None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return df.select("*", *[F.lit("mine").alias(c) for c in ("words", "items", "row", "p", "rate", "n_words", "tid", "licenses", "digest", "body", "unit")])


def test_decontamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "A B C D E F G H I J"), (1, "A B C D E F G H I J"), (2, None), (3, ""), (None, "number word"), (4, "word number word")], "item_id bigint, text string")
    out = decontaminate.contamination(odd(spark), bench.withColumn("h", F.lit(1))).select("doc_id", "row", F.size("words").alias("n"), "items", "n_words").collect()
    assert len(out) == 8 and {r.row for r in out} == {"mine"}
    by = {(r.doc_id, r.n, tuple(r["items"]), r.n_words) for r in out}
    assert by == {(None, 10, (1,), 11), (None, 0, (), 0), (1, 0, (), 0), (2, 119_999, (4,), 120_000), (3, 10, (1,), 11), (4, 0, (), 0)}


def test_licenses_of_odd_rows(spark):
    text = max((t for n, t in licenses.KNOWN if n == "ISC"), key=len)
    rows = odd(spark).select("doc_id", "text", "licenses", "tid").unionByName(spark.createDataFrame([(None, text, "", ""), (9, "word " * 100_000 + "permission " + text + " tail" * 50_000, "", ""), (9, text, "", "")], "doc_id bigint, text string, licenses string, tid string"))
    out = licenses.licenses(rows).collect()
    assert len(out) == 11 and sorted((r.doc_id or 0, r.whole_license or "") for r in out if "ISC" in r.licenses) == [(0, "ISC"), (9, ""), (9, "ISC")]


def test_mixing_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 1), (None, 1, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    out = mixing.mixed(odd(spark), labels, keep=["doc_id", "source", "row"]).collect()
    assert len(out) == 8 and {r["row"] for r in out} == {"mine"} and all(len(r.p) == len(mixing.DOMAINS) and r.rate >= 0 for r in out)
    assert len({(r.doc_id, r.n_words, r.rate) for r in out if r.doc_id == 3}) == 1 and {r.n_words for r in out if r.doc_id == 2} == {120_000}
    assert mixing.mixed(odd(spark).limit(0), labels).count() == 0
    alike = mixing.mixed(odd(spark), labels.limit(0)).collect()
    assert len(alike) == 8 and len({tuple(r.p) for r in alike if r.n_words == 0}) == 1


def test_chat_of_odd_rows(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, 0, "user", "x" * 1_000_000), (1, 1, "assistant", ""), (2, None, "user", "q"), (2, 0, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select("*", F.lit(1).alias("segments"), F.lit(2).alias("formatted"))
    out = {r.conv_id: r for r in chat.digests(chat.formatted(turns)).collect()}
    assert {k: (r.n_turns, r.valid) for k, r in out.items()} == {None: (2, False), 1: (2, True), 2: (2, True)} and out[1].formatted_chars > 1_000_000


def test_the_pipeline_leaves_its_result_alone(spark, tmp_path, monkeypatch):
    import corpus_pipeline as cp

    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and len(list(tmp_path.glob("feedlens-*"))) == 1
    with common.scratch() as kept:
        common.stored(spark.range(3))
        two = common.stored(spark.range(4))
        kept.append(two.where("id > 0"))
    assert two.count() == 4 and len(list(tmp_path.glob("feedlens-*"))) == 2
    with common.scratch() as kept:
        none = common.stored(spark.range(3).where("id > 5"))
        kept.append(none)
    assert none.count() == 0


def test_secret_dictionary_from_the_corpus(spark):
    """A name made of words that many identifiers of the corpus hold isn't novel; a random string is, however often it is copied."""
    rng = random.Random(2)
    words = ["quota", "ledger", "shard", "wombat", "tenant", "gamut", "parcel", "vellum", "ostrich", "jigsaw"]
    rows = [(k, f"{prose(rng, 20)} {rng.choice(words)}_{rng.choice(words)} and {rng.choice(words)}{rng.choice(words).capitalize()} {prose(rng, 20)}") for k in range(400)]
    rows += [(k, f"{prose(rng, 20)} secret for Zk3vQ9xT7bLm2RwY8nPs4HdG here") for k in range(1000, 1060)] + [(2000, "the token is vellumOstrich7Jigsaw here"), (2001, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert set(secrets.identifier_parts(docs)) == set(words) and secrets.identifier_parts(docs, secrets.Novelty(parts=3))[0] in words
    found = {r.doc_id: [s.kind for s in r.found] for r in secrets.secret_spans(docs).collect()}
    assert all(found[k] == [3] for k in range(1000, 1060)) and found[2000] == [] and found[2001] == []
    alone = secrets.secret_spans(docs.where("doc_id = 2000")).first()
    assert [s.kind for s in alone.found] == [3]
