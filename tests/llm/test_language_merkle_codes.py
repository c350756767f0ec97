"""Language ID, the Merkle manifest and vector codes against brute force, SQL, held-out accuracy and edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.llm import language, merkle, queries, vector_codes
from tests.compare import oracle, same
from tests.llm import brute

DOCUMENTS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# language ID


def test_grams_against_brute_force():
    def shown(key: int) -> str:
        codes = [key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF]
        return "".join(" " if c == 0 else chr(c) for c in codes if c != 0x1FFFFF)

    texts = ["", "a", " ab, c\n", "É é-ß2x_İ", "日本 語", "a" * 600_000 + " b"]
    texts.append("".join(random.Random(3).choice("abcé ,ñ1") for _ in range(700_000)))
    for text in texts:
        keys, n = language.grams(text)
        assert {shown(int(k)): int(c) for k, c in zip(keys, n, strict=True)} == dict(brute.gram_counts(text))
        assert (np.diff(keys) > 0).all()


def test_languages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60)
    rule = language.Ranks(size=50)
    rows = docs.collect()
    odd = ["", None, "123 !?", "zzz", "der die das", "the the", "w " * 40_000]
    asked = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate([*[r.text for r in rows], *odd, *odd])], "doc_id bigint, text string, lang_pred string, row int")
    found = language.identified(asked, language.learned(docs, rule))
    assert found.columns == ["doc_id", "text", "row", "lang_pred", "score"]
    got = [(r.lang_pred, r.score) for r in found.orderBy("doc_id").collect()]
    assert got == brute.languages([(r.text, r.lang) for r in rows], [*[r.text for r in rows], *odd, *odd], 50)


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("true"))
    found = queries.op11_language_id(spark, sf)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    met = found.where("held_out").join(docs, "doc_id").agg(F.count("*").alias("n"), F.avg((F.col("true") == F.col("lang_pred")).cast("double")).alias("right")).first()
    assert met.n > 150 and met.right >= 0.98 and found.count() == 1000


def test_language_without_rows_labels_or_letters(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    nothing = language.learned(none)
    docs = spark.createDataFrame([(1, "some words", None), (None, None, "en")], "doc_id bigint, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.identified(docs, nothing).collect()} == {("und", 0.0)}
    assert language.identified(none, nothing).count() == 0
    one = language.learned(spark.createDataFrame([("ab", "xx"), ("ab", "xx"), (None, "yy"), ("cd", None), ("1", "zz")], "text string, lang string"))
    assert one.names == ("xx",)
    assert language.identified(docs, one).where("lang_pred = 'xx' and score >= 0 and score <= 1").count() == 1
    with pytest.raises(ValueError, match="more than 1 languages"):
        language.learned(spark.createDataFrame([("ab", "xx"), ("cd", "yy")], "text string, lang string"), language.Ranks(most_languages=1))


def test_held_out_is_by_the_id_alone(spark):
    import zlib

    ids = spark.range(50).withColumn("h", language.held_out(F.col("id"))).collect()
    assert [r.h for r in ids] == [zlib.crc32(str(r.id).encode()) % 4 == 2 for r in ids]
    assert spark.sql("select cast(null as bigint) id").select(language.held_out(F.col("id"))).first()[0] is False


# Merkle manifest


def made(n: int, sources: int) -> list[tuple]:
    rng = random.Random(n)
    rows = []
    for k in range(n):
        source = rng.choice([None, "", "é", "Z", "a", "ü"]) if k % 3 == 0 else "hot" if k % 3 == 1 else f"s{rng.randrange(sources)}"
        rows.append((k, source, rng.choice(["en", None, ""]), rng.choice([None, k]), rng.choice([None, "", f"Text {k} É", "ABC " * 50])))
    rows += [(None, "hot", "en", 1, "x"), (None, None, None, None, None), (5, "hot", "en", 1, "again"), (5, "hot", "en", 1, "again"), (-3, "lone source", "de", 2, "Y" * 100_000)]
    return rows


@pytest.mark.parametrize(("n", "sources"), [(1, 1), (700, 3), (1500, 400)])
def test_manifest_against_brute_force(spark, n, sources):
    """Small blocks make more rounds, with last subtrees of every size."""
    rows = made(n, sources)
    docs = spark.createDataFrame(rows, DOCUMENTS).select("*", F.lit(1).alias("leaf"), F.lit("x").alias("root"), F.lit(2).alias("block")).repartition(3)
    assert rows_of(merkle.manifest(docs, merkle.Tree(inner=1))) == sorted(brute.merkle(rows), key=str)


def test_manifest_of_whole_blocks(spark):
    rows = [(k, "a", "en", k, f"T{k}") for k in range(4500)] + [(k, f"b{k % 300}", "en", k, "x") for k in range(4500, 5000)]
    assert rows_of(merkle.manifest(spark.createDataFrame(rows, DOCUMENTS))) == sorted(brute.merkle(rows), key=str)


def test_manifest_of_nothing(spark):
    out = merkle.manifest(spark.createDataFrame([], DOCUMENTS))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 0


def test_manifest_against_sql(spark, sf_dir):
    same(queries.op12_merkle_manifest(spark, sf_dir).toPandas(), oracle(sf_dir, queries.ORACLES["op12_merkle_manifest"]))


def test_a_path_reads_back():
    way = merkle.way(merkle.levels_of([f"{k:064x}" for k in range(40)], True, merkle.Tree()), 33, merkle.Tree())
    assert merkle.steps("".join(map(str, way))) == way and len(way) == 2 and way[0].place == 1


# vector codes


def test_products_are_exact():
    rng = np.random.default_rng(5)
    for most in (3, 1 << 14, 1 << 27, (1 << 29) - 1):
        x, y = rng.integers(-most, most + 1, (3, 50, 8)), rng.integers(-most, most + 1, (3, 16, 8))
        right = np.einsum("pnw,pew->pne", x.astype(object), y.astype(object))
        assert (vector_codes.products(x, y, 15).astype(object) == right).all()
    assert [d.tolist() for d in vector_codes.limbs(np.array([-1, 0, 1 << 15, -(1 << 28)]), 15)][0] == [-1.0, 0.0, 0.0, 0.0]


def vectors(n: int, width: int, rng: random.Random, large: float = 1.0) -> list[tuple]:
    rows = [(k, [float(np.float32(rng.uniform(-large, large))) for _ in range(width)], rng.choice([None, 1, 1, 1, 2])) for k in range(n)]
    rows += [(None, rows[0][1], 7), (3, rows[1][1], None), (3, rows[2][1], 1), (900, rows[0][1], 1), (901, None, 1), (902, [None] * width, 1)]
    rows += [(903, [float("nan")] * width, 1), (904, [float("inf"), *[0.0] * (width - 1)], 2), (905, [0.0] * width, 2), (906, [0.0] * width, 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "width", "large"), [(3, 8, 1.0), (120, 16, 1.0), (60, 24, 20_000.0)])
def test_codes_against_brute_force(spark, n, width, large):
    rows = vectors(n, width, random.Random(n), large)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").select("*", F.lit(1).alias("x"), F.lit("y").alias("code")).repartition(3)
    assert rows_of(vector_codes.vector_codes(df)) == sorted(brute.vector_codes(rows), key=str)


def test_codes_against_sql(spark, sf_dir):
    same(queries.op13_vector_codes(spark, sf_dir).toPandas(), oracle(sf_dir, queries.ORACLES["op13_vector_codes"]))


def test_codes_of_nothing_and_of_unlike_vectors(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    assert vector_codes.vector_codes(spark.createDataFrame([], kind)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1), (2, [None], 1)], kind)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], kind))
    with pytest.raises(Exception, match="don't fit into 64 bits"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e30] * 8, 1)], kind))
