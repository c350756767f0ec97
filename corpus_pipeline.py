"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder
and rereads as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from feedlens.llm.common import dropped, scratch, stored

#: The stages aren't all expressible in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


#: In every stage a row travels as one struct beside what the operator reads, so that no column of docs clashes with an
#: operator's own, and all come back as they were.


def _carried(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[F.col(c) for c in names])


def _columns(docs: DataFrame) -> list:
    return [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the verdict is a projection, so no row moves.

    Null and empty texts have no words and go. Repeated rows and rows of a null doc_id are judged by their text; very long
    texts too; an empty table stays empty.
    """
    return quality.passing(docs)


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of like lines one stays; a document that held words and keeps none goes.

    The first place by (doc_id, line) keeps the line. Null and empty texts stay; rows of a null doc_id lose their own
    repeated lines alone; repeated rows get the same text; an empty table stays empty. n_chars is counted again.
    """
    out = line_dedup.line_dedup(_carried(docs, "doc_id", "text"), ["_row"]).where("n_lines = 0 or n_removed < n_lines")
    new = F.col("kept_text")
    replaced = {"text": new.alias("text"), "n_chars": F.length(new).cast("bigint").alias("n_chars")}
    return out.select(*[replaced.get(c, column) for c, column in zip(docs.columns, _columns(docs), strict=True)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id, and one of repeated equal rows.

    Null and empty texts are nobody's copies and stay, as do rows of a null doc_id; an empty table stays empty.
    """
    kept = stored(near_dedup.near_duplicates(docs).where("kept").groupBy("doc_id").agg(F.count("*").alias("n")))
    once = docs.join(kept.where("n = 1").hint("merge"), "doc_id", "left_semi")
    # Rows of repeated ids alone are compared by their text.
    again = docs.join(kept.where("n > 1"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    out = once.unionByName(again).unionByName(docs.where("doc_id is null"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts hold none and stay; repeated rows and rows of a null doc_id are judged by their text; an empty
    table stays empty.
    """
    found = decontaminate.contamination(_carried(docs, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["_row"])
    return found.where(F.size("words") == 0).select(*_columns(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document carries the rate at which the sampler is to draw it, so that domains meet their target weights;
    those of rate 0, which are never drawn, go, which leaves all totals as they are.

    Null and empty texts have the rate of no feature; repeated rows and rows of a null doc_id are rated by their text; an
    empty table stays empty; a column of docs named rate gives way.
    """
    rated = mixing.mixed(_carried(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["_row"])
    kept = [column for c, column in zip(docs.columns, _columns(docs), strict=True) if c != "rate"]
    return rated.where("rate > 0").select(*kept, F.round("rate", 6).alias("rate"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", fuzzy_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and reread; what a stage leaves behind goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scratch() as kept:
            before, docs = docs, stored(stage(spark, docs, sf_dir))
            kept.append(docs)
        dropped(before)
    return docs
