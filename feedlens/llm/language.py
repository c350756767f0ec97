"""Language identification by rank-order profiles: the most frequent letter n-grams of a document against those of each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The prediction for a text without a letter.
UNKNOWN = "und"
#: An n-gram of one to three characters is one 63-bit number, 21 bits a character: 0 is the edge of a word, _NONE no character.
_BITS = 21
_NONE = (1 << _BITS) - 1
#: Positions whose n-grams are sorted at once, and n-grams of a task that are held before they are passed on.
_CHUNK = 1 << 18
_HELD = 1 << 20


@dataclass(frozen=True)
class Ranks:
    """size: n-grams of a profile. most_languages: profiles that a task holds; more is an error, nothing is left out."""

    size: int = 400
    most_languages: int = 2000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point the lower case of a letter, and 0 for anything else."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of the words of a text in ascending order, and how often each occurs.

    A word is a run of letters in lower case, with an edge before and after it. A long text is counted piece by piece, so
    that memory beyond some bytes a character is bounded.
    """
    points = np.zeros(len(text) + 2, np.uint32)
    points[1:-1] = _letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    kept = points != 0
    kept[1:] |= kept[:-1].copy()
    kept[0] = True
    # Letters with one edge between words, before the first and after the last; the last position begins no n-gram.
    points = np.append(points[kept], np.uint32(0))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(points) - 2, _CHUNK):
        p = points[at : min(at + _CHUNK, len(points) - 2) + 2].astype(np.int64)
        a, b, c = p[:-2], p[1:-1], p[2:]
        pair = (a << 2 * _BITS) | (b << _BITS)
        keys = np.concatenate([(a[a > 0] << 2 * _BITS) | (_NONE << _BITS) | _NONE, pair | _NONE, (pair | c)[b > 0]])
        found.append(np.unique(keys, return_counts=True))
    return merged(found)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of counted n-grams."""
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, np.concatenate([n for _, n in parts]))
    return keys, total


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), added up in the task as far as memory allows."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (keys, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(keys), np.int64))), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        texts = pa.table({"lang": batch.column(0), "text": batch.column(1)}).group_by("lang").aggregate([("text", "list")])
        for lang, own in zip(texts["lang"].to_pylist(), texts["text_list"].to_pylist(), strict=True):
            held[lang] = merged([*([held[lang]] if lang in held else []), grams("\n".join(own))])
        if sum(len(k) for k, _ in held.values()) > _HELD:
            yield from out()
    yield from out()


def profiles(docs: DataFrame, rule: Ranks = Ranks()) -> DataFrame:
    """lang, gram, rank: the most frequent n-grams of each language over all rows of docs (text, lang), from rank 0.

    Rows of a null text or lang teach nothing; ties go to the smaller n-gram; repeated rows count as often as they occur.
    Counts are added up in each task before they are shuffled by n-gram, and ranked in parts before they meet by language.
    """
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    total = texts.mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    for part in (("lang", F.pmod("gram", F.lit(16))), ("lang",)):
        total = total.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("rank") <= rule.size)
    return total.select("lang", "gram", (F.col("rank") - 1).cast("int").alias("rank"))


@dataclass(frozen=True)
class Profiles:
    """All languages by name, all n-grams of their profiles in order, and the rank of each in each; size: not in it."""

    size: int
    names: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray

    def nearest(self, text: str) -> tuple[str, float]:
        """The language of the least out-of-place distance, and how much nearer it is than the next one, from 0 to 1.

        Each of the text's most frequent n-grams is out of place by the difference of its ranks, or by the profile's size
        where the language doesn't have it. Ties go to the first name; where one language is known the other is as far as
        can be; without a letter, or a language, the result is `und` and 0.
        """
        keys, n = grams(text)
        if not len(keys) or not self.names:
            return UNKNOWN, 0.0
        top = keys[np.argsort(-n, kind="stable")[: self.size]]
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        ranks = np.where((self.grams[at] == top)[:, None], self.ranks[at], self.size)
        away = np.where(ranks < self.size, np.abs(ranks - np.arange(len(top))[:, None]), self.size).sum(0)
        best = int(np.argmin(away))
        rest = min([*np.delete(away, best).tolist(), len(top) * self.size])
        return self.names[best], 1 - int(away[best]) / rest if rest else 0.0


def learned(docs: DataFrame, rule: Ranks = Ranks()) -> Profiles:
    """The profiles of docs as a task holds them: rule.size rows a language, so some megabytes for hundreds of languages."""
    names = sorted(r.lang for r in docs.where("lang is not null").select(F.col("lang").cast("string").alias("lang")).distinct().limit(rule.most_languages + 1).collect())
    if len(names) > rule.most_languages:
        raise ValueError(f"there are more than {rule.most_languages} languages")
    found = profiles(docs, rule).toPandas()
    names = [x for x in names if x in set(found["lang"])]
    keys = np.unique(found["gram"].to_numpy(np.int64))
    ranks = np.full((len(keys), len(names)), rule.size, np.int64)
    ranks[np.searchsorted(keys, found["gram"].to_numpy(np.int64)), [names.index(x) for x in found["lang"]]] = found["rank"]
    return Profiles(rule.size, tuple(names), keys, ranks)


def identified(docs: DataFrame, known: Profiles, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default), lang_pred and score, from the text alone.

    Null and empty texts, and those without a letter, are `und` with a score of 0; repeated rows get the same result; a very
    long text is counted in pieces; an empty table stays empty. Columns of docs named as the added ones give way to them.
    """
    kept = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("text").cast("string").alias("text"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [known.nearest(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["row", "lang_pred", "score"])

    out = rows.mapInArrow(named, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(*[F.col(f"row.`{c}`") for c in kept], "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """Whether a document is left out of learning: crc32 of its id as text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
