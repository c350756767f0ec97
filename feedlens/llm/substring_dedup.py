"""Substring dedup: Rabin-Karp hashes of every 50-word window, counted in Spark, merged into removal intervals.

Counting is done in two grains, so that a window that nobody repeats isn't shuffled by itself. Every window belongs
to one run: the consecutive windows that share their least 20-word gram (the run's anchor). Equal windows have
equal anchors, so an anchor that only one document holds settles the count of all its windows; the windows of the
other anchors are counted one by one. Documents of the same word sequence are counted through their first copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm import rolling
from feedlens.llm.common import dropped, stored

WINDOW = 50
GRAM = 20


def _anchors(w: rolling.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each window starts, and the least gram hash inside it."""
    at, hashes = rolling.windows(w, gram)
    if len(w.hash) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.full(len(w.hash), np.iinfo(np.uint64).max, np.uint64)
    grams[at] = hashes
    least = rolling.least_of_each(grams[: len(w.hash) - gram + 1], window - gram + 1)
    start = np.flatnonzero(w.doc[window - 1 :] == w.doc[: len(w.doc) - window + 1])
    return start, least[start]


def _profile(window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in rolling.slices(batch.column(2)):
                w = rolling.words(s)
                start, anchor = _anchors(w, window, gram)
                doc = w.doc[start]
                new = np.ones(len(start), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                size = np.bincount(doc[new], minlength=s.rows)
                kept = [hashlib.sha256(b" ".join(s.text(k).split())).hexdigest() for k in range(s.rows)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(s.first, s.rows) for k in (0, 1)), pa.array(w.count.astype(np.int64)), pa.array(kept), rolling.list_array(size, anchor[new])],
                    names=["doc_id", "tid", "n_words", "kept_sha256", "anchors"],
                )

    return run


def _runs(window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, tid, text, anchors) to the runs of the named anchors: place, digest and window hashes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in rolling.slices(batch.column(2)):
                w = rolling.words(s)
                start, anchor = _anchors(w, window, gram)
                named = np.asarray(batch.column(3).slice(s.first, s.rows).flatten()).view(np.uint64)
                inside = np.isin(anchor, named)
                start, anchor = start[inside], anchor[inside]
                if not len(start):
                    continue
                values = rolling.mixed(rolling.hash_of_ranges(w.hash, start, start + window, rolling._WORD_BASE))
                new = np.ones(len(start), bool)
                new[1:] = (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (w.doc[start[1:]] != w.doc[start[:-1]])
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(start))
                digest = rolling.mixed(rolling.hash_of_ranges(values, begin, end, rolling._BASE) + (end - begin).astype(np.uint64))
                doc = w.doc[start[begin]]
                rows = pa.array(doc + s.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(anchor[begin].view(np.int64)), pa.array(digest.view(np.int64)),
                     pa.array(start[begin] - w.first[doc]), pa.array((end - begin).astype(np.int64)), rolling.list_array(end - begin, values)],
                    names=["doc_id", "tid", "anchor", "digest", "pos", "n", "hashes"],
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tid, text, spans array<struct<pos, size>>) to what is left of each document."""
    for batch in batches:
        removed, digest, kept = [], [], []
        for text, spans in zip(batch.column(2), batch.column(3), strict=True):
            words = (text.as_py() or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            flat = spans.values
            np.add.at(gone, np.asarray(flat.field(0)), 1)
            np.add.at(gone, np.asarray(flat.field(1)), -1)
            hit = np.cumsum(gone)[:-1] > 0
            left = b" ".join(x for x, h in zip(words, hit.tolist(), strict=True) if not h)
            removed.append(int(hit.sum()))
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "tid", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document; with texts also kept_text, null where nothing goes.

    A word goes if a window that covers it also starts in a document of a smaller doc_id; all windows are judged on
    the input. Null and empty texts have no words. A null doc_id neither removes nor loses anything. Repeated rows each get
    a row with the same result, and rows of one doc_id don't remove each other's words; a very long text is one row of
    windows; an empty table gives no rows; extra columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tid"), F.col("text").cast("string").alias("text"))
    seen = stored(docs.mapInArrow(_profile(window, gram), "doc_id bigint, tid bigint, n_words bigint, kept_sha256 string, anchors array<bigint>"))
    long = seen.where(f"n_words >= {window} and doc_id is not null")
    first = long.groupBy("kept_sha256").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    copies = long.select("doc_id", "tid", "kept_sha256").join(first.where("low < high"), "kept_sha256").where("doc_id > low").select("doc_id", "tid", F.lit(True).alias("copy")).distinct()
    copies = stored(copies)
    anchors = long.join(copies, ["doc_id", "tid"], "left_anti").select("doc_id", "tid", F.explode("anchors").alias("anchor"))
    # Stored, so that Spark may split the join that follows where an anchor is hot: it doesn't where a join shares its shuffle
    # with a count.
    shared = stored(anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"))
    named = anchors.join(shared, "anchor").groupBy("doc_id", "tid").agg(F.collect_set("anchor").alias("anchors"))
    some = stored(docs.where("doc_id is not null").join(named, ["doc_id", "tid"]).select("doc_id", "tid", "text", "anchors"))
    runs = stored(some.mapInArrow(_runs(window, gram), "doc_id bigint, tid bigint, anchor bigint, digest bigint, pos bigint, n bigint, hashes array<bigint>"))
    # Runs of the same windows: all but those of the smallest document are repeats from end to end.
    same = stored(runs.groupBy("anchor", "digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
    narrow = runs.select("doc_id", "tid", "anchor", "digest", "pos", "n")
    repeats = narrow.join(same.where("low < high"), ["anchor", "digest"]).where("doc_id > low").select("doc_id", "tid", "pos", (F.col("pos") + F.col("n") + (window - 1)).alias("stop"))
    # Anchors with several such runs: what their first documents share is counted window by window.
    several = same.groupBy("anchor").agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.min("low").alias("c"), F.max("low").alias("d")).where("a != b and c != d").select("anchor")
    firsts = runs.join(same.join(several, "anchor").select("anchor", "digest", F.col("low").alias("doc_id")), ["anchor", "digest", "doc_id"])
    singles = stored(firsts.select("anchor", "doc_id", "tid", "pos", F.posexplode("hashes").alias("k", "hash")))
    counted = stored(singles.groupBy("anchor", "hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high"))
    later = singles.join(counted, ["anchor", "hash"]).where("doc_id > low").select("doc_id", "tid", (F.col("pos") + F.col("k")).alias("pos"))
    spans = repeats.unionByName(later.select("doc_id", "tid", "pos", (F.col("pos") + window).alias("stop")))
    spans = stored(spans.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("pos", "stop")).alias("spans")))
    sizes = stored(seen.drop("anchors"))
    dropped(seen, shared, runs, same, singles, counted)
    cut = some.join(spans, ["doc_id", "tid"]).select("doc_id", "tid", "text", "spans")
    cut = cut.mapInArrow(_cut, "doc_id bigint, tid bigint, n_removed bigint, kept_sha256 string, kept_text string").dropDuplicates(["doc_id", "tid"])
    if not texts:
        cut = cut.drop("kept_text")
    out = sizes.join(cut.withColumnRenamed("kept_sha256", "left_sha256"), ["doc_id", "tid"], "left").join(copies, ["doc_id", "tid"], "left")
    nothing = F.sha2(F.lit(""), 256)
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("left_sha256", "kept_sha256")).alias("kept_sha256"),
        *([F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if texts else []),
    )
