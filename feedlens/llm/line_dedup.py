"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard verification, distributed union-find."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm import rolling
from feedlens.llm.common import WHITE, dropped, stored
from feedlens.llm.similar import linked

SHINGLE = 7
PERCENT = 80
#: At a similarity of 0.8 a pair of lines shares none of the 12 bands of 4 coordinates with a probability of 0.002.
ROWS = 4
BANDS = 12
#: Parities kept of lines that round two compares.
MAP = 2048

_POINTS = 0xA24BAED4963EE407


def _points(s: rolling.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of a slice of lines, where each line begins in them, and where its shingles begin among all: a line of
    fewer characters than a shingle is its only one."""
    points = np.frombuffer(s.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum((s.data & 0xC0) != 0x80, out=lead[1:])
    offset = lead[s.offset]
    first = np.zeros(s.rows + 1, np.int64)
    np.cumsum(np.maximum(np.diff(offset) - SHINGLE + 1, 1), out=first[1:])
    return points, offset, first


def _scattered(s: rolling.Slice) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit number for each shingle of each line, repeats included, and where each line's begin: what banding needs."""
    points, offset, first = _points(s)
    values = points * np.uint32(0x9E3779B1)
    values ^= values >> np.uint32(15)
    n = max(len(points) - SHINGLE + 1, 0)
    out = values[:n].copy()
    for k in range(1, SHINGLE):
        out *= np.uint32(0x01000193)
        out += values[k : n + k]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA77)
    out ^= out >> np.uint32(13)
    inside = np.ones(n, bool)  # not across the end of a line
    across = (offset[1:, None] - np.arange(1, SHINGLE)).reshape(-1)
    inside[across[(across >= 0) & (across < n)]] = False
    short = np.flatnonzero(np.diff(offset) < SHINGLE)
    found = np.empty(first[-1], np.uint32)
    own = np.zeros(first[-1], bool)
    own[first[short]] = True
    found[~own] = out[inside]
    found[own] = [zlib.crc32(s.text(k)) for k in short.tolist()]
    return found, first


def _shingles(s: rolling.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the shingles of each line of a slice, repeats included, and where each line's begin."""
    points, offset, first = _points(s)
    values = rolling.mixed(points.astype(np.uint64) * np.uint64(_POINTS) + np.uint64(1))
    count = np.diff(first)
    at = np.arange(first[-1]) + np.repeat(offset[:-1] - first[:-1], count)
    return rolling.hash_of_ranges(values, at, np.minimum(at + SHINGLE, np.repeat(offset[1:], count)), rolling._WORD_BASE), first


def line_sets(s: rolling.Slice) -> tuple[np.ndarray, np.ndarray]:
    return rolling.distinct_of_each(*_shingles(s))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) of lines to (id, bands)."""
    for batch in batches:
        for s in rolling.slices(batch.column(1)):
            scattered, first = _scattered(s)
            keys = rolling.bands(rolling.minhash(scattered, first[:-1], ROWS * BANDS), ROWS)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), rolling.list_array(np.full(s.rows, BANDS), keys.reshape(-1))], names=["id", "bands"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, marks array<struct<line, component>>) to row, n_lines, n_removed and what is left of the text: without
    the lines marked without a component, and with the first line alone of each component and of its own repeats."""
    for batch in batches:
        counts, removed, texts = [], [], []
        for text, marks in zip(batch.column(1), batch.column(2), strict=True):
            lines = text.as_py().split("\n") if text.is_valid else []
            worded = [line for line in lines if line.strip(WHITE)]
            if not marks.is_valid and len(set(worded)) == len(worded):
                counts.append(len(worded))
                removed.append(0)
                texts.append(text.as_py())
                continue
            component = {m["line"]: m["component"] for m in marks.as_py() or ()}
            kept, seen, n, cut = [], set(), 0, 0
            for k, line in enumerate(lines):
                if line.strip(WHITE):
                    n += 1
                    name = component.get(k, line)
                    if name is None or name in seen:
                        cut += 1
                        continue
                    seen.add(name)
                kept.append(line)
            counts.append(n)
            removed.append(cut)
            texts.append("\n".join(kept) if text.is_valid else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["row", "n_lines", "n_removed", "kept_text"])


def _digest(text: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def line_dedup(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default), n_lines (lines with a word), n_removed and kept_text.

    Lines are parted by \\n. Lines of equal text, and lines whose sets of 7-character shingles have a Jaccard similarity
    of 0.8 or more, form components; of each the line of the smallest (doc_id, line number) stays, all others go.
    Each distinct line has a number of its own, under which it is banded, compared and connected; documents find their
    lines' fate again by 128 bits of SHA-256. Lines without a word stay. Null text stays null, with no lines; an empty text
    has no lines; rows of a null doc_id lose only their own repeated lines. Repeated rows get the same result, and rows of
    one doc_id and different texts each keep a line whose component begins in that doc_id. A very long text is one row, and
    a very long line one set. An empty table gives no rows; columns of docs named as the added ones give way to them.
    """
    kept = [c for c in (keep or docs.columns) if c not in ("n_lines", "n_removed", "kept_text")]
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))
    each = rows.where("doc_id is not null").select("doc_id", "tid", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.ltrim("text", F.lit(WHITE)) != "")
    # One row for each distinct line, with its first document; copies of any number cost one comparison from here on.
    distinct = each.groupBy("text").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    lines = stored(distinct.select(F.monotonically_increasing_id().alias("id"), "low", "n", _digest(F.col("text")).alias("digest"), "text"))
    profiles = stored(lines.select("id", "text").mapInArrow(_banded, "id bigint, bands array<bigint>"))

    def fetch(ids: DataFrame) -> DataFrame:
        return stored(lines.select("id", "text").join(ids, "id", "left_semi"))

    found = linked(profiles, fetch, line_sets, PERCENT, MAP)
    dropped(profiles)
    # Lines of a component, and others that repeat as components of their own; their texts aren't read again.
    known = lines.select("id", "low", "n", "digest").join(found, "id", "left").where("n > 1 or component is not null")
    met = stored(known.select("digest", "low", F.coalesce("component", "id").alias("component"), F.col("component").isNotNull().alias("linked")))
    heads = met.where("linked").groupBy("component").agg(F.min("low").alias("head"))
    fates = stored(met.join(heads, "component", "left").select("digest", "component", F.coalesce("head", "low").alias("head")))
    dropped(lines, found, met)
    met = each.select("doc_id", "tid", "line", _digest(F.col("text")).alias("digest")).join(fates, "digest")
    mark = F.struct("line", F.when(F.col("doc_id") == F.col("head"), F.col("component")).alias("component"))
    marks = met.groupBy("doc_id", "tid").agg(F.collect_set(mark).alias("marks"))
    joined = rows.join(marks, ["doc_id", "tid"], "left").select("row", "text", "marks")
    shape = f"row {joined.schema['row'].dataType.simpleString()}, n_lines bigint, n_removed bigint, kept_text string"
    return joined.mapInArrow(_cut, shape).select(*[F.col(f"row.`{c}`") for c in kept], "n_lines", "n_removed", "kept_text")
