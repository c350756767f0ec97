"""MinHash near-dedup: circulant MinHash, banding, exact Jaccard verification and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm import rolling
from feedlens.llm.common import components, dropped, stored
from feedlens.llm.similar import linked

SHINGLE = 5
PERCENT = 75
#: Coordinates of the signature, and of them in a band: at a similarity of 0.75 a pair shares none of the 32 bands
#: with a probability of 5e-6.
COORDINATES = 128
ROWS = 4
#: Parities kept of documents that round two compares.
MAP = 4096


def shingle_sets(s: rolling.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document of a slice, sorted within it, and where each set begins.

    A document of fewer words than a shingle has its whole sequence as its only one; without words it has none.
    """
    w = rolling.words(s, lower=True)
    at, hashes = rolling.windows(w, SHINGLE)
    count = w.count
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    whole = rolling.mixed(rolling.hash_of_ranges(w.hash, w.first[short], w.first[short + 1], rolling._WORD_BASE) + count[short].astype(np.uint64))
    sizes = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    first = np.zeros(s.rows + 1, np.int64)
    np.cumsum(sizes, out=first[1:])
    values = np.empty(first[-1], np.uint64)
    own = np.zeros(first[-1], bool)
    own[first[short]] = True
    values[~own] = hashes
    values[own] = whole
    return rolling.distinct_of_each(values, first)


PROFILE = "doc_id bigint, tid bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>"


def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tid, text) to set sizes, 128-bit set digests and band keys."""
    for batch in batches:
        for s in rolling.slices(batch.column(2)):
            values, first = shingle_sets(s)
            size = np.diff(first)
            some = np.flatnonzero(size)
            starts = first[some]
            keys = rolling.bands(rolling.circulant_minhash(values, starts, COORDINATES), ROWS)
            digest = np.zeros((2, s.rows), np.uint64)
            if len(some):
                digest[0, some] = np.add.reduceat(rolling.mixed(values ^ np.uint64(0x5851F42D4C957F2D)), starts)
                digest[1, some] = np.add.reduceat(rolling.mixed(values + np.uint64(0x14057B7EF767814F)), starts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(s.first, s.rows) for k in (0, 1)), pa.array(size.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in digest),
                 rolling.list_array(np.where(size > 0, COORDINATES // ROWS, 0), keys.reshape(-1))],
                names=["doc_id", "tid", "n_shingles", "d1", "d2", "bands"],
            )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included) and kept.

    Null and empty texts have an empty set and link with nothing; equal sets are one class from the start (told by a
    128-bit digest of the set), so copies of any number cost one comparison. Rows of a null doc_id link with nothing and
    have null component_id and kept false. Repeated rows each get a row; rows of one doc_id and different texts are one
    document in the graph, each with its own set. A very long text is one set. An empty table gives no rows; extra
    columns are left out.
    """
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))
    full = stored(docs.mapInArrow(profile, PROFILE))
    sets = full.where("n_shingles > 0 and doc_id is not null")
    classes = sets.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "tid")).alias("first"), F.any_value("bands").alias("bands"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "d1", "d2", "first.*", "bands"))
    seen = stored(full.drop("bands", "tid"))
    dropped(full)

    def fetch(ids: DataFrame) -> DataFrame:
        asked = classes.select("id", "doc_id", "tid").join(ids, "id")
        return stored(docs.join(asked.hint("merge"), ["doc_id", "tid"]).select("id", "text").dropDuplicates(["id"]))

    found = linked(classes.select("id", "bands"), fetch, shingle_sets, PERCENT, MAP)
    of = stored(seen.where("n_shingles > 0 and doc_id is not null").select("doc_id", "d1", "d2").join(classes.select("id", "d1", "d2"), ["d1", "d2"]).select("doc_id", "id").distinct())
    # A doc_id with several texts connects their classes.
    several = of.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("doc_id", "a")
    joints = stored(of.join(several, "doc_id").where("id != a").select("a", F.col("id").alias("b")))
    if not joints.isEmpty():
        linked_too = found.where("id != component").select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(joints)
        before, found = found, components(linked_too)
        dropped(before)
    named = classes.select("id", "d1", "d2", "doc_id").join(found, "id", "left").select("d1", "d2", "doc_id", F.coalesce("component", "id").alias("component"))
    low = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    low = stored(named.join(low, "component").select("d1", "d2", "component_id"))
    dropped(classes, of, joints, found)
    out = seen.join(low, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
