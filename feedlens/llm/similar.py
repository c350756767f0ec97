"""Similarity links over MinHash bands without emitting the pairs of a bucket.

Round one compares each member of a bucket with the bucket's smallest id (a star), in larger buckets with three more
centers, so a group of n near copies costs about n comparisons. Verified links give components. Round two takes the buckets
whose members still lie in several components and meets only their outsiders, those beyond the component of the
smallest id, with the members of other components. A pair goes on if its sizes and parities leave room for the similarity,
a bound that is exact: no link is lost, and members already connected cost nothing. Outsiders are dealt over blocks, so that no
bucket is one task's work.

All comparisons are exact, on full sets. A compared pair (a, b) travels in a block: the text of a goes once to each
block of some hundred partners, never once to each pair, and a much-compared text is dealt over many blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm import rolling
from feedlens.llm.common import components, dropped, stored

#: From a slice of texts to the distinct shingle hashes of each, sorted, one after the other, and where each set begins
#: (one number more than there are sets).
Sets = Callable[[rolling.Slice], tuple[np.ndarray, np.ndarray]]
#: Partners of a text in one block of comparisons.
BLOCK = 256
#: Members of a bucket from which on it has more centers; its square is a block of round two.
LARGE = 32
#: Words of 64 parities that are compared first.
FIRST = 12


def _compared(sets: Sets, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, block, b, text) in order, a's own text (b is null) first in each block, to the pairs that have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.uint64)
        for batch in batches:
            own = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            keep = np.zeros(batch.num_rows, bool)
            for s in rolling.slices(batch.column(3)):
                values, first = sets(s)
                for k, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if own[s.first + k]:
                        mine = values[x:y].copy()
                        continue
                    n = len(mine) + y - x
                    if not n or 100 * min(len(mine), y - x) < percent * max(len(mine), y - x):
                        continue
                    both = np.concatenate((mine, values[x:y]))
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep[s.first + k] = 100 * common >= percent * (n - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(2).filter(mask)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b, degree: about how many partners a has) whose full sets have the similarity."""
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / BLOCK)).alias("block"))
    own = pairs.select("a", "block").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "block", F.lit(None).cast("bigint").alias("b"), "text")
    partners = pairs.join(texts.withColumnRenamed("id", "b"), "b").select("a", "block", "b", "text")
    both = own.unionByName(partners).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return both.mapInArrow(_compared(sets, percent), "a bigint, b bigint")


def _measured(sets: Sets, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) to (id, n, map): the size of each set and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in rolling.slices(batch.column(1)):
                values, first = sets(s)
                odd = rolling.parities(values, first[:-1], bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.rows), pa.array(np.diff(first)), rolling.list_array(np.full(s.rows, bits // 64), odd.reshape(-1))], names=["id", "n", "map"])

    return run


def _bounded(percent: int, bits: int) -> str:
    """The sizes and parities of x and y leave room for the similarity: exact, no pair that has it is lost.

    With d shingles in one set alone the similarity is (n - d) / (n + d), n the sum of the sizes. Differences in the first
    words of the parities alone bound d too: most pairs fall there, in a term without a lambda.
    """
    first = " + ".join(f"bit_count(x.map[{k}] ^ y.map[{k}])" for k in range(min(FIRST, bits // 64)))
    every = "aggregate(zip_with(x.map, y.map, (p, q) -> bit_count(p ^ q)), 0, (n, c) -> n + c)"
    room = [f"{100 + percent} * ({apart}) <= {100 - percent} * (x.n + y.n)" for apart in (first, every)]
    return f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and {room[0]} and {room[1]}"


def linked(profiles: DataFrame, fetch: Callable[[DataFrame], DataFrame], sets: Sets, percent: int, bits: int) -> DataFrame:
    """(id, component) of all linked ids among profiles (id, bands array<bigint>), one row for each id; component is
    the smallest id reachable.

    fetch takes distinct ids and returns a stored table (id, text); bits is the number of parities of a set. profiles is read
    several times: store it.
    """
    keys = profiles.select(F.explode("bands").alias("key"), "id")
    shared = stored(keys.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("last"), F.count("*").alias("size")).where("size > 1"))
    # A bucket of two is its least and greatest id; only the members of larger ones are looked up.
    two = shared.where("size = 2")
    pairs = two.select("key", F.col("center").alias("id"), "center", "last", "size").unionByName(two.select("key", F.col("last").alias("id"), "center", "last", "size"))
    crowded = stored(pairs.unionByName(keys.join(shared.where("size > 2"), "key").select("key", "id", "center", "last", "size")))
    texts = fetch(crowded.select("id").distinct())
    star = crowded.where("id != center").select(F.col("center").alias("a"), F.col("id").alias("b"), "size")
    # In large buckets the ends by two other orders are centers too: what one center misses another finds, and what none
    # does is an outsider of round two.
    large = crowded.where(f"size > {LARGE}")
    ends = stored(large.groupBy("key").agg(F.array_distinct(F.array(F.max("id"), *[f("id", F.xxhash64("id")) for f in (F.min_by, F.max_by)])).alias("ends")))
    more = large.join(ends, "key").select("id", "center", "size", F.explode("ends").alias("a")).where("a not in (id, center)")
    star = star.unionByName(more.select("a", F.col("id").alias("b"), "size"))
    star = star.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), "a", "size").groupBy("low", "high").agg(F.max_by("a", "size").alias("a"), F.max("size").alias("size")).select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"), "size")
    near = stored(verified(star.groupBy("a", "b").agg(F.max("size").alias("degree")), texts, sets, percent))
    found = components(near)
    at = stored(crowded.join(found, "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("component")))
    spread = stored(at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key", "low"))
    opened = at.join(spread, "key")
    facts = stored(texts.join(opened.select("id").distinct(), "id").select("id", "text").mapInArrow(_measured(sets, bits), "id bigint, n bigint, map array<bigint>"))
    rest = stored(opened.join(facts, "id").withColumn("blocks", F.ceil(F.col("size") / LARGE**2)))
    dropped(shared, crowded, ends, near, at, spread, facts)
    x = rest.where("component != low").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).alias("x")
    y = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    met = x.join(y, F.expr(f"x.key = y.key and x.block = y.block and x.component != y.component and (y.component = y.low or x.id < y.id) and {_bounded(percent, bits)}"))
    again = stored(met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    degrees = stored(again.groupBy("a").agg(F.count("*").alias("degree")))
    more = verified(again.join(degrees, "a"), texts, sets, percent)
    links = stored(found.where("id != component").select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more))
    dropped(found, texts, rest, again, degrees)
    out = components(links)
    dropped(links)
    return out
