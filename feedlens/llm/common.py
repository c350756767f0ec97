"""What the operators share: text columns, shared-folder tables, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rules: space and \x09-\x0D.
WHITE = " \t\n\x0b\f\r"
WHITE_RUN = "[\\x20\\x09-\\x0D]+"


def whole(text: Column) -> Column:
    """A text with null read as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text that isn't null."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_RUN))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone, as the contracts ask; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local master gets a temporary folder of its own; on a cluster that is an error, because
    executors wouldn't see each other's files in one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="feedlens-"))
            context = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = context.get()
    return found


#: Spark's setting that removes a finished query's shuffle files at once instead of at some later garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the shared folder and read back: cuts the lineage, survives lost executors.

    The table replaces the shuffles behind it, so their files go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/feedlens-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    if (made := _made.get()) is not None:
        made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_made: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes, at its end, what stored() has written within it, but for the tables put into the list that it gives.

    For a caller that stores its result: an operator's own tables can't go while a result that reads them isn't written.
    """
    token = _made.set([])
    kept: list[DataFrame] = []
    try:
        yield kept
    finally:
        made = _made.get() or []
        _made.reset(token)
        read = [df.inputFiles() for df in kept]
        folders = {f.rpartition("/")[0].rpartition("/")[2] for files in read for f in files}
        for spark, path in made if all(read) else ():  # a table without files can't be told from the others
            if path.rpartition("/")[2] not in folders:
                _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by stored() that no later result reads."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if path.rpartition("/")[2].startswith("feedlens-"):
                _delete(spark, path)


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Distributed union-find: edges (a, b) in, one row (id, component) for each id on an edge out.

    Alternates the large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014) until the edge set stands still; each round is aggregations and joins on node ids and is
    stored in the shared folder. component is the smallest id reachable. An edge with a null end is ignored;
    repeated edges and loops change nothing; no edges give no rows.
    """
    now = stored(
        edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    before = state(now)
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
        dropped(now)
        now = after
        if (found := state(now)) == before:
            break
        before = found
    else:
        raise RuntimeError(f"the components have not settled after {most_rounds} rounds")
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out = stored(ends)
    dropped(now)
    return out
