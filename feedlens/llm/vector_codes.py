"""Vector codes: product quantisation of integer vectors, with exact distances from float64 matrix products of split limbs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import dropped, stored


@dataclass(frozen=True)
class Codes:
    """scale: a component x becomes floor(scale * x). limb: bits of a limb; a product of two limbs, summed over a part, is exact
    in float64 as long as 2 * limb + log2(width) is below 53."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    limb: int = 15


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as float64 digits to the base 2**bits, least first, each from -2**(bits - 1) up to 2**(bits - 1) - 1."""
    found, half = [], 1 << (bits - 1)
    while not found or x.any():
        low = ((x + half) & ((1 << bits) - 1)) - half
        found.append(low.astype(np.float64))
        x = (x - low) >> bits
    return found


def products(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """x @ y.T of int64 matrices (or stacks of them), exactly: limb by limb in BLAS, put together in int64."""
    if 2 * (bits - 1) + max(x.shape[-1], 1).bit_length() > 53:
        raise ValueError("a sum of products of limbs doesn't fit into float64")
    total = np.zeros((*x.shape[:-1], y.shape[-2]), np.int64)
    right = [np.swapaxes(b, -1, -2) for b in limbs(y, bits)]
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            total += (a @ b).astype(np.int64) << np.int64(bits * (i + j))
    return total


def nearest(x: np.ndarray, books: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For parts x (part, row, width) and their codebooks (part, entry, width): the first nearest entry and its squared distance."""
    away = (x * x).sum(-1)[:, :, None] - 2 * products(x, books, bits) + (books * books).sum(-1)[:, None, :]
    best = away.argmin(-1)
    return best, np.take_along_axis(away, best[:, :, None], -1)[:, :, 0]


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """A batch's vectors as (part, row, width)."""
    rows = len(column)
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(rows, parts, -1).swapaxes(0, 1))


def integers(vectors: DataFrame, rule: Codes) -> DataFrame:
    """vec_id, label and the integer components of the rows whose vector has no null and finite components alone."""
    good = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = good.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            with np.errstate(over="ignore"):
                x = np.floor(column.flatten().to_numpy(zero_copy_only=False) * rule.scale)
            most = (2.0**61 / max(1, len(x) // max(1, batch.num_rows))) ** 0.5
            if len(x) and np.abs(x).max() >= most:
                raise ValueError(f"a component is beyond {most:.0f} / {rule.scale}: squared distances don't fit into 64 bits")
            offset = np.zeros(batch.num_rows + 1, np.int32)
            np.cumsum(column.value_lengths().to_numpy(), out=offset[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offset, pa.array(x.astype(np.int64)))], names=["vec_id", "label", "x"])

    return good.mapInArrow(floors, "vec_id bigint, label bigint, x array<bigint>")


@dataclass(frozen=True)
class Books:
    """The codebooks (part, entry, width) of some vectors, as integers."""

    rule: Codes
    entries: np.ndarray

    @property
    def sha256(self) -> str:
        """The digest of all components in order, as decimal numbers with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def sums(self, table: DataFrame) -> DataFrame:
        """slot (part, entry and position in one number), total and n: sums over all rows, added up in each task first."""
        books, rule = self.entries, self.rule
        parts, entries, width = books.shape

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)

            def out() -> pa.RecordBatch:
                slot = np.arange(parts * entries * width)
                return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total.reshape(-1)), pa.array(np.repeat(n, width))], names=["slot", "total", "n"])

            room = 1 << 62
            for batch in batches:
                x = _matrix(batch.column(0), parts)
                most = int(np.abs(x).max(initial=0)) * x.shape[1]
                if most > room:
                    yield out()
                    total[:], n[:], room = 0, 0, 1 << 62
                room -= most
                best, _ = nearest(x, books, rule.limb)
                at = (best + np.arange(parts)[:, None] * entries).reshape(-1)
                np.add.at(total, at, x.reshape(-1, width))
                n += np.bincount(at, minlength=len(n))
            yield out()

        each = table.select("x").mapInArrow(added, "slot bigint, total bigint, n bigint")
        return each.groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))

    def moved(self, table: DataFrame) -> Books:
        """Every used entry at the floor of its parts' mean. The driver gets one number a component of the codebooks."""
        new = self.entries.reshape(-1).copy()
        for r in self.sums(table).where("n > 0").collect():
            new[r.slot] = int(r.total) // r.n
        return Books(self.rule, new.reshape(self.entries.shape))

    def coded(self, table: DataFrame) -> DataFrame:
        """vec_id, label, code (two hex digits a part) and error, the squared distances summed over the parts."""
        books, rule = self.entries, self.rule

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best, away = nearest(_matrix(batch.column(2), books.shape[0]), books, rule.limb)
                code = [bytes(row).hex() for row in best.T.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(away.sum(0))], names=["vec_id", "label", "code", "error"])

        return table.select("vec_id", "label", "x").mapInArrow(codes, "vec_id bigint, label bigint, code string, error bigint")


def trained(table: DataFrame, rule: Codes) -> Books | None:
    """Codebooks that begin with the parts of the first vectors by vec_id and move rule.rounds times; None without rows."""
    shape = table.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if shape.most is None:
        return None
    if shape.least != shape.most or shape.most % rule.parts:
        raise ValueError(f"vectors of {shape.least} to {shape.most} components can't be cut into {rule.parts} equal parts alike")
    first = table.orderBy(F.asc_nulls_last("vec_id"), "x").limit(rule.entries).select("x").collect()
    books = Books(rule, np.array([r.x for r in first], np.int64).reshape(len(first), rule.parts, -1).swapaxes(0, 1).copy())
    for _ in range(rule.rounds):
        books = books.moved(table)
    return books


def vector_codes(vectors: DataFrame, rule: Codes = Codes()) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the rows of vectors (vec_id, embedding, label).

    Rows whose vector is null or holds a null or non-finite component are left out. Codebooks start at the rows of the
    smallest vec_ids, of rows of one vec_id those of the smaller vector first, rows of a null vec_id last; with fewer rows
    than entries there are fewer entries. Ties go to the lower entry. Repeated rows each count. label_error sums the errors
    of equal labels, nulls together; a label is one partial sum a task, however many rows have it. Components beyond what 64
    bits allow, and vectors of different lengths or not of equal parts, are errors. No kept row gives no rows; other columns
    are left out.
    """
    spark = vectors.sparkSession
    table = stored(integers(vectors, rule))
    books = trained(table, rule)
    if books is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = stored(books.coded(table))
    dropped(table)
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    met = coded.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
