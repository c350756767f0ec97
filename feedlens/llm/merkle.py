"""Merkle dataset manifest: every row a leaf, a tree a group, proofs by a butterfly exchange between aligned blocks of leaves.

A block is an aligned run of fanout ** inner leaves of one group; its inner tree is hashed in one task. Then blocks climb
together: in round r the blocks whose numbers differ in the digit r alone (to the base fanout) swap the roots of the subtrees
they stand under, and each hashes their parent for itself. After the last round each block has its group's root and all
siblings on the way, without a pass back down. The roots of all groups are the leaves of a last tree, built the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.common import ascii_lower, dropped, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Tree:
    fanout: int = 16
    inner: int = 2

    @property
    def block(self) -> int:
        """Leaves of a block."""
        return self.fanout**self.inner


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values: list[Column]) -> Column:
    """The digest of the values in order: `-` for null, else their UTF-8 length, a colon and the value."""
    shown = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in shown]).cast("binary"), 256)


@dataclass(frozen=True)
class Step:
    """One level of a way up: the place of the node in its run, and the run's other digests in order."""

    place: int
    others: list[str]

    def parent(self, node: str) -> str:
        return digest([*self.others[: self.place], node, *self.others[self.place :]])

    def __str__(self) -> str:
        return f"{self.place:02x}{len(self.others):02x}{''.join(self.others)}"


def steps(path: str) -> list[Step]:
    """Reads back a path, which is its steps' texts in a row."""
    found, at = [], 0
    while at < len(path):
        place, n = int(path[at : at + 2], 16), int(path[at + 2 : at + 4], 16)
        found.append(Step(place, [path[k : k + 64] for k in range(at + 4, at + 4 + 64 * n, 64)]))
        at += 4 + 64 * n
    return found


def levels_of(leaves: list[str], whole: bool, tree: Tree) -> list[list[str]]:
    """The levels of a block from its leaves to its root. Where the block is its whole group, hashing ends at one node."""
    found = [leaves]
    while len(found[-1]) > 1 if whole else len(found) <= tree.inner:
        found.append([digest(found[-1][k : k + tree.fanout]) for k in range(0, len(found[-1]), tree.fanout)])
    return found


def way(levels: list[list[str]], place: int, tree: Tree) -> list[Step]:
    """The steps from a leaf to its block's root."""
    found = []
    for nodes in levels[:-1]:
        run = place // tree.fanout * tree.fanout
        found.append(Step(place - run, nodes[run:place] + nodes[place + 1 : run + tree.fanout]))
        place //= tree.fanout
    return found


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Stores rows with pos, their place in their group by `order`, and total, the group's number of rows.

    Rows are sorted by range, so that a large group takes many tasks; each task numbers its own rows, and those few
    counts, one a task and group, are added up. Rows that are equal in all of `order` take any order among themselves.
    """
    tie = "_tie"
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(group, *order, tie)
    sorted_rows = ranged.sortWithinPartitions(group, *order, tie).drop(tie).withColumn("part", F.spark_partition_id())
    at = sorted_rows.columns.index(group)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = object(), 0
        for batch in batches:
            own = []
            for x in batch.column(at).to_pylist():
                last, n = x, n + 1 if x == last else 0
                own.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, "own"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema)
    placed = stored(sorted_rows.mapInArrow(counted, f"{shape}, own bigint"))
    each = placed.groupBy(group, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select(
        F.col(group).alias("_group"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"), F.sum("n").over(Window.partitionBy(group)).alias("total")
    )
    met = placed.join(starts, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    out = stored(met.withColumn("pos", F.col("_start") + F.col("own")).drop("part", "own", "_part", "_group", "_start"))
    dropped(placed)
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """The rows of each run of equal keys, across batches."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _in_blocks(rows: DataFrame, group: str, *more: str) -> DataFrame:
    return rows.repartition(F.col(group), F.col("block")).sortWithinPartitions(group, "block", "pos", *more)


def climbed(leaves: DataFrame, group: str, tree: Tree) -> DataFrame:
    """One row a block of numbered leaves: group, block, blocks (of its group), node (the group's root) and path, the steps from
    the block's root to it."""

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, [group, "block"]):
            levels = levels_of([r["leaf"] for r in run], run[0]["total"] <= tree.block, tree)
            yield pa.RecordBatch.from_pylist([{group: run[0][group], "block": run[0]["block"], "blocks": -(-run[0]["total"] // tree.block), "node": levels[-1][0], "path": ""}], shape)

    kind = leaves.schema[group].dataType.simpleString()
    shape = pa.schema([(group, pa.string() if kind == "string" else pa.int32()), ("block", pa.int64()), ("blocks", pa.int64()), ("node", pa.string()), ("path", pa.string())])
    blocks = leaves.select(group, F.expr(f"pos div {tree.block}").alias("block"), "pos", "total", "leaf")
    now = stored(_in_blocks(blocks, group).mapInArrow(rooted, f"`{group}` {kind}, block bigint, blocks bigint, node string, path string"))
    most, width = now.agg(F.max("blocks")).first()[0] or 0, 1
    done: list[DataFrame] = []
    while width < most:
        done.append(now.where(F.col("blocks") <= width))
        higher = stored(_exchanged(now.where(F.col("blocks") > width), group, width, tree))
        now, width = higher, width * tree.fanout
    for part in done:
        now = now.unionByName(part)
    return now.select(group, "block", "blocks", "node", "path")


def _exchanged(blocks: DataFrame, group: str, width: int, tree: Tree) -> DataFrame:
    """One round: the blocks of a group of tree.fanout subtrees of `width` blocks that stand at the same place in theirs meet.

    The last subtree may hold fewer blocks; these also stand in, in turn, for the places that it lacks.
    """
    digit, low, high = f"(block div {width}) % {tree.fanout}", f"block % {width}", f"block div {width * tree.fanout}"
    there = f"least({width}, blocks - (block div {width}) * {width})"
    told = blocks.selectExpr(f"`{group}`", "blocks", f"{high} AS high", f"{low} AS low", "block", "path", "node", f"{digit} AS digit", f"explode(sequence({low}, {width - 1}, {there})) AS place")
    sent = F.struct("digit", "node", "block", "path", (F.col("place") == F.col("low")).alias("own"))
    met = told.groupBy(group, "blocks", "high", "place").agg(F.array_sort(F.collect_list(sent)).alias("met"))
    run = met.select(group, "blocks", "met", F.sha2(F.concat_ws("", "met.node").cast("binary"), 256).alias("parent"))
    each = run.select(group, "blocks", "parent", F.col("met.node").alias("nodes"), F.explode(F.filter("met", lambda x: x["own"])).alias("to"))
    others = F.concat(F.slice("nodes", F.lit(1), F.col("to.digit").cast("int")), F.slice("nodes", F.col("to.digit").cast("int") + 2, F.lit(tree.fanout)))
    step = F.concat(F.lower(F.lpad(F.hex("to.digit"), 2, "0")), F.lower(F.lpad(F.hex(F.size("nodes") - 1), 2, "0")), F.concat_ws("", others))
    return each.select(group, F.col("to.block").alias("block"), "blocks", F.col("parent").alias("node"), F.concat("to.path", step).alias("path"))


def manifest(docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs.

    Leaves of one source ascend by doc_id, a null one first, rows of one doc_id by their digest; a null source is a source of
    its own, before all others. The proof is the siblings on the way from the leaf to the root. Each row's own leaf, or that
    of its tampered text (A-Z in lower case) where 5 divides the crc32 of its doc_id, is folded with them anew; verified says
    whether that gives the root. A null doc_id isn't tampered with. Null and empty values have digests of their own; a very
    long text is one value; repeated rows are leaves of their own with equal digests; an empty table gives no rows; other
    columns of docs are left out.
    """
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = leaf_of([ascii_lower(F.col(c).cast("string")) if c == "text" else F.col(c) for c in FIELDS])
    hashed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_of([F.col(c) for c in FIELDS]).alias("leaf"), F.when(changed, other).alias("tampered"))
    first = stored(hashed)
    leaves = numbered(first, "source", ["doc_id", "leaf"])
    dropped(first)
    lower = stored(climbed(leaves, "source", tree))
    tops = numbered(lower.where("block = 0").select(F.lit(0).alias("all"), "source", F.col("node").alias("leaf")), "all", ["source"])
    above = climbed(tops, "all", tree)
    root = (above.select("node").first() or [None])[0]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sources of a block, after the block's own row, to the whole path from each source to the root."""
        for run in _runs(batches, ["all", "block"]):
            head, own = run[0], run[1:]
            levels = levels_of([r["leaf"] for r in own], head["blocks"] == 1, tree)
            out = [{"name": r["source"], "upper": "".join(map(str, way(levels, k, tree))) + head["path"]} for k, r in enumerate(own)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("name", pa.string()), ("upper", pa.string())]))

    heads = above.selectExpr("all", "block", "-1L AS pos", "blocks", "null AS source", "null AS leaf", "path")
    both = heads.unionByName(tops.selectExpr("all", f"pos div {tree.block} AS block", "pos", "null AS blocks", "source", "leaf", "null AS path"))
    ways = stored(_in_blocks(both, "all").mapInArrow(joined, "name string, upper string"))

    def proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves of a block, after the block's own row, to their proofs."""
        for run in _runs(batches, ["source", "block"]):
            head, own = run[0], run[1:]
            upper, out = steps(head["path"]), []
            tail = "".join(x for s in upper for x in s.others)
            levels = levels_of([r["leaf"] for r in own], head["blocks"] == 1, tree)
            for k, r in enumerate(own):
                near = way(levels, k, tree)
                node = r["tampered"] or r["leaf"]
                for s in (*near, *upper):
                    node = s.parent(node)
                proof = digest([*[x for s in near for x in s.others], tail])
                out.append({"doc_id": r["doc_id"], "leaf": r["leaf"], "subroot": head["leaf"], "root": root, "proof_sha256": proof, "folded_root": node, "verified": node == root})
            yield pa.RecordBatch.from_pylist(out, pa.schema([(c, {"doc_id": pa.int64(), "verified": pa.bool_()}.get(c, pa.string())) for c in out[0]]))

    known = lower.join(ways, F.col("source").eqNullSafe(F.col("name")))
    heads = known.selectExpr("source", "block", "-1L AS pos", "blocks", "null AS doc_id", "node AS leaf", "null AS tampered", "concat(path, upper) AS path")
    rows = heads.unionByName(leaves.selectExpr("source", f"pos div {tree.block} AS block", "pos", "null AS blocks", "doc_id", "leaf", "tampered", "null AS path"))
    return _in_blocks(rows, "source").mapInArrow(proven, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
