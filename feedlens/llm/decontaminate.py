"""Benchmark decontamination: one Aho-Corasick automaton over normalised questions and answers.

Words of the benchmark are numbered and each number is one symbol of the automaton; a document becomes the string
of its words' symbols (one spare symbol for all other words) and is scanned once. A match at symbols i..j is words
i..j of the document, whose offsets in the original text are found again where there is a match.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import stored

WINDOW = 10
#: Windows of one automaton, which is what a task's memory holds of the benchmark beside its texts (some 200 MB). Where there
#: are more, the automaton is built block by block for each SPOOL bytes of documents, which are read once all the same.
MOST_WINDOWS = 200_000
SPOOL = 32 << 20
#: Bytes of benchmark text that are broadcast at once; a benchmark of more takes a pass over the documents for each so many.
MOST_BYTES = 128 << 20
#: Word numbers written as one character: those up to 0xFFFFF without NUL and the surrogates. Larger numbers are two characters
#: of the last plane, the first from its lower and the second from its upper half, so that no match begins within a word.
SINGLE = 0xD7FF + 0x100000 - 0xE000

_OTHER = 0x20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else _OTHER for c in range(256))
_CAPITALS = re.compile("[A-Z]+")
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def normal_words(text: str | None) -> list[bytes]:
    """The words of a text after A-Z are lower-cased; a byte of a character beyond ASCII is part of a word."""
    return (text or "").encode().translate(_FOLD).split()


def _symbol(number: int) -> str:
    if number >= SINGLE:
        high, low = divmod(number - SINGLE, 0x8000)
        return chr(0x100000 + high) + chr(0x108000 + low)
    return chr(number + 1 if number < 0xD7FF else number + 1 + 0x800)


class Automaton:
    """The windows of some items as patterns over word symbols. An item of a null id has windows but no owner."""

    def __init__(self, items: tuple[tuple[int | None, str], ...], window: int = WINDOW) -> None:
        self.symbols: dict[bytes, str] = {}
        self.tree = ahocorasick.Automaton()
        found: dict[str, tuple[int, set[int]]] = {}
        for item, text in items:
            coded = [self.symbols.setdefault(w, _symbol(len(self.symbols))) for w in normal_words(text)]
            for k in range(max(1, len(coded) - window + 1) if coded else 0):
                part = coded[k : k + window]
                owners = found.setdefault("".join(part), (len(part), set()))[1]
                if item is not None:
                    owners.add(item)
        for pattern, (size, owners) in found.items():
            self.tree.add_word(pattern, (size, tuple(owners)))
        if found:
            self.tree.make_automaton()
        self.empty = not found

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """First word, end and items of each occurrence."""
        if self.empty:
            return
        get = self.symbols.get
        coded = [get(w, "\0") for w in words]
        text = "".join(coded)
        word = range(len(words)) if len(text) == len(words) else [k for k, c in enumerate(coded) for _ in c]
        for last, (size, owners) in self.tree.iter(text):
            yield word[last] + 1 - size, word[last] + 1, owners


_built: dict[tuple[str, int], Automaton] = {}


def automaton(name: str, block: int, items: tuple[tuple[int | None, str], ...], window: int) -> Automaton:
    """Kept in a worker process for all its tasks; one at a time."""
    if (name, block) not in _built:
        _built.clear()
        _built[name, block] = Automaton(items, window)
    return _built[name, block]


FOUND = "n_words bigint, words array<bigint>, items array<bigint>, offsets array<bigint>"


def _scan(name: str, blocks: Broadcast, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, text, words, items): adds what these blocks of items hit to what earlier passes did."""

    def scanned(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.as_py() or "" for t in batch.column(1).cast(pa.large_string())]
        words = [normal_words(t) for t in texts]
        hits, owners = [set(x.as_py()) for x in batch.column(2)], [set(x.as_py()) for x in batch.column(3)]
        for k, items in enumerate(blocks.value):
            tree = automaton(name, k, items, window)
            for row, said in enumerate(words):
                for a, b, found in tree.matches(said):
                    hits[row].update(range(a, b))
                    owners[row].update(found)
        offsets = []
        for text, hit in zip(texts, hits, strict=True):
            places = [(m.start(), m.end()) for m in _WORD.finditer(_CAPITALS.sub(lambda m: m[0].lower(), text))] if hit else []
            offsets.append([x for k in sorted(hit) for x in places[k]])
        lists = [pa.array(x, pa.list_(pa.int64())) for x in ([sorted(h) for h in hits], [sorted(o) for o in owners], offsets)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), *lists], names=["row", "n_words", "words", "items", "offsets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(blocks.value) == 1:
            yield from map(scanned, batches)
            return
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= SPOOL:
                yield from map(scanned, pa.Table.from_batches(held).combine_chunks().to_batches())
                held = []
        if held:
            yield from map(scanned, pa.Table.from_batches(held).combine_chunks().to_batches())

    return run


def _usable(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()


def _parts(benchmark: DataFrame, window: int) -> tuple[int, int]:
    """How many passes over the documents, one at least, and in each how many blocks of about half of MOST_WINDOWS."""
    words = F.regexp_count("text", F.lit(_WORD.pattern))
    size = _usable(benchmark).agg(F.sum(F.greatest(words - (window - 1), F.lit(1))).alias("windows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    passes = -(-2 * size.bytes // MOST_BYTES) if (size.bytes or 0) > MOST_BYTES else 1
    return passes, -(-2 * size.windows // (passes * MOST_WINDOWS)) if (size.windows or 0) > passes * MOST_WINDOWS else 1


def _blocks(benchmark: DataFrame, k: int, passes: int, blocks: int) -> list[tuple[tuple[int | None, str], ...]]:
    """The items of a pass, dealt into its blocks."""
    found: list[list] = [[] for _ in range(blocks)]
    rows = _usable(benchmark).withColumn("h", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes * blocks)))
    for r in rows.where(F.col("h") % passes == k).toLocalIterator():
        found[r.h // passes].append((r.item_id, r.text))
    return [tuple(x) for x in found]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) plus n_words, words (numbers of the hit words), items (ids of
    items with an occurring window) and offsets (start and end of each hit word in the original text, code points).

    Null and empty texts have no words. Items of null text are no items; an item of a null id hits words but isn't
    listed; repeated items count once; an empty benchmark hits nothing. Repeated rows each get a row, a null doc_id
    included; a very long text is one string of symbols; an empty table gives no rows; columns of docs named as the added
    ones give way to them. Documents are read once: of a benchmark of more than MOST_WINDOWS windows the automaton is built
    block by block for some megabytes of documents at a time, so that memory doesn't grow with it. Only one of more than
    MOST_BYTES of text takes further passes, over stored rows.
    """
    kept = [c for c in (keep or docs.columns) if c not in ("n_words", "words", "items", "offsets")]
    passes, blocks = _parts(benchmark, window)
    carried = kept if passes == 1 or "text" in kept else [*kept, "text"]
    none = F.array().cast("array<bigint>")
    row = F.struct(*[F.col(f"`{c}`") for c in carried])
    out = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"), none.alias("words"), none.alias("items"))
    shape = f"row {out.schema['row'].dataType.simpleString()}, {FOUND}"
    for k in range(passes):
        if k:
            out = stored(out).select("row", F.col("row.text").cast("string").alias("text"), "words", "items")
        out = out.mapInArrow(_scan(uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(_blocks(benchmark, k, passes, blocks)), window), shape)
    return out.select(*[F.col(f"row.`{c}`") for c in kept], "n_words", "words", "items", "offsets")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of contamination()."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("words").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (F.size("words") > 0).alias("contaminated"),
    )
