"""Secret scans: fixed shapes first, then dictionary-primed zstandard novelty for strings in a sensitive context."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
#: Fixed shapes; on bytes, so that letters are ASCII in either case.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{12,}")
DIGIT, LETTER, CASES = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]"), re.compile(rb"[a-z][A-Z]")
#: Words that make a context sensitive, and identifiers that code commonly holds.
SENSITIVE = re.compile(rb"pass(?:word|wd|phrase)|secret|token|api.?key|credential|private.?key|access.?key|bearer|authorization|signature|client.?id", re.IGNORECASE)
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey credential private_key access_key bearer authorization "
    "signature client_id client_secret username default example placeholder changeme your_token_here configuration "
    "environment variable parameter argument function return import export const static public private protected "
    "class interface string integer boolean object array number request response headers content application json "
    "settings database connection localhost development production staging service account region bucket endpoint "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 test_value sample_value documentation"
)


@dataclass(frozen=True)
class Novelty:
    """A candidate is novel if it adds at least percent / 100 of its length to the compressed context before it; strict for
    one without a digit or without a letter. reach: bytes between it and a sensitive word on either side. parts: how many of the
    words that identifiers of the corpus are made of prime the compressor, the most frequent first, each of at least part_docs
    documents."""

    parts: int = 2000
    part_docs: int = 20
    reach: int = 64
    percent: int = 70
    strict: int = 85
    level: int = 19


#: Names with an underscore or with a capital inside, and the words of four letters or more that they are made of.
NAME = "(?<![A-Za-z0-9_])(?:[A-Za-z][A-Za-z0-9]*+_[A-Za-z0-9_]*+|[A-Za-z]*?[a-z][A-Z][A-Za-z0-9]*+)"
PART = "[A-Z]?[a-z]{3,}+"


def identifier_parts(docs: DataFrame, rule: Novelty = Novelty()) -> list[str]:
    """The words that most documents' identifiers are made of, counted over all rows; copies of a random string add none, whose
    runs of one case are too short. At most rule.parts words reach the driver; ties go to the first by name."""
    names = F.regexp_extract_all("text", F.lit(NAME), F.lit(0))
    parts = F.array_distinct(F.flatten(F.transform(names, lambda n: F.transform(F.regexp_extract_all(n, F.lit(PART), F.lit(0)), lambda p: F.lower(p)))))
    rows = docs.select(F.col("text").cast("string").alias("text")).where(F.contains("text", F.lit("_")) | F.col("text").rlike("[a-z][A-Z]"))
    counts = rows.select(F.explode(parts).alias("part")).where(F.length("part") > 3).groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= rule.part_docs)
    return [r.part for r in counts.orderBy(F.desc("n"), "part").limit(rule.parts).collect()]


class Meter:
    """Marginal compressed bytes of a candidate against the surrounding text and the identifier dictionary."""

    def __init__(self, rule: Novelty, identifiers: str = IDENTIFIERS) -> None:
        self.rule = rule
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=rule.level)  # once, not for each candidate
        self.size = lambda x, c=zstandard.ZstdCompressor(level=rule.level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False): len(c.compress(x))

    def novel(self, data: bytes, start: int, end: int, percent: int) -> bool:
        around = data[max(0, start - self.rule.reach) : start] + b"\n" + data[end : end + self.rule.reach] + b"\n"
        return 100 * (self.size(around + data[start:end]) - self.size(around)) >= percent * (end - start)


def spans_of(data: bytes, meter: Meter) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, base spans first; novel spans don't overlap base spans."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(data) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(data) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(data)]
    words = [m.span() for m in SENSITIVE.finditer(data)]
    if not words:
        return found
    rule, more, chained = meter.rule, [], -1
    starts, ends = [a for a, _ in words], [b for _, b in words]
    taken = sorted(found)
    begun, reached = [a for a, _, _ in taken], []
    for _, b, _ in taken:
        reached.append(max(b, reached[-1]) if reached else b)
    for m in CANDIDATE.finditer(data):
        a, b = m.span()
        k = bisect_right(ends, a) - 1
        before = k >= 0 and a - ends[k] <= rule.reach
        k = bisect_left(starts, b)
        after = k < len(starts) and starts[k] - b <= rule.reach
        # What follows a novel string at once, as the lines of a key do, is of its context.
        if not (before or after or 0 <= a - chained <= 2):
            continue
        k = bisect_left(begun, b) - 1
        if k >= 0 and reached[k] > a:
            continue
        x = m[0]
        digit, letter = DIGIT.search(x), LETTER.search(x)
        if not (digit and letter) and not CASES.search(x):
            continue
        if meter.novel(data, a, b, rule.percent if digit and letter else rule.strict):
            more.append((a, b, 3))
            chained = b
    return found + more


def _scan(rule: Novelty, parts: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(rule, " ".join([*reversed(parts), *[p.capitalize() for p in reversed(parts)], IDENTIFIERS]))
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.large_binary()):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                points = sorted(spans_of(data, meter))
                out, at, chars = [], 0, 0
                for a, b, kind in points:
                    chars += len(data[at:a].decode()) if a >= at else -len(data[a:at].decode())
                    at = a
                    out.append({"start": chars, "end": chars + len(data[a:b].decode()), "kind": kind})
                rows.append(sorted(out, key=lambda s: (s["start"], s["kind"])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "found"])

    return run


def secret_spans(docs: DataFrame, rule: Novelty = Novelty()) -> DataFrame:
    """doc_id and found, array<struct<start, end, kind>> by start and kind (numbers of KINDS), in code points. The dictionary
    that primes the compressor is a fixed list and the words of the identifiers that docs hold, gathered first.

    Null and empty texts hold nothing. Base spans of different kinds may overlap and are all kept, ordered by start and
    kind; novel spans overlap none. Repeated rows, a null doc_id included, each get a row; a very long text is scanned in
    one pass; an empty table gives none; extra columns are left out. Only strings in a sensitive context (a sensitive word
    within reach on either side, or a novel string right before) are compressed, each with a bounded context; those without
    a digit only if lower case turns upper inside.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(rule, identifier_parts(rows, rule)), "doc_id bigint, found array<struct<start:bigint,end:bigint,kind:int>>")


def digests(found: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("found", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", shown), ",").alias("spans"), count(3).alias("n_novel"),
    )
