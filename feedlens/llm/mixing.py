"""Mixing sources to target weights: soft domain posteriors, then nonnegative document rates.

The domains are those of the labelled table: toxic, plain (quality 0) and good (quality 1). A softmax regression
over the presence of hashed words, fit on a bounded sample of labelled rows, gives each document's posterior. With n_d the
words and p_d the posteriors of document d, the rates x_d >= 0 give expected totals t = sum over d of x_d n_d p_d; they
minimise the squares of t minus the targets, in the metric of G^-1 where G = sum over d of n_d p_d p_d'.

Projected gradient from rates of 1: x_d <- max(0, y_d - p_d . G^-1 (t(y) - T)), y being x with Nesterov's momentum. In this
metric the gradient's largest eigenvalue is 1, so full steps converge, and where no rate is at 0 one step reaches the
targets. A step needs one Spark aggregate of twice as many numbers as there are domains; a document's rate follows from its
own posterior and the steps' numbers, so no step moves document rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm import rolling
from feedlens.llm.common import stored

DOMAINS = ("toxic", "plain", "good")


@dataclass(frozen=True)
class Mix:
    """Target weights by domain, as shares of all words now; None: the domain's present share. steps: projected-gradient
    steps at most; they end where no total is further from its target than settled, as a share of all words, or the totals
    stand still. The classifier is bounded by buckets of hashed words, features chosen for each domain, and labelled, the
    most labelled rows it is fit on: where there are more, a hash of doc_id picks about so many."""

    weights: tuple[float | None, ...] = (0.01, 0.14, 0.85)
    buckets: int = 1 << 18
    features: int = 96
    labelled: int = 20_000
    epochs: int = 400
    penalty: float = 1e-4
    steps: int = 60
    settled: float = 1e-5


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.where(_LETTERS[rolling._LOWER], rolling._LOWER, 32).astype(np.uint8)


#: Besides whole words, their beginnings of so many bytes are features: a subword tells more than rare whole words do.
BEGINNINGS = (4, 5, 6, 7)


def _features_of(s: rolling.Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each word of lower-cased letters, digits and characters beyond ASCII, and of its beginnings."""
    data = _FOLD[s.data]
    w = rolling.words(rolling.Slice(s.first, data, s.offset))
    docs, hashes = [w.doc], [w.hash]
    values = rolling._BYTES[data]
    for size in BEGINNINGS:
        long = np.flatnonzero(w.end - w.start > size)
        docs.append(w.doc[long])
        hashes.append(rolling.mixed(rolling.hash_of_ranges(values, w.start[long], w.start[long] + size, rolling._WORD_BASE) + np.uint64(size)))
    return np.concatenate(docs), (np.concatenate(hashes) & np.uint64(n - 1)).astype(np.int64)


def _present(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(text, domain) to (domain, bucket, documents), summed within each slice; bucket -1 counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            domain = np.asarray(batch.column(1))
            for s in rolling.slices(batch.column(0)):
                doc, bucket = _features_of(s, n)
                one = np.unique(doc * n + bucket)
                key, count = np.unique(domain[s.first + one // n] * n + one % n, return_counts=True)
                kinds, docs = np.unique(domain[s.first : s.first + s.rows], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((key // n, kinds)).astype(np.int32)), pa.array(np.concatenate((key % n, np.full(len(kinds), -1)))), pa.array(np.concatenate((count, docs)))],
                    names=["domain", "bucket", "n"],
                )

    return run


@dataclass(frozen=True)
class Classifier:
    """The chosen buckets, their weights for each domain and the domains' offsets."""

    buckets: int
    chosen: np.ndarray
    weight: np.ndarray
    offset: np.ndarray

    def held(self, s: rolling.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Document and feature of each chosen bucket that a document holds, each pair once."""
        place = np.full(self.buckets, -1)
        place[self.chosen] = np.arange(len(self.chosen))
        doc, bucket = _features_of(s, self.buckets)
        at = place[bucket]
        one = np.unique(doc[at >= 0] * len(self.chosen) + at[at >= 0])
        return (one // len(self.chosen), one % len(self.chosen)) if len(self.chosen) else (one, one)

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words and domain posteriors of each text."""
        counts, out = [np.zeros(0, np.int64)], [np.zeros((0, len(self.offset)))]
        for s in rolling.slices(texts):
            score = np.tile(self.offset, (s.rows, 1))
            doc, feature = self.held(s)
            np.add.at(score, doc, self.weight[feature])
            out.append(_softmax(score))
            counts.append(rolling.words(s).count)
        return np.concatenate(counts), np.concatenate(out)


def _softmax(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _telling(count: np.ndarray, total: np.ndarray, features: int) -> np.ndarray:
    """The buckets of most mutual information with each domain against the others, at most `features` for each."""
    found = []
    for k in range(len(total)):
        n = total.sum()
        for_it, others = (count[:, k] + 0.5) / (total[k] + 1), (count.sum(axis=1) - count[:, k] + 0.5) / (n - total[k] + 1)
        q = total[k] / max(n, 1)
        both = q * for_it + (1 - q) * others
        gain = sum(w * (x * np.log(x / both) + (1 - x) * np.log((1 - x) / (1 - both))) for w, x in ((q, for_it), (1 - q, others)))
        best = np.argsort(-gain, kind="stable")[:features]
        found.append(best[gain[best] > 6 / max(n, 1)])  # about the 0.1 % level of a chance association
    return np.unique(np.concatenate(found))


def fitted(docs: DataFrame, labels: DataFrame, mix: Mix = Mix()) -> Classifier:
    """Chooses features by counts of labelled documents and fits the regression on the sample's feature rows.

    Labels that are null, or of no document, don't count; a doc_id with several labels has the strictest; without
    any labels all domains are alike.
    """
    toxic, quality = F.col("toxic").cast("int"), F.col("quality").cast("int")
    marked = labels.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2).alias("domain"))
    marked = marked.where("domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n = marked.count()
    if n > mix.labelled:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * (mix.labelled / n)))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = stored(texts.join(F.broadcast(marked), "doc_id").select("text", "domain"))  # a bounded number of small rows
    k = len(DOMAINS)
    count, total = np.zeros((mix.buckets, k)), np.zeros(k)
    table = known.mapInArrow(_present(mix.buckets), "domain int, bucket bigint, n bigint").groupBy("domain", "bucket").agg(F.sum("n").alias("n"))
    table = table.where("bucket < 0 or n > 2").toPandas()  # at most domains x (buckets + 1) rows of numbers
    for domain in range(k):
        own = table[table.domain == domain]
        total[domain] = own[own.bucket < 0].n.sum()
        count[own[own.bucket >= 0].bucket.to_numpy(int), domain] = own[own.bucket >= 0].n
    model = Classifier(mix.buckets, _telling(count, total, mix.features), np.zeros((0, k)), np.zeros(k))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in rolling.slices(batch.column(0)):
                doc, feature = model.held(s)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(s.first, s.rows), rolling.list_array(np.bincount(doc, minlength=s.rows), feature)], names=["domain", "held"])

    rows = known.mapInArrow(features, "domain int, held array<bigint>").groupBy("domain", "held").count().orderBy("domain", "held").collect()  # bounded by labelled
    x, y, share = np.zeros((len(rows), len(model.chosen)), np.float32), np.zeros((len(rows), k), np.float32), np.zeros(len(rows), np.float32)
    for at, (domain, held, times) in enumerate(rows):
        x[at, held], y[at, domain], share[at] = 1, 1, times
    weight, offset = np.zeros((x.shape[1], k), np.float32), np.log((total + 1) / (total + 1).sum()).astype(np.float32)
    share /= max(share.sum(), 1)
    first, second, rate = [np.zeros_like(v) for v in (weight, offset)], [np.zeros_like(v) for v in (weight, offset)], 0.1
    for t in range(1, mix.epochs + 1 if len(rows) else 0):
        off = (_softmax(x @ weight + offset) - y) * share[:, None]
        for at, (value, slope) in enumerate(((weight, x.T @ off + mix.penalty * weight), (offset, off.sum(axis=0)))):
            first[at] = 0.9 * first[at] + 0.1 * slope
            second[at] = 0.999 * second[at] + 0.001 * slope**2
            value -= rate * (first[at] / (1 - 0.9**t)) / (np.sqrt(second[at] / (1 - 0.999**t)) + 1e-8)
    return Classifier(mix.buckets, model.chosen, weight.astype(float), offset.astype(float))


def posteriors(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """The columns `keep`, n_words and p array<double> (posteriors by DOMAINS) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, p = model.posteriors(batch.column(1))
            offset = pa.array(np.arange(len(n) + 1, dtype=np.int32) * p.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(offset, pa.array(p.reshape(-1)))], names=["row", "n_words", "p"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_words bigint, p array<double>")
    return out.select(*[F.col(f"row.`{c}`") for c in keep], "n_words", "p")


def _rate(steps: list[list[float]]) -> str:
    """SQL for a row's struct<x, y> after the given steps (g, momentum): x <- max(0, y - p . g), y <- x + momentum (x - x before)."""
    if not steps:
        return "named_struct('x', 1D, 'y', 1D)"
    table = ", ".join("array(" + ", ".join(f"{g!r}D" for g in row) + ")" for row in steps)
    x, last = "greatest(0D, s.y - (" + " + ".join(f"p[{k}] * g[{k}]" for k in range(len(DOMAINS))) + "))", f"g[{len(DOMAINS)}]"
    return f"aggregate(array({table}), named_struct('x', 1D, 'y', 1D), (s, g) -> named_struct('x', {x}, 'y', (1D + {last}) * {x} - {last} * s.x))"


def rates(scored: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, list[float], list[float]]:
    """scored (a stored table of posteriors) with a rate for each row; targets and expected totals of the domains.

    A document without words has the rate of its posterior but no weight; an empty table gives rates of none. Targets that
    no rates meet are met as nearly as the squares allow; compare them with the totals.
    """
    n = range(len(DOMAINS))
    pairs = [(j, k) for j in n for k in n if j <= k]

    def sums(steps: list[list[float]], *terms: str) -> list[float]:
        # Behind a generator, so that a row's state is evaluated once for all sums.
        rows = scored.select("n_words", "p", F.explode(F.array(F.expr(_rate(steps)))).alias("s"))
        return [float(v or 0.0) for v in rows.agg(*[F.expr(f"sum(n_words * {t})") for t in terms]).first()]

    found = sums([], *[f"p[{j}] * p[{k}]" for j, k in pairs], *[f"p[{k}]" for k in n])
    gram, now = np.zeros((len(DOMAINS), len(DOMAINS))), np.array(found[len(pairs) :])
    for (j, k), v in zip(pairs, found, strict=False):
        gram[j, k] = gram[k, j] = v
    whole = now.sum() or 1.0
    target = np.array([m if w is None else w * whole for m, w in zip(now, mix.weights, strict=True)])
    inverse = np.linalg.pinv(gram / whole, rcond=1e-9, hermitian=True) / whole
    steps: list[list[float]] = []
    ahead, t, moved = now, 1.0, np.inf
    while len(steps) < mix.steps and np.abs(now - target).max() > mix.settled * whole and moved > mix.settled / 100 * whole:
        following = (1 + (1 + 4 * t * t) ** 0.5) / 2
        steps.append([*(inverse @ (ahead - target)).tolist(), (t - 1) / following])
        both = np.array(sums(steps, *[f"p[{k}] * s.{c}" for c in "xy" for k in n]))
        after, ahead, t = both[: len(n)], both[len(n) :], following
        if (after - target) @ inverse @ (after - target) > (now - target) @ inverse @ (now - target):
            t = 1.0  # the momentum went too far
        moved, now = np.abs(after - now).max(), after
    return scored.withColumn("rate", F.expr(f"({_rate(steps)}).x")), target.tolist(), now.tolist()


def mixed(docs: DataFrame, labels: DataFrame, mix: Mix = Mix(), keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id by default), n_words, p (posteriors by DOMAINS), rate and residual (the largest
    difference of a domain's expected total from its target, over all words; the same in every row) of every row of docs.

    Null and empty texts have no words and the posterior of no feature. Repeated rows, a null doc_id included, each get a
    row with the same rate; a very long text is one row; without usable labels all domains are alike; an empty table gives
    no rows; columns of docs named as the added ones give way to them.
    """
    kept = [c for c in (keep or ["doc_id"]) if c not in ("n_words", "p", "rate", "residual")]
    rated, target, now = rates(stored(posteriors(docs, fitted(docs, labels, mix), kept)), mix)
    off = max(abs(a - b) for a, b in zip(now, target, strict=True)) / (sum(target) or 1.0)
    return rated.withColumn("residual", F.lit(off))
