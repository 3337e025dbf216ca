"""Quality selection by importance resampling.

Two generative models over hashed n-grams: the target, from labelled good and
harmless texts, and the raw text, from all documents. A document's importance
weight is the ratio of its probabilities under them. Gumbel noise is added to its
logarithm, so that the k largest keys are a sample without replacement.

N-grams are words, word pairs, word endings of three bytes, word heads of four, and
runs of one word (of at least 3, 6, 12 and 24), each kind hashed to a table of its own. Both models
are urns: a text draws an n-gram, and each draw makes the same one likelier in this
text. So an n-gram tells by its first occurrences, and a long text doesn't weigh a
thousandfold what a short one does. With ``c`` occurrences of bucket b and the
urns' contents ``A p_b``, the log weight is the sum over buckets of

    lgamma(A t_b + c) - lgamma(A t_b) - lgamma(A r_b + c) + lgamma(A r_b)

The raw share r_b follows the number of texts that have b. The target share is
t_b = r_b exp(theta_b) / Z: theta_b is the logarithm of the target's texts that
have b over those expected, times the probability that b differs at all (two
hypotheses: a Poisson count around the expected one; or, with prior ``DIFFER``, one of
any rate, Gamma with ``SHAPE``), and 0 where it is less than a factor of e. So rare
n-grams and a share of a language that is a few percent off say nothing, however
long the text.

A document is rejected if its log weight is below the cut: the one that errs least on
the labelled texts, a good one lost counting as ``LOST`` bad or harmful ones kept. Their weights
come from models made without them: the labels are split in two by a hash of the
id, and each half is weighed by the other half's model. The cut is -1 at most.

k is a parameter: rows, or the share of rows; by default the number of rows that aren't rejected. The k-th
largest key is found by histograms of 1,024 bins, each within a bin of the last, so
no ranking is gathered anywhere. ``temperature`` divides the log weight's noise: at 1
rows are drawn by their weight, near 0 the k heaviest are taken.

The raw counts cover every document; the target is a sample of at most
``max_labels`` labelled rows, those with the least hash of their doc_id. The model
has five tables of 2 ** ``bits`` buckets whatever the input; only this is sent to the workers.

Defined cases: null or blank texts have weight 1 (log 0); rows with equal ids share
their noise, so equal rows share their fate, and ties at the k-th key are all
taken; without good labels every weight is 1 and no document is rejected; labels of unknown
documents are ignored; other columns are left as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import lgamma
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import as_bytes, cut_lineage, map_batches, shared_folder

BITS, MAX_LABELS, SEED = 18, 50_000, 11
#: Words, pairs, endings, heads, runs.
KINDS = 5
RUNS = (3, 6, 12, 24)
#: The urns' contents; prior probability that an n-gram differs, and the shape of its rate then; least factor (its logarithm).
URN, DIFFER, SHAPE, LEAST = 30.0, 0.005, 0.5, 1.0
#: A good text lost counts as so many bad or harmful ones kept.
LOST = 5
#: Words whose n-grams are hashed at once.
CHUNK = 1 << 16
#: Keys are compared in steps of 2 ** -20.
STEP = 1 << 20
REPEAT, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: In how many texts a bucket occurs: of all documents, and of the target's two halves.
COUNTS = ("raw", "half0", "half1")


def buckets(body: bytes | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bucket numbers of a text's n-grams, and how often each occurs."""
    words = (body or b"").lower().split()
    parts, runs, run, last = [], np.zeros(len(RUNS), np.int64), 0, None

    def ended(sizes: np.ndarray) -> None:
        for k, least in enumerate(RUNS):
            runs[k] += int((sizes >= least).sum())

    for at in range(0, len(words), CHUNK):
        part = words[max(0, at - 1) : at + CHUNK]
        first = 1 if at else 0  # the word before the part only makes a pair
        own = np.fromiter(map(crc32, part), np.uint64, len(part))
        ends = np.fromiter(map(crc32, [w[-3:] for w in part], repeat(1)), np.uint64, len(part))
        heads = np.fromiter(map(crc32, [w[:4] for w in part], repeat(2)), np.uint64, len(part))
        same = own[1:] == own[:-1]
        pairs = np.where(same, REPEAT, own[1:] * np.uint64(31) + (own[:-1] << np.uint64(20)) + np.uint64(7))
        for kind, x in enumerate((own[first:], pairs, ends[first:], heads[first:])):
            parts.append((x * SPREAD >> np.uint64(64 - bits)).astype(np.int64) + (kind << bits))
        # runs of one word, the open one carried over to the next part
        edge = np.flatnonzero(np.concatenate(([True], ~same[first:], [True])))
        sizes = np.diff(edge)
        if run and last == own[first]:
            sizes[0] += run
        elif run:
            ended(np.array([run]))
        ended(sizes[:-1])
        run, last = int(sizes[-1]), own[-1]
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ended(np.array([run]))
    parts.append(np.repeat((KINDS - 1 << bits) + np.arange(len(RUNS)), runs))
    return np.unique(np.concatenate(parts), return_counts=True)


def labelled(labels: DataFrame, max_labels: int = MAX_LABELS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted doc_ids of the labelled rows in the sample, and whether each is good and harmless (by all its rows). At most max_labels rows reach the driver."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    found = rows.groupBy("doc_id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).toArrow().sort_by("doc_id")
    return found.column("doc_id").to_numpy(), found.column("good").to_numpy()


def folds(ids: pa.Array, known: np.ndarray, good: np.ndarray) -> np.ndarray:
    """By row: the half of a labelled document, 0 or 1, and 2 more for a bad or harmful one; -1 for the others."""
    if not known.size:
        return np.full(len(ids), -1)
    given = np.array([i is not None for i in ids.to_pylist()], bool)
    values = np.array([i or 0 for i in ids.to_pylist()], np.int64)
    at = np.minimum(np.searchsorted(known, values), known.size - 1)
    half = (values.astype(np.uint64) * SPREAD >> np.uint64(63)).astype(np.int64)
    return np.where(given & (known[at] == values), half + 2 * ~good[at], -1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after seven steps up; exact to about 1e-10."""
    y = x + 7
    low = x.copy()
    for k in range(1, 7):
        low *= x + k
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - np.log(low)


def tilts(raw: np.ndarray, target: np.ndarray, n_raw: int, n_target: int) -> np.ndarray:
    """theta by bucket, from the numbers of texts that have it."""
    out = np.zeros(raw.size)
    at = np.flatnonzero(raw)
    if not at.size or not n_target:
        return out
    expected, found = raw[at] * (n_target / n_raw), target[at]
    other = log_gamma(found + SHAPE) - lgamma(SHAPE) + SHAPE * np.log(SHAPE / (SHAPE + expected)) + found * np.log(expected / (SHAPE + expected))
    same = found * np.log(expected) - expected
    differs = 1 / (1 + np.exp(np.clip(same - other, -500, 500)) / DIFFER)
    factor = np.log((found + SHAPE) / (expected + SHAPE))
    out[at] = np.where(np.abs(factor) > LEAST, differs * factor, 0.0)
    return out


class Models:
    """The raw urn and the target's: of all good texts, and of each half of them."""

    def __init__(self, sums: np.ndarray, n_texts: np.ndarray, bits: int):
        self.bits = bits
        share = sums[0] / max(sums[0].sum(), 1.0)
        self.raw = (URN * share).astype(np.float32)
        self.targets = []
        for target, n in ((sums[1] + sums[2], n_texts[1] + n_texts[2]), (sums[1], n_texts[1]), (sums[2], n_texts[2])):
            shares = share * np.exp(tilts(sums[0], target, int(n_texts[0]), int(n)))
            self.targets.append((URN * shares / (shares.sum() or 1.0)).astype(np.float32))

    def log_weight(self, found: np.ndarray, times: np.ndarray, which: int = 0) -> float:
        """Log importance weight of a text with these buckets; which: all good texts, or the first or second half of them."""
        raw, target = self.raw[found].astype(np.float64), self.targets[which][found].astype(np.float64)
        once = raw > 0  # a bucket of no counted text says nothing
        total = float(np.log(target[once] / raw[once]).sum())
        more = once & (times > 1)
        if more.any():
            c, r, t = times[more].astype(np.float64), raw[more], target[more]
            total += float((log_gamma(t + c) - log_gamma(t + 1) - log_gamma(r + c) + log_gamma(r + 1)).sum())
        return total


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_labels: int = MAX_LABELS, id_col: str = "doc_id", text_col: str = "text") -> tuple[Models, tuple[np.ndarray, np.ndarray]]:
    """The models, and the labelled documents' ids and labels."""
    size = KINDS << bits
    known = labelled(labels, max_labels)
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last place counts texts
        sums = np.zeros((len(COUNTS), size + 1), np.int64)
        for batch in batches:
            for body, half in zip(batch.column(1), folds(batch.column(0), *sent.value).tolist(), strict=True):
                found = np.append(buckets(body.as_py(), bits)[0], size)
                sums[0, found] += 1
                if half in (0, 1):
                    sums[1 + half, found] += 1
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at]) for x in sums)], names=["bucket", *COUNTS])

    rows = as_bytes(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    counts = map_batches(rows, run, ", ".join(f"{c} long" for c in ("bucket", *COUNTS))).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in COUNTS]).toArrow()
    sums = np.zeros((len(COUNTS), size + 1))
    at = counts.column("bucket").to_numpy()
    for k, c in enumerate(COUNTS):
        sums[k, at] = counts.column(c).to_numpy()
    return Models(sums[:, :size], sums[:, size], bits), known


#: Columns that ``weigh`` adds: log weight; that by the other half's model, and the fold, of labelled rows.
NAMES = ("log_weight", "fold_weight", "fold")


def weigh(docs: DataFrame, models: Models, known: tuple[np.ndarray, np.ndarray], names: tuple[str, ...] = NAMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with NAMES as last columns, under these names."""
    sent = docs.sparkSession.sparkContext.broadcast((models, known))
    at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, labels = sent.value
        for batch in batches:
            total, other = [], []
            fold = folds(batch.column(id_at).cast(pa.int64()), *labels)
            for x, half in zip(batch.column(at).cast(pa.binary()), fold.tolist(), strict=True):
                found, times = buckets(x.as_py(), own.bits)
                total.append(own.log_weight(found, times))
                other.append(own.log_weight(found, times, 2 - half % 2) if half >= 0 else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total, pa.float64()), pa.array(other, pa.float64()), pa.array(fold.astype(np.float64))], names=[*batch.schema.names, *names])

    return map_batches(docs, run, StructType([*docs.schema.fields, *(StructField(n, DoubleType()) for n in names)]))


def cut_of(weights: np.ndarray, good: np.ndarray, lost: int = LOST) -> float:
    """The cut that errs least on these texts, halfway between the last it rejects and the first it keeps; -inf if nothing is worth rejecting."""
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    # rejecting the first i texts
    error = np.concatenate(([0], np.cumsum(np.where(g, lost, -1))))
    possible = np.concatenate(([True], w[1:] > w[:-1], [True]))[: error.size]
    best = int(np.where(possible, error, error.max() + 1).argmin())
    return float("-inf") if not best else float((w[best - 1] + w[best]) / 2) if best < w.size else float(np.nextafter(w[-1], np.inf))


def gumbel(id_col: str = "doc_id", seed: int = SEED) -> F.Column:
    """Gumbel noise, the same for the same id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the long column ``q``, by ever narrower histograms."""
    lo, hi = keys.agg(F.min("q"), F.max("q")).first()
    if lo is None or k < 1:
        return None
    while lo < hi:
        width = (hi - lo) // 1024 + 1
        bins = keys.where(F.col("q").between(lo, hi)).groupBy(F.floor((F.col("q") - lo) / width).alias("bin")).count().collect()
        for b in sorted(bins, reverse=True):
            if k <= b["count"]:
                break
            k -= b["count"]
        else:
            return lo
        lo, hi = lo + b["bin"] * width, min(hi, lo + b["bin"] * width + width - 1)
    return lo


def _fresh(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def chosen(weighed: DataFrame, names: tuple[str, ...], k: int | None, share: float | None, seed: int, temperature: float, id_col: str) -> tuple[float, F.Column, F.Column]:
    """The cut, the Gumbel key, and whether a row is among the k largest; weighed must be written, for it is read several times."""
    weight, other, fold = names
    known = weighed.where(F.col(fold) >= 0).select(other, fold).toArrow()
    # what the models hardly tell from the raw text is kept
    cut = min(cut_of(known.column(0).to_numpy(), known.column(1).to_numpy() < 2), -LEAST)
    key = F.col(weight) + temperature * gumbel(id_col, seed)
    if k is None:
        k = weighed.where(F.col(weight) >= cut).count() if share is None else int(share * weighed.count())
    least = kth_largest(weighed.select(F.floor(key * STEP).alias("q")), k)
    return cut, key, F.lit(False) if least is None else F.floor(key * STEP) >= least


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None, seed: int = SEED, temperature: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight, gumbel_key, rejected and selected, one row per document."""
    models, known = train(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut_lineage(weigh(rows, models, known).drop("text"))
    cut, key, taken = chosen(rows, NAMES, k, share, seed, temperature, "doc_id")
    return rows.select("doc_id", "log_weight", key.alias("gumbel_key"), (F.col("log_weight") < cut).alias("rejected"), taken.alias("selected"))


def select(docs: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None, seed: int = SEED, temperature: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the resampling selects, with their own columns. They are written once with their weights, and not weighed again.

    The temperature is low: this is a filter, and noise decides between documents of nearly the same weight only.
    """
    spark = docs.sparkSession
    models, known = train(docs, labels, id_col=id_col, text_col=text_col)
    names = tuple(_fresh(n, docs.columns) for n in NAMES)
    folder = shared_folder(spark)
    weigh(docs, models, known, names, id_col, text_col).write.parquet(folder)
    weighed = spark.read.parquet(folder)
    _, _, taken = chosen(weighed, names, k, share, seed, temperature, id_col)
    return weighed.where(taken).select(*docs.columns)
