"""Language identification by interpolated Kneser-Ney character models.

Letters are lower-cased code points; anything else is one boundary, and runs of
it collapse. For each language the n-grams of ``ORDER`` letters of all its
training texts are counted; the model backs off from them over continuation
counts of the shorter ones, down to single letters and the uniform distribution
over all code points, each step with an absolute discount estimated from the
counts of counts.

A model is a pair of sorted arrays for each order: 64-bit n-gram hashes, and their
log-probabilities; for the contexts their back-off weights likewise. Look-up is by
binary search. The arrays hold every n-gram seen, so they grow with the corpus.

A text gets the language with the least cross-entropy per character. Its score is
the calibrated probability of the winner; rejection marks texts whose
cross-entropy is above what ``REJECT`` of a bounded sample of the language's own
texts reach. This sample is left out of the counts, except for a language that
has no other text.

Defined cases: a null text or one without a letter (marks are none) is "und" with score 0; texts
of documents with a null lang are not learned from; without any training text all
are "und"; repeated rows each come back; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, map_batches

#: Letters of an n-gram; two integers hold their code points.
ORDER = 5
POINT_BITS = 21
#: Code points, 0 for the boundary; single letters are the n-grams of order 1.
CLASSES = GRAMS = 0x110000
UNKNOWN = "und"
#: Texts that calibrate scores and rejection: one in CALIBRATION_SHARE, by a hash of their doc_id, the least hashes first.
CALIBRATION_ROWS, CALIBRATION_SHARE, REJECT = 2_000, 20, 0.995
#: Code points turned into n-grams at once.
CHUNK = 1 << 20
#: Distinct n-grams that a counting task holds before it hands them on, and rows of its batches.
HELD, ROWS = 1 << 21, 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point: 0 for what is no letter (or a mark), else the lower-case letter."""
    out = np.zeros(CLASSES, np.int32)
    for c in range(CLASSES):
        if unicodedata.category(s := chr(c))[0] in "LM":
            out[c] = ord(s.lower()[0])
    return out


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    """By class: whether it is a letter and no mark."""
    own = letters()
    out = np.zeros(CLASSES, bool)
    out[[c for c in np.unique(own).tolist() if unicodedata.category(chr(c))[0] == "L"]] = True
    return out


def hashed(windows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row."""
    h = np.full(len(windows), windows.shape[1], np.uint64)
    for column in windows.T:
        h = (h + column.astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    return h * MIX


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts h, where each value starts in it, and each value's number of rows."""
    order = np.argsort(h)
    own = h[order]
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))[: own.size])
    return order, starts, np.diff(np.append(starts, own.size))


def inverse(order: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row the number of its value."""
    out = np.empty(order.size, np.int64)
    out[order] = np.repeat(np.arange(sizes.size), sizes)
    return out


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams (rows of ORDER letters) of these texts in one array, and each text's end in it. A text is framed by boundaries."""
    sizes = np.fromiter((len(t or "") + 2 for t in texts), np.int64, len(texts))
    raw = np.frombuffer("".join(f" {t or ''} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = letters()[raw]
    ends = np.cumsum(sizes)
    first = np.zeros(raw.size, bool)
    first[np.concatenate(([0], ends[:-1]))[sizes > 0]] = True
    keep = (kind > 0) | np.concatenate(([True], kind[:-1] > 0)) | first
    at = np.cumsum(keep)[ends - 1] if ends.size else ends
    kind = kind[keep]
    starts = np.concatenate(([0], at[:-1]))[: at.size]
    out = np.zeros((kind.size, ORDER), np.int32)
    out[:, -1] = kind
    for k in range(1, ORDER):
        out[k:, -1 - k] = kind[:-k]
    # the first positions of a text see only boundaries before them
    for k in range(ORDER - 1):
        out[(starts + k)[starts + k < at], : ORDER - 1 - k] = 0
    counted = np.ones(kind.size, bool)
    counted[starts] = False  # the leading boundary itself is given
    return out[counted], np.cumsum(counted)[at - 1] if at.size else at


def pack(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the first letters, and of the last three, in an integer each."""
    out = []
    for part in (windows[:, :-3], windows[:, -3:]):
        x = np.zeros(len(part), np.int64)
        for column in part.T:
            x = x << POINT_BITS | column
        out.append(x)
    return out[0], out[1]


def unpack(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    mask = (1 << POINT_BITS) - 1
    columns = [head >> POINT_BITS * k & mask for k in range(ORDER - 4, -1, -1)] + [tail >> POINT_BITS * k & mask for k in (2, 1, 0)]
    return np.stack(columns, axis=1).astype(np.int32)


def batches_of(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about CHUNK code points, with the first one's index."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, head, tail, n: counts of packed n-grams over every text. Tasks hold at most about HELD sums before they hand them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, ...]]] = {}

        def add(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            h, n, head, tail = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, starts, _ = distinct(h)
            first = order[starts]
            return h[first], np.add.reduceat(n[order], starts), head[first], tail[first]

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                _, n, head, tail = add(parts)
                for k in range(0, n.size, ROWS):
                    part = slice(k, k + ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n[part].size, pa.string()), pa.array(head[part]), pa.array(tail[part]), pa.array(n[part])], names=["lang", "head", "tail", "n"])
            held.clear()

        size = 0
        for batch in batches:
            by: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for _, part in batches_of(texts):
                    windows, _ = grams(part)
                    if len(windows):
                        h = hashed(windows)
                        order, starts, n = distinct(h)
                        first = order[starts]
                        held.setdefault(lang, []).append((h[first], n, *pack(windows[first])))
                        size += n.size
            if size > HELD:
                for lang in held:
                    held[lang] = [add(held[lang])]
                size = sum(x[0][0].size for x in held.values())
                if size > HELD // 2:
                    yield from rows()
                    size = 0
        yield from rows()

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "lang string, head long, tail long, n long").groupBy("lang", "head", "tail").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities of one language in sorted hash arrays, one pair for each order."""

    def __init__(self, windows: np.ndarray, n: np.ndarray):
        # continuation counts: after how many letters a shorter n-gram has been seen
        levels = []
        while windows.shape[1]:
            order, starts, sizes = distinct(hashed(windows[:, 1:]))
            suffix = inverse(order, sizes)
            levels.append((windows, n.astype(np.float64), suffix))
            windows, n = windows[order[starts], 1:], sizes
        self.grams, self.logp, self.contexts, self.backoff = [], [], [], []
        p = np.full(1, 1.0 / CLASSES)
        for windows, n, suffix in reversed(levels):
            d = self._discount(n)
            context = hashed(windows[:, :-1])
            order, starts, sizes = distinct(context)
            own = inverse(order, sizes)
            total = np.bincount(own, n, sizes.size)
            weight = d * sizes / total
            p = np.maximum(n - d, 0) / total[own] + weight[own] * p[suffix]
            gram = hashed(windows)
            by = np.argsort(gram)
            self.grams.append(gram[by])
            self.logp.append(np.log(p[by]).astype(np.float32))
            self.contexts.append(context[order[starts]])
            self.backoff.append(np.log(weight).astype(np.float32))

    @staticmethod
    def _discount(n: np.ndarray) -> float:
        once, twice = (n == 1).sum(), (n == 2).sum()
        return float(np.clip(once / (once + 2 * twice), 0.1, 0.9)) if once else 0.1

    def look_up(self, windows: np.ndarray, keys: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """Log-probabilities of each row's last letter after the others, by binary search; letters alone come as one dimension.

        Where an n-gram is unseen, the next shorter one's probability counts by the context's back-off weight.
        """
        if windows.ndim == 1:
            windows = windows[:, None]
        out = np.full(len(windows), -np.log(CLASSES), np.float32)
        for k, (context, gram) in enumerate(keys or keys_of(windows)):
            c = np.minimum(np.searchsorted(self.contexts[k], context), self.contexts[k].size - 1)
            seen = np.flatnonzero(self.contexts[k][c] == context)
            out[seen] += self.backoff[k][c[seen]]
            # an n-gram can't be seen without its context
            at = np.minimum(np.searchsorted(self.grams[k], gram[seen]), self.grams[k].size - 1)
            hit = self.grams[k][at] == gram[seen]
            out[seen[hit]] = self.logp[k][at[hit]]
        return out


def keys_of(windows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of context and n-gram by order."""
    return [(hashed(windows[:, -k:-1]), hashed(windows[:, -k:])) for k in range(1, windows.shape[1] + 1)]


class Identifier:
    """Models of all languages, with calibration."""

    def __init__(self, models: dict[str, Model]):
        self.names = sorted(models)
        self.models = [models[x] for x in self.names]
        self.sharpness, self.limits = 1.0, np.full(len(models), np.inf)

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Cross-entropy per character by text and language; NaN without a letter."""
        out = np.full((len(texts), len(self.names)), np.nan)
        for at, part in batches_of(texts):
            windows, ends = grams(part)
            begin = np.concatenate(([0], ends[:-1]))
            known = np.concatenate(([0], np.cumsum(is_letter()[windows[:, -1]])))
            has = known[ends] > known[begin]
            # each n-gram of the chunk is looked up once
            order, starts, sizes = distinct(hashed(windows))
            own, windows = inverse(order, sizes), windows[order[starts]]
            keys = keys_of(windows)
            for k, model in enumerate(self.models):
                sums = np.concatenate(([0.0], np.cumsum(model.look_up(windows, keys)[own], dtype=np.float64)))
                out[at : at + len(part), k][has] = (-(sums[ends] - sums[begin]) / np.maximum(ends - begin, 1))[has]
        return out

    def scores(self, h: np.ndarray) -> np.ndarray:
        """Probability of the best language by row."""
        return 1.0 / np.exp(-self.sharpness * (h - h.min(axis=1, keepdims=True))).sum(axis=1)

    def calibrate(self, h: np.ndarray, langs: list[str]) -> None:
        """Sharpness by likelihood over a fixed grid, and rejection limits by quantile, from entropies of labelled texts."""
        truth = np.array([self.names.index(x) for x in langs], np.int64)
        ok = ~np.isnan(h[:, 0])
        h, truth = h[ok], truth[ok]
        if not truth.size:
            return

        def loss(s: float) -> float:
            z = -s * (h - h.min(axis=1, keepdims=True))
            return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(truth.size), truth]).mean())

        self.sharpness = min((float(2.0**k) for k in range(-2, 8)), key=loss)
        for k in range(len(self.names)):
            own = h[truth == k, k]
            if own.size:
                self.limits[k] = np.quantile(own, REJECT)


def train(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", calibration_rows: int = CALIBRATION_ROWS) -> Identifier | None:
    """Models from all given documents but the calibration sample. The counts of one language at a time and the sample reach the driver."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    # ids first, so that no text is sorted; entropies are taken where the texts are
    turn = F.xxhash64("id")
    some = rows.select("id").where(F.pmod(turn, F.lit(CALIBRATION_SHARE)) == 0).distinct().orderBy(turn, "id").limit(calibration_rows)
    ids = F.broadcast(cut_lineage(some))
    sample = rows.join(ids, "id", "left_semi")
    counted = cut_lineage(counts(rows.join(ids, "id", "left_anti"), "lang", "text"))
    learned = {lang for (lang,) in counted.select("lang").distinct().collect()}
    only = {lang for (lang,) in sample.select("lang").distinct().collect()} - learned
    if only:
        counted = cut_lineage(counted.unionByName(counts(sample.where(F.col("lang").isin(sorted(only))), "lang", "text")))
    models = {}
    for lang in sorted(learned | only):
        got = counted.where(F.col("lang") == lang).select("head", "tail", "n").toArrow()
        head, tail, n = (c.to_numpy() for c in got.columns)
        if n.size:
            models[lang] = Model(unpack(head, tail), n)
    if not models:
        return None
    out = Identifier(models)
    sent = docs.sparkSession.sparkContext.broadcast(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = sent.value.entropies(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(h), pa.list_(pa.float64()))], names=["id", "lang", "h"])

    rows = map_batches(sample.where(F.col("lang").isin(out.names)).select("id", "lang", "text"), run, "id string, lang string, h array<double>").groupBy("id").agg(F.min(F.struct("lang", "h")).alias("x"))
    got = sorted((r["x"]["lang"], r["x"]["h"]) for r in rows.collect())
    out.calibrate(np.array([h for _, h in got]).reshape(len(got), len(out.names)), [x for x, _ in got])
    return out


def predict(docs: DataFrame, model: Identifier | None, *keep: str, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred, score and rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            own = sent.value
            langs, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if own is not None and texts:
                h = own.entropies(texts)
                ok = np.flatnonzero(~np.isnan(h[:, 0]))
                best = h[ok].argmin(axis=1)
                for i, k in zip(ok.tolist(), best.tolist(), strict=True):
                    langs[i] = own.names[k]
                score[ok] = own.scores(h[ok])
                rejected[ok] = h[ok, best] > own.limits[best]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs), pa.array(score), pa.array(rejected)], names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    rows = docs.select(*keep, F.col(text_col).alias("text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return map_batches(rows, run, f"{kinds}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from the documents that are not held out."""
    held = (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1).alias("held_out")
    rows = docs.select(F.col(id_col).alias("doc_id"), "text", "lang", held)
    return predict(rows.drop("lang"), train(rows.where("NOT held_out")), "doc_id", "held_out")
