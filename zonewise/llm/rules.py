"""Quality rules: base statistics of a text, and a decision list learned from labelled rows.

The list is grown by sequential covering. A rule for bad texts starts empty and
takes the threshold condition with the best information gain until it covers no
good row of the growing part; then conditions are pruned from its end while that
raises (bad - good) / (bad + good) on the pruning part. A rule is kept if it is
precise on the pruning part, the rows it covers are taken out, and the next one
is grown. The list becomes one ordered Spark CASE expression over the columns.

Learning reads the statistics of at most ``MAX_LABELS`` labelled rows (those with
the least hash of their doc_id); the statistics and the verdict cover all rows.

Defined cases: a null or blank text has no words, so it fails the base rule;
repeated rows each come back, and of labelled rows with one id that with the least
statistics is learned from; labels of unknown documents or with a null quality
are ignored; without bad labels the list is empty and every row that passes the
base rule is kept; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

MAX_LABELS = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A rule has at most so many conditions, the list at most so many rules.
MAX_CONDITIONS, MAX_RULES = 3, 12
#: A rule stays if at least this share of what it covers in the pruning part is bad, and it covers so many bad rows.
MIN_PRECISION, MIN_COVER = 0.95, 3

SYMBOLS = re.compile(rb"[#*$%&|<>]+")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_digits", "n_upper", "n_long")
#: Columns that conditions may use; the shares are per 1,000 words or characters.
FEATURES = {
    "mean_word": lambda c: c("word_chars") / F.greatest(c("n_words"), F.lit(1)),
    "symbol_share": lambda c: 1000 * c("n_symbols") / F.greatest(c("word_chars"), F.lit(1)),
    "dup_line_share": lambda c: 1000 * c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
    "repeat_share": lambda c: 1000 * c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)),
    "distinct_share": lambda c: 1000 * c("n_distinct") / F.greatest(c("n_words"), F.lit(1)),
    "digit_share": lambda c: 1000 * c("n_digits") / F.greatest(c("word_chars"), F.lit(1)),
    "upper_share": lambda c: 1000 * c("n_upper") / F.greatest(c("n_words"), F.lit(1)),
    "long_share": lambda c: 1000 * c("n_long") / F.greatest(c("n_words"), F.lit(1)),
}

Condition = tuple[str, str, float]  # feature, "<=" or ">", threshold
Rule = list[Condition]

UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
#: Bytes that start a code point.
NOT_LEADING = bytes(range(0x80, 0xC0))


def statistics(body: bytes | None) -> tuple[int, ...]:
    """STATS of one text's UTF-8 bytes. bytes.split parts at ASCII white space only."""
    body = body or b""
    words = body.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.translate(None, NOT_LEADING))
    symbols = sum(len(m) for m in SYMBOLS.findall(body))
    lines = [x for x in body.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= 3:
        ids = {}
        codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        if len(ids) < n:
            size = len(ids)
            pairs = codes[:-1] * size + codes[1:]
            _, pairs = np.unique(pairs, return_inverse=True)
            _, at, count = np.unique(pairs[:-1].astype(np.int64) * size + codes[2:], return_inverse=True, return_counts=True)
            twice = np.flatnonzero(count[at] > 1)
            if twice.size:
                hit = np.zeros(n, bool)
                for k in range(3):
                    hit[twice + k] = True
                repeated = int(hit.sum())
    upper = len(joined) - len(joined.translate(None, UPPER))
    digits = len(joined) - len(joined.translate(None, DIGITS))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), len(set(words)), digits, upper, sum(len(w) > 15 for w in words)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATS, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x.as_py()) for x in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in STATS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *STATS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    return map_batches(rows, run, "doc_id long, " + ", ".join(f"{s} long" for s in STATS))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, op, at in rule:
        out &= x[name] <= at if op == "<=" else x[name] > at
    return out


def best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition] | None:
    """The threshold condition with the best information gain for bad rows; thresholds lie halfway between values."""
    p, n = bad.sum(), (~bad).sum()
    before, best = np.log2(p / (p + n)), None
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v, b = values[order], bad[order]
        ends = np.flatnonzero(v[1:] > v[:-1])
        if not ends.size:
            continue
        low_p, low_n = np.cumsum(b)[ends], np.cumsum(~b)[ends]
        for op, pos, neg in (("<=", low_p, low_n), (">", p - low_p, n - low_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (np.log2(pos / (pos + neg)) - before), -np.inf)
            k = int(gain.argmax())
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-9):
                best = (float(gain[k]), (name, op, float((v[ends[k]] + v[ends[k] + 1]) / 2)))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray) -> list[Rule]:
    """Rules for bad rows, in order. ``prune`` marks the pruning part."""
    rules: list[Rule] = []
    left = np.ones(bad.size, bool)
    while len(rules) < MAX_RULES and (bad & left & ~prune).sum() >= MIN_COVER:
        grow, rule = left & ~prune, []
        while len(rule) < MAX_CONDITIONS and (grow & ~bad).any():
            found = best_condition({k: v[grow] for k, v in x.items()}, bad[grow])
            if not found:
                break
            rule.append(found[1])
            grow &= covers([found[1]], x)
        if not rule:
            break

        def worth(r: Rule) -> float:
            c = covers(r, x) & left & prune
            p, n = (c & bad).sum(), (c & ~bad).sum()
            return (p - n) / max(p + n, 1)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        c = covers(rule, x) & left & prune
        if (c & bad).sum() < MIN_COVER or (c & bad).sum() < MIN_PRECISION * c.sum():
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def sample_labels(labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id and quality of at most max_labels labelled rows."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labels)


def learn_from(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """The decision list for these documents. The labelled sample is bounded, so it is broadcast and its statistics are gathered."""
    sample = F.broadcast(sample_labels(labels, max_labels).withColumnRenamed("doc_id", "_labelled"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = F.broadcast(sample.select("_labelled").distinct())
    known = measure(rows.join(ids, rows["doc_id"] == ids["_labelled"], "left_semi")).where(~base_failed())
    # rows that share an id: the one with the least statistics, whatever the order of reading
    known = known.groupBy("doc_id").agg(F.min(F.struct(*STATS)).alias("x")).select("doc_id", "x.*")
    known = known.join(sample, known["doc_id"] == sample["_labelled"])
    got = known.select("doc_id", "quality", *[e(F.col).cast("double").alias(k) for k, e in FEATURES.items()]).toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    if not got.num_rows:
        return []
    x = {k: got.column(k).to_numpy() for k in FEATURES}
    ids = got.column("doc_id").to_numpy().astype(np.uint64)
    prune = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(3) == 0
    return learn(x, got.column("quality").to_numpy() == 0, prune)


def verdict(rules: list[Rule]) -> F.Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for name, op, at in rule:
            value = FEATURES[name](F.col)
            holds &= value <= at if op == "<=" else value > at
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base statistics, base_failed, kept, and the number of the rule that rejects."""
    rules = learn_from(docs, labels, id_col=id_col, text_col=text_col)
    rows = measure(docs, id_col, text_col).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules).cast("int"))
    return rows.select("doc_id", *STATS[:5], "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")


def explain(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> str:
    """The decision list in words, one rule a line."""
    rules = learn_from(docs, labels, text_col=text_col)
    return "\n".join([f"{k}. bad if " + " and ".join(f"{n} {op} {at:g}" for n, op, at in r) for k, r in enumerate(rules, 1)] + ["otherwise good"])
