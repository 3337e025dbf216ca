"""SimHash near-duplicate groups by covering locality-sensitive hashing.

Each text gets a 64-bit fingerprint: the majority of the XXH64 values of its
word shingles, bit by bit. Texts link when their fingerprints differ in at most
three bits, and a group is a connected component of these links.

Candidates come from structured masks. Bit i carries a nonzero vector m(i) of
four bits; for each nonzero vector v, mask v shows the bits with <m(i), v> = 1.
Three differing bits span at most three of four dimensions, so some v is
orthogonal to all of them: its mask shows none of these bits, and both
fingerprints fall in one bucket of table v. No pair within the radius is lost.

A bucket shows 32 to 34 bits. One with more than ``HOT_BUCKET`` fingerprints is
dealt out again by a second set of masks over the bits hidden so far; then at
most 16 bits are free, so no bucket can hold more than 65,536 fingerprints,
however the texts are distributed. Equal fingerprints are merged before the
tables are built: exact copies cost one row per map task.

Inside a bucket links are found by exact bit counts and given as a star from the
least member, never as all pairs. Components come from alternating large-star
and small-star rounds, each cut at the checkpoint folder.

Defined cases: a null or blank text has fingerprint zero and is linked like any
other. Repeated rows each come back. A null doc_id takes part but never names a
component; a component of such rows only has a null component_id. An empty table gives an empty
result. Only the id and text columns are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import as_bytes, cut_lineage, map_batches, shared_folder

BITS, RADIUS, SEED, SHINGLE = 64, 3, 42, 3
HOT_BUCKET = 4096
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(body: bytes | None) -> int:
    """Signed 64-bit SimHash of UTF-8 bytes; bytes.lower and bytes.split touch ASCII only, as wanted."""
    words = (body or b"").lower().split()
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return int(np.array([digest(line, SEED)], dtype=np.uint64).view(np.int64)[0])
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], stop[:-1] + 1))[:n]
    stop = stop[SHINGLE - 1 :]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        spans = zip(start[at : at + CHUNK].tolist(), stop[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(line[i:j], SEED) for i, j in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([fingerprint(x.as_py()) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "fp"])

    rows = as_bytes(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    return map_batches(rows, run, "doc_id long, fp long")


def masks(positions: list[int]) -> list[int]:
    """Covering masks over these bit positions, as signed longs."""
    n = (1 << RADIUS + 1) - 1
    out = []
    for v in range(1, n + 1):
        shown = sum(1 << p for k, p in enumerate(positions) if bin((k % n + 1) & v).count("1") % 2)
        out.append(shown - (1 << BITS) if shown >> BITS - 1 else shown)
    return out


FIRST = masks(list(range(BITS)))
#: For each first mask, the second masks over the bits that it hides.
SECOND = [masks([i for i in range(BITS) if not m >> i & 1]) for m in FIRST]


def star(values: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Connected parts of distinct fingerprints: (least member, other member) rows."""
    left, roots, members = np.sort(values), [], []
    while left.size > 1:
        root, front, left = left[0], [left[0]], left[1:]
        while front and left.size:
            near = np.bitwise_count(left ^ front.pop()) <= RADIUS
            if near.any():
                found, left = left[near], left[~near]
                front.extend(found)
                members.append(found)
                roots.append(np.full(found.size, root))
    return roots, members


def _link(batches: Iterator[pa.RecordBatch], hot: int | None) -> Iterator[pa.RecordBatch]:
    """Batches of (t, k, fp) sorted by bucket (t, k): links, and the rows of buckets above ``hot`` for the next masks."""
    names = ["t", "a", "b"]

    def links(roots: list[np.ndarray], members: list[np.ndarray]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (roots, members))
        return pa.RecordBatch.from_arrays([pa.nulls(a.size, pa.int32()), pa.array(a), pa.array(b)], names=names)

    def overflow(t: int, fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(fps.size, t, np.int32)), pa.array(fps), pa.nulls(fps.size, pa.int64())], names=names)

    held, held_at, spilled = [], None, False  # the open bucket's rows, its key, and whether it passed the limit

    def close() -> Iterator[pa.RecordBatch]:
        if held and not spilled:
            fps = np.concatenate(held)
            if fps.size > 1:
                yield links(*star(fps))

    for batch in batches:
        t, k, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not fp.size:
            continue
        edge = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
        begin, end = np.concatenate(([0], edge)), np.concatenate((edge, [fp.size]))
        whole = np.ones(begin.size, bool)
        whole[[0, -1]] = False  # may go on in another batch
        pairs = begin[whole & (end - begin == 2)]
        near = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= RADIUS
        p = pairs[near]
        roots, members = [np.minimum(fp[p], fp[p + 1])], [np.maximum(fp[p], fp[p + 1])]
        for i in np.flatnonzero(whole & (end - begin > 2)).tolist():
            part = fp[begin[i] : end[i]]
            if hot and part.size > hot:
                yield overflow(int(t[begin[i]]), part)
            else:
                r, m = star(part)
                roots += r
                members += m
        yield links(roots, members)
        for i in sorted({0, begin.size - 1}):
            at, part = (int(t[begin[i]]), int(k[begin[i]])), fp[begin[i] : end[i]]
            if at != held_at:
                yield from close()
                held, held_at, spilled = [], at, False
            if spilled:
                yield overflow(at[0], part)
                continue
            held.append(part)
            if hot and sum(x.size for x in held) > hot:
                yield overflow(at[0], np.concatenate(held))
                held, spilled = [], True
    yield from close()


def links(nodes: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links (a < b) that connect all of nodes' distinct ``fp`` values within the radius."""
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(FIRST)])
    rows = nodes.select("fp", F.explode(keys).alias("x")).select("x.t", "x.k", "fp")
    dealt = rows.repartition("t", "k").sortWithinPartitions("t", "k")
    found = cut_lineage(map_batches(dealt, lambda x: _link(x, hot_bucket), "t int, a long, b long"))
    out, over = found.where("t is null").select("a", "b"), found.where("t is not null")
    if not over.isEmpty():
        again = F.lit(None)
        for i, (shown, hidden) in enumerate(zip(FIRST, SECOND, strict=True)):
            kinds = [F.struct(F.lit(i * len(FIRST) + j).alias("t"), F.col("a").bitwiseAND(F.lit(shown | m)).alias("k")) for j, m in enumerate(hidden)]
            again = F.when(F.col("t") == i, F.array(*kinds)).otherwise(again)
        rows = over.select(F.col("a").alias("fp"), F.explode(again).alias("x")).select("x.t", "x.k", "fp").repartition("t", "k").sortWithinPartitions("t", "k")
        out = out.unionByName(map_batches(rows, lambda x: _link(x, None), "t int, a long, b long").select("a", "b"))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a < b); root is the least node of its component.

    Each round is a large-star and a small-star step. Minima are combined before
    each shuffle and joined back, so a node with many links is never one group
    in memory, and adaptive execution can split its join.
    """
    edges, before = cut_lineage(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(small.select(F.col("m").alias("x"), F.col("b").alias("y")))
        edges = cut_lineage(small.where("x < y").distinct().select(F.col("x").alias("a"), F.col("y").alias("b")))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def groups(nodes: DataFrame) -> DataFrame:
    """fp and root (its component's least fingerprint) of distinct ``fp`` values."""
    joined = components(links(nodes))
    return nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable, itself included); one row per input row."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = groups(nodes.select("fp")).join(nodes, "fp")
    # written, so that no aggregate stands under the join: adaptive execution can then split the rows of a large component
    named = cut_lineage(roots.groupBy("root").agg(F.min("least_id").alias("component_id")))
    known = roots.join(named, "root").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with exactly one row of each near-duplicate group: that of the least id, nulls last; of rows with this id
    the one with the least hash of its text, and of equal ones the first as written.

    Rows are told apart by a number that is written with them once, never by their ids: rows that share an
    id but not a group each stay.
    """
    spark, taken = docs.sparkSession, {c.lower() for c in docs.columns}
    fp, row = (next(n for n in (f"{name}{'_' * k}" for k in range(99)) if n not in taken) for name in ("fp", "row"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([fingerprint(x.as_py()) for x in batch.column(at).cast(pa.binary())], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, fp])

    folder = shared_folder(spark)
    map_batches(docs, run, StructType([*docs.schema.fields, StructField(fp, LongType())])).withColumn(row, F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    order = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(row).alias("row"))
    # first by fingerprint, before the join: exact copies cost one row per map task
    nodes = cut_lineage(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("first")))
    kept = groups(nodes.select("fp")).join(nodes, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_kept"))
    return rows.join(kept, rows[row] == kept["_kept"], "left_semi").select(*docs.columns)
