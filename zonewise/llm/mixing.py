"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule: a piecewise-linear shape over training
progress, scaled so that its integral is the source's target. The integral up to
t is the words that the source has been asked for by then. Its documents stand in
a fixed random order and are read in epochs; a copy of a document is due when
half its words have been asked for, so inverting the integral there gives its
training position. Copies that are never due are not taken.

Targets share ``share`` of all words by weight; one stops at ``repeat`` times its
source's words, and the excess goes to the others by weight until none is above.
With the sources sorted by (limit / weight), the stopped ones come first, so one
running sum over the table of sources settles it; it is taken range by range.

Running sums never hold a source in one task: documents are bucketed by source
and hash, summed by bucket, and each bucket gets the sum of those before it, in two
levels. A bucket has at most about ``bucket_rows`` documents whatever the sources'
sizes, a run has 2 ** SUPER buckets, and one task sees one row for each run of a source.

Defined cases: null or blank texts have size 0 and are never taken; a null source
is a source of its own and stands last; repeated rows each take their turn; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

WEIGHTS, REPEAT, SHARE = (5, 2, 1), 3, 1.0
#: Weight against progress, by source in turn: level, early, late.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
BUCKET_ROWS, SUPER = 300, 10
WORDS = r"[^\x20\x09-\x0D]+"


def _invert(u: F.Column, knots: tuple[tuple[float, float], ...]) -> F.Column:
    """Progress at which the share u of the schedule's integral is reached: a square root in each segment."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    out, total, done = F.lit(1.0), sum(areas), 1.0
    for k in reversed(range(len(areas))):
        (t0, w0), (t1, w1) = knots[k : k + 2]
        end, done = done, done - areas[k] / total
        left = (u - max(done, 0.0)) * total
        slope = (w1 - w0) / (t1 - t0)
        t = t0 + 2 * left / (w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * left, F.lit(0.0))))
        out = t if k == len(areas) - 1 else F.when(u < end, t).otherwise(out)
    return out


def running(rows: DataFrame, order: F.Column, **sums: str) -> DataFrame:
    """rows with the sums of columns over all earlier rows in this order (no ties), as columns by these names.

    Rows are dealt out by range; one row per range reaches the driver, and no task sees more than its range.
    """
    dealt = cut_lineage(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    ahead, table = dict.fromkeys(sums, 0), []
    for r in sorted(dealt.groupBy("_range").agg(*[F.sum(c).alias(name) for name, c in sums.items()]).collect()):
        table.append((r["_range"], *ahead.values()))
        ahead = {name: ahead[name] + (r[name] or 0) for name in sums}
    before = rows.sparkSession.createDataFrame(table, "_at int, " + ", ".join(f"_{n} long" for n in sums))
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(name) for name, c in sums.items()])
    dealt = dealt.join(F.broadcast(before), dealt["_range"] == before["_at"])
    return dealt.select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT, share: float = SHARE) -> DataFrame:
    """sizes (source, source_size) with rank, weight and target. Sources may be many: they are ranked and summed by ranges."""
    ranked = running(sizes.withColumn("_one", F.lit(1)), F.col("source").asc_nulls_last(), rank="_one").drop("_one")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("rank") % len(weights)) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_limit", F.lit(repeat) * F.col("source_size"))
    by_ratio = F.struct(F.col("_limit") / F.col("weight"), "rank").asc()
    ranked = cut_lineage(running(ranked, by_ratio, _below="_limit", _lighter="weight"))
    total, weighing = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    total = total if share == 1.0 else total * share
    stopped = F.col("_limit").cast("double") * (F.lit(weighing) - F.col("_lighter")) <= (F.lit(total) - F.col("_below")).cast("double") * F.col("weight")
    ranked = ranked.withColumn("_stopped", stopped)
    taken, open_weights = ranked.agg(F.coalesce(F.sum(F.when(F.col("_stopped"), F.col("_limit"))), F.lit(0)), F.sum(F.when(~F.col("_stopped"), F.col("weight")))).first()
    target = F.when(F.col("_stopped"), F.col("_limit").cast("double")).otherwise(F.lit(total - taken) * F.col("weight") / F.lit(open_weights))
    return ranked.select("source", "source_size", "rank", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules=SCHEDULES, repeat: int = REPEAT, share: float = SHARE, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken and positions (one per copy, in 0..1), in training order.

    Rows are range-sorted by their first position, those not taken last.
    """
    turn = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), turn.alias("turn"))
    rows = cut_lineage(rows)
    n_buckets = max(1, rows.count() // bucket_rows)
    bucket = F.shiftright(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * n_buckets, 32)
    # a null source gets a key of its own
    rows = rows.select("*", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"), bucket.alias("bucket"))
    parts = rows.groupBy("key", "source", "bucket").agg(F.sum("size").alias("part"))
    sources = targets(parts.groupBy("key", "source").agg(F.sum("part").alias("source_size")).select("source", "source_size"), weights, repeat, share)
    sources = sources.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    # sums of earlier buckets in two levels: within 2 ** SUPER buckets, and over such runs of a source
    before = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "bucket", "part", F.shiftright("bucket", SUPER).alias("run"))
    runs = parts.groupBy("key", "run").agg(F.sum("part").alias("part"))
    runs = runs.select("key", "run", F.coalesce(F.sum("part").over(before("key", by="run")), F.lit(0)).alias("run_ahead")).join(sources, "key")
    parts = parts.select("key", "run", "bucket", F.coalesce(F.sum("part").over(before("key", "run", by="bucket")), F.lit(0)).alias("bucket_ahead")).join(runs, ["key", "run"])
    parts = parts.withColumn("ahead", F.col("run_ahead") + F.col("bucket_ahead")).drop("run", "run_ahead", "bucket_ahead")
    within = Window.partitionBy("key", "bucket").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(parts, ["key", "bucket"])
    half = F.col("ahead") + F.col("inner") + F.col("size") / 2
    due = lambda e: F.when((F.col("size") > 0) & (half + e * F.col("source_size") <= F.col("target")), (half + e * F.col("source_size")) / F.col("target"))
    shares = F.filter(F.array(*[due(e) for e in range(repeat)]), lambda u: u.isNotNull())
    n = len(schedules)
    position = lambda u: F.coalesce(*[F.when(F.col("rank") % n == k, _invert(u, s)) for k, s in enumerate(schedules)])
    rows = rows.withColumn("positions", F.transform(shares, position)).withColumn("copies", F.size("positions"))
    rows = rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "positions", F.get("positions", F.lit(0)).alias("first_position"))
    return rows.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy taken, range-sorted by training position."""
    return mixed.select("doc_id", "size", F.posexplode("positions").alias("epoch", "position")).orderBy("position", "doc_id", "epoch")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with copies and positions (overwritten if docs has such columns), in training order.

    Documents with equal ids get the most that one of them is given; null ids are equal here.
    """
    id_col = options.get("id_col", "doc_id")
    mixed = mix(docs, **options).where("copies > 0").groupBy("doc_id").agg(F.max(F.struct("copies", "positions")).alias("due"))
    rows = docs.select(F.col(id_col).alias("id"), F.struct("*").alias("row"))
    rows = rows.join(mixed, rows["id"].eqNullSafe(mixed["doc_id"])).select("row", "due")
    rows = rows.orderBy(F.get("due.positions", F.lit(0)), F.col(f"row.{id_col}"))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("copies", "positions")]
    return rows.select(*own, F.col("due.copies"), F.col("due.positions"))
