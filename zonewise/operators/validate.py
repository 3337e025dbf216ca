"""Rule quality: per-row findings and overlaps between schools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.houses import rule_set, shared_numbers
from ..functions.text import blank, normalize_street, strip

#: Numbers shown of an overlap, and houses of a span from which a rule isn't cut in blocks.
PREVIEW, WIDE = 10, 4096
#: Rules of one class that meet a partner in one place.
CHUNK = 256


def intersections(rules: DataFrame, schools: DataFrame) -> DataFrame:
    """Pairs of rules of different schools on one street that share house numbers, the ten least of them.

    Rules of one street with the same lists and bounds are a class; classes are compared, each two once
    (``_class_pairs``), and what they share is written once. The result lists every pair of rules, so it grows
    with the square of a street's rules; all that is done for one of these pairs is to join it: the smaller class's rules are
    laid beside the larger one, which is met in chunks of ``CHUNK`` rules, so a popular street is spread
    over its classes and their chunks. School names are joined to the rules before that, not to the pairs.
    """
    names = schools.select(F.col("id").alias("_id"), F.col("name").alias("school"))
    sets = _sets(rules).join(names, F.col("school_id") == F.col("_id"), "left").select("k", "s", F.struct("id", "school_id", "street", F.coalesce("school", F.lit("—")).alias("school")).alias("rule"))
    classes = _sets(rules).groupBy("k", "s").agg(F.count("*").alias("n"))
    links = _class_pairs(classes).select("k", "few", "many", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk"))
    dealt = sets.join(classes.select(F.col("k").alias("_k"), F.col("s").alias("_s"), "n"), (F.col("k") == F.col("_k")) & (F.col("s") == F.col("_s")))
    dealt = dealt.select("k", "s", "rule", F.pmod(F.xxhash64("rule.id"), F.floor((F.col("n") - 1) / CHUNK) + 1).alias("chunk"))
    left = links.alias("l").join(sets.alias("x"), (F.col("l.k") == F.col("x.k")) & (F.col("few") == F.col("x.s"))).select("l.k", "many", "chunk", "text", (F.col("few") == F.col("many")).alias("own"), F.col("rule").alias("a"))
    met = (F.col("l.k") == F.col("y.k")) & (F.col("many") == F.col("y.s")) & (F.col("l.chunk") == F.col("y.chunk"))
    apart = ~F.col("a.school_id").eqNullSafe(F.col("b.school_id")) & ((F.col("a.id") < F.col("b.id")) | ((F.col("a.id") > F.col("b.id")) & ~F.col("own")))
    pairs = left.alias("l").join(dealt.withColumnRenamed("rule", "b").alias("y"), met & apart)
    first = F.col("a.id") < F.col("b.id")
    side = lambda c: F.when(first, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    other = lambda c: F.when(first, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    message = F.concat(F.lit(P.OVERLAP), side("street"), "text")
    return pairs.select(F.lit("error").alias("level"), F.lit("intersection").alias("type"), message.alias("message"), side("id").alias("rule_id"), other("id").alias("second_rule_id"), side("school").alias("school"), other("school").alias("second_school"))


def _sets(rules: DataFrame) -> DataFrame:
    """Rules that list or span a house, with their place and street (k) and what they list or span (s)."""
    key = F.concat_ws(":", strip(F.lower(blank("locality"))), normalize_street("street"))
    sets = rules.select("id", "school_id", "street", key.alias("k"), rule_set("house_rule_raw", "house_number", "house_from", "house_to", "parity").alias("s"))
    sets = sets.where((F.size("s.listed") > 0) | F.col("s.low").isNotNull())
    return sets.withColumn("s", F.struct(F.array_sort("s.listed").alias("listed"), "s.low", "s.high", F.when(F.col("s.low").isNotNull(), F.col("s.rest")).alias("rest")))


def _class_pairs(classes: DataFrame) -> DataFrame:
    """k, few, many (sets; the class of fewer rules is few), n (the larger one's rules) and text of every two classes that share numbers, and of each class of several rules with itself.

    Classes are compared by their lists and bounds, which is all that is shipped; no
    span is written out. The self-join is on (locality, street, block of 16 houses), so only classes that
    come near each other meet; a pair is reported from the block of its least common number. Classes that span
    more than ``WIDE`` houses (typing slips, mostly) would stand in too many blocks: they meet those of their street by the street alone.
    """
    sets = classes.withColumn("wide", F.coalesce(F.col("s.high") - F.col("s.low") > WIDE, F.lit(False)))
    no_blocks = F.array().cast("array<bigint>")
    blocks = F.array_union(F.transform("s.listed", lambda n: F.shiftright(n, 4)), F.when(F.col("s.low").isNotNull(), F.sequence(F.shiftright("s.low", 4), F.shiftright("s.high", 4))).otherwise(no_blocks))
    spread = sets.where("NOT wide").withColumn("block", F.explode(blocks))
    shared = shared_numbers(F.col("a.s"), F.col("b.s"), PREVIEW)
    two = ("a.k", "a.s", "a.n", F.struct("b.s", "b.n").alias("other"), shared.alias("shared"))
    once = (F.col("a.s") < F.col("b.s")) | ((F.col("a.s") == F.col("b.s")) & (F.col("a.n") > 1))
    near = spread.alias("a").join(spread.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.block") == F.col("b.block")) & once)
    near = near.select(*two, "a.block").where(F.shiftright(F.get("shared", F.lit(0)), 4) == F.col("block")).drop("block")
    far = sets.where("wide").alias("a").join(sets.alias("b"), (F.col("a.k") == F.col("b.k")) & (~F.col("b.wide") | once))
    both = near.unionByName(far.select(*two).where(F.size("shared") > 0))
    text = F.concat(F.lit(": дома ["), F.array_join(F.col("shared").cast("array<string>"), ", "), F.lit("]"))
    fewer = F.col("n") <= F.col("other.n")
    pick = lambda c, d: F.when(fewer, F.col(c)).otherwise(F.col(d))
    return both.select("k", pick("s", "other.s").alias("few"), pick("other.s", "s").alias("many"), F.greatest("n", "other.n").alias("n"), text.alias("text"))


def row_issues(rules: DataFrame, schools: DataFrame) -> DataFrame:
    """Findings about single rules, all in one pass; a rule may have several."""
    low, high = F.col("house_from"), F.col("house_to")
    issue = lambda when, level, kind, text: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(kind).alias("type"), text.alias("message")))
    found = F.array(
        issue(strip(blank("street")) == "", "error", "empty_street", F.lit(P.EMPTY_STREET)),
        issue(strip(blank("house_rule_raw")) == "", "warning", "empty_house_rule", F.lit(P.EMPTY_HOUSES)),
        issue((low != 0) & (high != 0) & (low > high), "error", "invalid_range", F.concat(F.lit(P.BAD_RANGE), low.cast("string"), F.lit("–"), high.cast("string"))),
        issue(~F.coalesce(F.col("parity").isin(*P.PARITIES), F.lit(False)), "warning", "unknown_parity", F.concat(F.lit(P.BAD_PARITY), F.coalesce("parity", F.lit("None")))),
    )
    names = schools.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    out = rules.select(F.col("id").alias("rule_id"), "school_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
    out = out.join(names, F.col("school_id") == F.col("_id"), "left")
    return out.select("x.level", "x.type", "x.message", "rule_id", F.lit(None).cast("long").alias("second_rule_id"), F.coalesce("_name", F.lit("—")).alias("school"), F.lit(None).cast("string").alias("second_school"))


def validate_rules(rules: DataFrame, schools: DataFrame) -> DataFrame:
    return row_issues(rules, schools).unionByName(intersections(rules, schools))
