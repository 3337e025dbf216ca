"""Address lookup: which school serves each of a batch of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.address import parse_address
from ..functions.houses import house_number, normalize_house, prepared_covers, prepared_rule
from ..functions.text import given, keys_match, locality_key, normalize_street, strip
from ..runtime import cut_lineage

RULE_COLUMNS = ("house_rule_raw", "rule_type", "parity", "house_from", "house_to", "house_number", "house_numbers", "exceptions")


def towns_of(schools: DataFrame, municipalities: DataFrame) -> DataFrame:
    """school_id and the name of its town, where it has one."""
    m = municipalities.select(F.col("id").alias("_town_id"), F.col("name").alias("town"))
    return schools.select(F.col("id").alias("_school"), "municipality_id").join(m, F.col("municipality_id") == F.col("_town_id"), "left").select("_school", "town")


def find_school(addresses: DataFrame, rules: DataFrame, schools: DataFrame, municipalities: DataFrame) -> DataFrame:
    """address_id and the id of the first rule (by id) that covers it; addresses without one are left out.

    An equi-join on the normalized street and the first four letters of the place:
    places that match agree in these, so no hit is lost, and a street name that
    every town has is spread over the towns. Rules without any place stand under
    "*", and all rules stand under "" too, for addresses without a place. Normal
    forms, lists and bounds are computed once per row, before the join.

    The least rule id is taken map-side before the second shuffle, so a street with
    many rules doesn't multiply what is moved. Neither side is broadcast by force:
    Spark picks by size, and adaptive execution splits hot streets.
    """
    place = F.when(given("locality"), locality_key("locality")).otherwise("")
    targets = addresses.select("address_id", normalize_street("street").alias("_street"), place.alias("_place"), house_number("house").alias("_n"), normalize_house("house").alias("_house"))
    blocks = F.when(F.col("_place") == "", F.array(F.lit(""))).otherwise(F.array(F.substring("_place", 1, 4), F.lit("*")))
    targets = targets.withColumn("_block", F.explode(blocks))
    rules = rules.join(towns_of(schools, municipalities), rules["school_id"] == F.col("_school"), "left")
    own = F.when(given("locality"), locality_key("locality")).otherwise("")
    town = F.when(given("town"), locality_key("town")).otherwise("")
    anywhere = ~given("locality") & ~given("town")
    sides = rules.select(F.col("id").alias("rule_id"), normalize_street("street").alias("_key"), own.alias("_own"), town.alias("_town"), anywhere.alias("_anywhere"), prepared_rule(*RULE_COLUMNS).alias("_rule"))
    starts = F.filter(F.array_distinct(F.array(F.substring("_own", 1, 4), F.substring("_town", 1, 4))), lambda x: x != "")
    sides = sides.withColumn("_at", F.explode(F.concat(F.array(F.lit("")), F.when(F.col("_anywhere"), F.array(F.lit("*"))).otherwise(starts))))
    near = (F.col("_place") == "") | F.col("_anywhere") | keys_match("_own", "_place") | keys_match("_town", "_place")
    hits = targets.join(sides, (F.col("_street") == F.col("_key")) & (F.col("_block") == F.col("_at")) & near & prepared_covers(F.col("_n"), F.col("_house"), F.col("_rule")))
    return hits.groupBy("address_id").agg(F.min("rule_id").alias("rule_id"))


def search_result(found: DataFrame, rules: DataFrame, schools: DataFrame, decrees: DataFrame) -> DataFrame:
    """What a search shows: school, rule, street and decree, a dash for what is missing."""
    dash = lambda c: F.coalesce(c, F.lit("—"))
    r = rules.select(F.col("id").alias("_rule"), "school_id", "decree_id", "street", "house_rule_raw")
    s = schools.select(F.col("id").alias("_school"), F.col("name").alias("school_name"), F.col("address").alias("school_address"))
    d = decrees.select(F.col("id").alias("_decree"), F.col("number"), F.col("date"))
    out = found.join(r, F.col("rule_id") == F.col("_rule")).join(s, F.col("school_id") == F.col("_school"), "left").join(d, F.col("decree_id") == F.col("_decree"), "left")
    return out.select("address_id", "rule_id", dash(F.col("school_name")).alias("school_name"), "school_address", "house_rule_raw", "street", dash(F.col("number")).alias("decree_number"), dash(F.col("date")).alias("decree_date"))


def search_status(addresses: DataFrame, found: DataFrame) -> DataFrame:
    """address_id with incomplete (no street or house), not_found or found, and the message for the first two."""
    complete = given("street") & given("house")
    out = addresses.select("address_id", "street", "house").join(found.select("address_id", "rule_id"), "address_id", "left")
    status = F.when(~complete, "incomplete").when(F.col("rule_id").isNull(), "not_found").otherwise("found")
    return out.select("address_id", status.alias("status"), F.when(~complete, P.INCOMPLETE).alias("message"))


def search_text(texts: DataFrame, rules: DataFrame, schools: DataFrame, municipalities: DataFrame, cleaned: DataFrame | None = None) -> DataFrame:
    """address_id, city, street, house, rule_id of free addresses (address_id, address).

    ``cleaned`` (address, city, street, house) holds a gazetteer's readings; where it has none, the local parser decides.
    """
    out = texts.withColumn("_own", parse_address("address"))
    if cleaned is not None:
        given_parts = cleaned.select(F.col("address").alias("_address"), F.struct("city", "street", "house").alias("_given"))
        out = out.join(given_parts, F.col("address") == F.col("_address"), "left").withColumn("_own", F.coalesce("_given", "_own"))
    # written once: both sides of the join below need the parts, and reading an address is costly
    parts = cut_lineage(out.select("address_id", "_own.*"))
    whole = parts.where(given("street") & given("house")).select("address_id", F.col("city").alias("locality"), "street", "house")
    return parts.join(find_school(whole, rules, schools, municipalities), "address_id", "left")


def check_address(lines: DataFrame, rules: DataFrame, schools: DataFrame, municipalities: DataFrame) -> DataFrame:
    """address_id and rule_id of lines ``city, street, house``; lines of fewer parts are left out."""
    parts = F.transform(F.split("line", ","), strip)
    rows = lines.select("address_id", parts.alias("p")).where(F.size("p") >= 3).select("address_id", F.col("p")[0].alias("locality"), F.col("p")[1].alias("street"), F.col("p")[2].alias("house"))
    return rows.join(find_school(rows, rules, schools, municipalities), "address_id", "left").select("address_id", "rule_id")


def locality_join(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """Pairs (left_id, right_id) of localities that match.

    Keys match if they share a prefix as long as the longer one less two letters, and four at least. So
    each key stands under its three longest prefixes, and a pair meets under the one of just that length,
    once; keys below four letters match themselves only.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        key = df.select(F.col("id").alias(f"{p}_id"), locality_key(name).alias(f"_{p}"))
        size = F.length(f"_{p}")
        starts = F.transform(F.array(size - 2, size - 1, size), lambda n: F.substring(F.col(f"_{p}"), F.lit(1), F.greatest(n, F.lit(4))))
        return key.where(size > 0).select("*", F.explode(F.array_distinct(starts)).alias(f"_{p}_start"))

    least = F.greatest(F.lit(4), F.length("_left") - 2, F.length("_right") - 2)
    short = F.least(F.length("_left"), F.length("_right")) < 4
    once = short | (F.length("_left_start") == least)
    return side(left, "left").join(side(right, "right"), (F.col("_left_start") == F.col("_right_start")) & once & keys_match("_left", "_right")).select("left_id", "right_id")
