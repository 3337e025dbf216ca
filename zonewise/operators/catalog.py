"""Listings, counts and changes of stored rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.houses import normalize_int
from ..functions.text import normalize_street, strip


def admin_rules(rules: DataFrame, schools: DataFrame, decrees: DataFrame) -> DataFrame:
    """Rules with school and decree; rules without either are left out. Ordered by school and street."""
    s, d = schools.select(F.col("id").alias("_s"), F.col("name").alias("school_name")), decrees.select(F.col("id").alias("_d"), F.col("number").alias("decree_number"))
    out = rules.join(s, F.col("school_id") == F.col("_s")).join(d, F.col("decree_id") == F.col("_d"))
    return out.select("id", "school_name", "decree_number", "street", "house_rule_raw", "rule_type", "parity", "house_from", "house_to").orderBy("school_name", "street", "id")


def summary(municipalities: DataFrame, schools: DataFrame, rules: DataFrame) -> DataFrame:
    """Schools and rules of each town, zeros included. Rules are counted by school first, so nothing fans out."""
    per_school = rules.groupBy("school_id").agg(F.count("*").alias("n"))
    counted = schools.join(per_school, schools["id"] == per_school["school_id"], "left").groupBy("municipality_id").agg(F.count("*").alias("schools"), F.sum(F.coalesce("n", F.lit(0))).alias("rules"))
    out = municipalities.join(counted, municipalities["id"] == counted["municipality_id"], "left")
    return out.select("id", "name", F.coalesce("schools", F.lit(0)).alias("schools"), F.coalesce("rules", F.lit(0)).alias("rules")).orderBy("name")


def totals(schools: DataFrame, rules: DataFrame) -> DataFrame:
    one = schools.agg(F.count("*").alias("n")).select(F.lit("schools").alias("what"), "n")
    return one.unionByName(rules.agg(F.count("*").alias("n")).select(F.lit("rules").alias("what"), "n"))


def rules_by_street(rules: DataFrame, query: str) -> DataFrame:
    return rules.where(F.contains(normalize_street("street"), normalize_street(F.lit(query))))


def rules_by_school(rules: DataFrame, schools: DataFrame, query: str) -> DataFrame:
    """Rules of the schools whose name has the query in it, whatever the case; the filter runs before the join."""
    s = schools.where(F.contains(F.lower("name"), F.lower(F.lit(query)))).select(F.col("id").alias("_s"), F.col("name").alias("school_name"))
    return rules.join(s, F.col("school_id") == F.col("_s")).drop("_s")


def rule_by_id(rules: DataFrame, rule_id: int) -> DataFrame:
    return rules.where(F.col("id") == rule_id).limit(1)


def update_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """rules with the rows of changes (id and form fields as strings) in place: texts stripped, blank lists null,
    bounds null unless they are digits. Unknown ids change nothing; equal changes of one id count
    once, different ones are an error; normalized_street stays as it was."""
    null_if_blank = lambda c: F.nullif(strip(c), F.lit(""))
    fields = {
        "street": strip("street"), "house_rule_raw": strip("house_rule_raw"), "parity": strip("parity"), "rule_type": strip("rule_type"),
        "house_from": normalize_int("house_from"), "house_to": normalize_int("house_to"),
        "house_number": null_if_blank("house_number"), "house_numbers": null_if_blank("house_numbers"), "exceptions": null_if_blank("exceptions"),
    }
    new = changes.select(F.col("id").alias("_id"), F.struct(*[e.alias(k) for k, e in fields.items()]).alias("_new"))
    first, last = F.min("_new"), F.max("_new")
    new = new.groupBy("_id").agg(F.when(first.eqNullSafe(last), first).otherwise(F.raise_error(F.concat(F.lit("several changes of rule "), F.col("_id").cast("string")))).alias("_new"))
    out = rules.join(new, F.col("id") == F.col("_id"), "left")
    return out.select(*[F.when(F.col("_id").isNotNull(), F.col(f"_new.{c}")).otherwise(rules[c]).alias(c) if c in fields else rules[c] for c in rules.columns])


def delete_rules(rules: DataFrame, ids: DataFrame) -> DataFrame:
    return rules.join(ids.select("id"), "id", "left_anti")
