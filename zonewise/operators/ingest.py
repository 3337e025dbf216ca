"""From parsed decrees to stored rows: merging replies, building rules, checking streets, saving."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import houses as H
from ..functions import patterns as P
from ..functions import text as T
from ..functions.replies import error_of, json_repair, parse_decree
from ..runtime import cut_lineage, ship
from .rows import exploded


def merge_fallback(model_rules: DataFrame, text_rules: DataFrame) -> DataFrame:
    """A school's rules (doc_id, school_name, ord, street, house_rule_raw) from a model, and from the text where a street is missing.

    All model rules stay; of the text's rules the first per missing street is added.
    """
    keyed = lambda df: df.withColumn("_key", T.street_key("street"))
    group = ["doc_id", "school_name", "_key"]
    cols = [c for c in model_rules.columns if c not in ("doc_id", "school_name")]
    first = keyed(text_rules).where("_key <> ''").groupBy(*group).agg(F.min_by(F.struct(*cols), "ord").alias("r"))
    missing = first.join(keyed(model_rules).select(*group).distinct(), group, "left_anti").select("doc_id", "school_name", "r.*")
    return model_rules.withColumn("origin", F.lit("model")).unionByName(missing.withColumn("origin", F.lit("text")))


def merge_chunks(replies: DataFrame) -> DataFrame:
    """doc_id, number, date, municipality: the first non-empty one over a document's chunks (doc_id, chunk, number, date, municipality)."""
    first = lambda c: F.coalesce(F.min_by(F.nullif(c, F.lit("")), F.when(T.given(c), F.col("chunk"))), F.lit("")).alias(c)
    return replies.groupBy("doc_id").agg(first("number"), first("date"), first("municipality"))


def metadata_fill(decrees: DataFrame) -> DataFrame:
    """Fields of the reply (number, ...), and of the text (text_number, ...) where those are empty."""
    pick = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.nullif(f"text_{c}", F.lit("")), F.lit("")).alias(c)
    return decrees.select("doc_id", pick("number"), pick("date"), pick("municipality"))


def flatten_decree(replies: DataFrame) -> DataFrame:
    """One row per rule of parsed replies (doc_id, chunk, content); unreadable replies give none."""
    parsed = replies.select("doc_id", "chunk", parse_decree("content").alias("d"))
    schools = exploded(parsed, "d.schools", "school_ix", "s", "doc_id", "chunk")
    rules = exploded(schools, "s.rules", "rule_ix", "r", "doc_id", "chunk", "school_ix", F.col("s.name").alias("school_name"), F.col("s.address").alias("school_address"))
    return rules.select("doc_id", "chunk", "school_ix", "school_name", "school_address", "rule_ix", "r.*")


#: Characters shown on either side of the place where a reply can't be read.
AROUND = 300


def json_error(text: str | None) -> str:
    """What a JSON parser says of a text, where, and what stands round it."""
    try:
        json.loads(text or "")
    except json.JSONDecodeError as e:
        return f"bad_json: {e.msg} at {e.pos}: {e.doc[max(0, e.pos - AROUND) : e.pos + AROUND]}"
    return f"bad_json: {(text or '')[: 2 * AROUND]}"  # the JVM's parser is the stricter one, on equal keys


def bad_replies(replies: DataFrame) -> DataFrame:
    """doc_id, chunk, error and preview of the replies (doc_id, chunk, content) that can't be used; only these reach Python."""
    ship(replies.sparkSession)
    bad = replies.select("doc_id", "chunk", error_of("content").alias("error"), json_repair("content").alias("json"), F.substring("content", 1, 500).alias("preview")).where("error IS NOT NULL")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["error"] = [e if e == "no_json" else json_error(j) for e, j in zip(frame["error"], frame["json"], strict=True)]
            yield frame.drop(columns="json")

    kinds = dict(replies.dtypes)
    return bad.mapInPandas(run, f"doc_id {kinds['doc_id']}, chunk {kinds['chunk']}, error string, preview string")


def rule_fields() -> Column:
    return H.normalize_rule("house_rule_raw", "parity", "rule_type", "house_from", "house_to", "house_numbers", "exceptions")


def build_rules(raw: DataFrame) -> DataFrame:
    """Raw rules with kind, bounds and lists from their wording; those that say nothing are dropped; streets lose their short prefixes."""
    rows = raw.withColumn("_n", rule_fields()).where(~H.is_droppable("street", "house_rule_raw", "house_number", F.col("_n.house_from"), F.col("_n.house_to"), F.col("_n.rule_type")))
    street = T.clean_street(T.strip("street"))
    new = {
        "street": street, "normalized_street": T.normalize_street(street), "house_rule_raw": T.strip(T.blank("house_rule_raw")),
        "rule_type": H.normalize_rule_type("_n.rule_type"), "parity": H.normalize_parity("_n.parity"), "house_from": F.col("_n.house_from"), "house_to": F.col("_n.house_to"),
        "house_number": F.nullif(T.strip("house_number"), F.lit("")), "house_numbers": F.nullif("_n.house_numbers", F.lit("")), "exceptions": F.nullif("_n.exceptions", F.lit("")),
    }
    return rows.withColumns(new).drop("_n")


def street_query(locality: Column | str = "locality", street: Column | str = "street") -> Column:
    place = F.when(T.given(locality), T._c(locality))
    return T.strip(F.concat_ws(", ", place, T._c(street)))


def verify_streets(rules: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """rules with validation_status, dadata_value, dadata_confidence and validation_comment.

    Queries are made distinct before the gazetteer is joined, so each is answered
    once. ``failed`` answers (a column of that name) leave the street unchecked.
    """
    failed = F.col("failed") if "failed" in gazetteer.columns else F.lit(None).cast("string")
    known = gazetteer.select(F.col("query").alias("_q"), F.struct(F.col("value").alias("value"), F.col("street").alias("street"), failed.alias("failed")).alias("_g"))
    rows = rules.withColumn("_query", street_query())
    answers = rows.select("_query").distinct().join(known, F.col("_query") == F.col("_q"), "left").select(F.col("_query").alias("_asked"), "_g")
    rows = rows.join(answers, F.col("_query").eqNullSafe(F.col("_asked")), "left")
    same = T.normalize_street("street") == T.normalize_street("_g.street")
    skipped, none, no_street = F.col("_g.failed").isNotNull(), F.col("_g").isNull(), ~T.given("_g.street")
    pick = lambda *v: F.when(skipped, v[0]).when(none, v[1]).when(no_street, v[2]).when(same, v[3]).otherwise(v[4])
    null = F.lit(None).cast("string")
    out = rows.withColumns({
        "validation_status": pick(*[F.lit(x) for x in ("skipped", "needs_review", "needs_review", "verified", "needs_review")]),
        "dadata_confidence": pick(null, *[F.lit(x) for x in ("low", "low", "high", "medium")]),
        "dadata_value": pick(null, null, *[F.col("_g.value")] * 3),
        "validation_comment": pick(F.concat(F.lit(P.GAZETTEER_DOWN), F.col("_g.failed")), F.lit(P.NO_STREET_FOUND), F.lit(P.NO_STREET_GIVEN), F.lit(P.STREET_CONFIRMED), F.concat(F.lit(P.STREET_DIFFERS), F.col("_g.street"))),
    })
    return out.drop("_query", "_asked", "_g")


def with_ids(df: DataFrame, start: int, *order: str) -> DataFrame:
    """df with consecutive ids above ``start`` in the given order.

    Rows are range-partitioned and numbered within partitions; only one count per
    partition is gathered, so no task sees all rows. The partitioned rows are
    written once: a second evaluation could deal them out differently.
    """
    rows = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return rows.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn("id", (F.lit(start) + F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_p", "_at", "_before")


def new_schools(wanted: DataFrame, schools: DataFrame) -> DataFrame:
    """(municipality_id, name, address) of wanted schools that aren't stored; the first address given counts, if it is one."""
    first = wanted.where(T.strip(T.blank("name")) != "").withColumn("name", T.strip("name")).groupBy("municipality_id", "name").agg(F.min_by("address", "ord").alias("address"))
    known = schools.select(F.col("municipality_id").alias("_m"), F.col("name").alias("_n"))
    fresh = first.join(known, F.col("municipality_id").eqNullSafe(F.col("_m")) & (F.col("name") == F.col("_n")), "left_anti")
    return fresh.withColumn("address", T.sanitize_address("address"))


def decree_rows(decrees: DataFrame) -> DataFrame:
    """number, date and municipality with the texts that stand for missing ones."""
    fill = lambda c, text: F.coalesce(F.nullif(c, F.lit("")), F.lit(text)).alias(c)
    return decrees.select("doc_id", fill("number", P.NO_NUMBER), fill("date", P.NO_DATE), fill("municipality", P.NO_MUNICIPALITY))


def save_decrees(decrees: DataFrame, rules: DataFrame, stored: dict[str, DataFrame], gazetteer: DataFrame) -> dict[str, DataFrame]:
    """Rows to append to each table, and a summary by document.

    decrees: doc_id, number, date, municipality. rules: doc_id, ord, school_name,
    school_address and the raw rule. Towns and schools are created where they are
    missing; every decree is new, also when it is saved again.
    """
    top = {k: df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] for k, df in stored.items()}
    wanted = decree_rows(decrees)
    towns = wanted.select(F.col("municipality").alias("name")).distinct().join(stored["municipalities"].select("name"), "name", "left_anti")
    towns = with_ids(towns, top["municipalities"], "name").select("id", "name", F.lit(None).cast("string").alias("region"))
    all_towns = stored["municipalities"].unionByName(towns).groupBy(F.col("name").alias("municipality")).agg(F.min("id").alias("municipality_id"))
    new_decrees = with_ids(wanted.join(all_towns, "municipality"), top["decrees"], "doc_id").withColumn("file_path", F.lit(None).cast("string"))
    parsed = rules.join(new_decrees.select("doc_id", F.col("id").alias("decree_id"), "municipality_id"), "doc_id")
    fresh = new_schools(parsed.select("municipality_id", F.col("school_name").alias("name"), F.col("school_address").alias("address"), F.struct("doc_id", "ord").alias("ord")), stored["schools"])
    fresh = with_ids(fresh, top["schools"], "municipality_id", "name").select("id", "municipality_id", "name", "address")
    all_schools = stored["schools"].select("id", "municipality_id", "name").unionByName(fresh.select("id", "municipality_id", "name")).groupBy("municipality_id", "name").agg(F.min("id").alias("school_id"))
    built = build_rules(parsed.withColumn("name", T.strip("school_name"))).join(all_schools, ["municipality_id", "name"])
    checked = with_ids(verify_streets(built, gazetteer), top["address_rules"], "doc_id", "ord")
    created = fresh.join(decrees_of(parsed), ["municipality_id", "name"]).groupBy("doc_id").agg(F.count("*").alias("schools_count"))
    counts = checked.groupBy("doc_id").agg(F.count("*").alias("rules_count"))
    summary = new_decrees.select("doc_id", "municipality", F.col("id").alias("decree_id")).join(created, "doc_id", "left").join(counts, "doc_id", "left")
    return {
        "municipalities": towns,
        "decrees": new_decrees.select("id", "municipality_id", "number", "date", "file_path"),
        "schools": fresh,
        "address_rules": checked.select(*stored["address_rules"].columns),
        "summary": summary.select("doc_id", "municipality", "decree_id", F.coalesce("schools_count", F.lit(0)).alias("schools_count"), F.coalesce("rules_count", F.lit(0)).alias("rules_count")),
    }


def decrees_of(parsed: DataFrame) -> DataFrame:
    """The first document that names each school."""
    return parsed.groupBy("municipality_id", T.strip("school_name").alias("name")).agg(F.min("doc_id").alias("doc_id"))
