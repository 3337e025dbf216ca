"""Inputs of the registered queries: tables as services and files would give them, made from whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.views import Views


def text(*parts) -> F.Column:
    return F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])


def by(key: str, *values) -> F.Column:
    """values in turn, by key."""
    out = None
    for k, v in enumerate(values):
        v = v if isinstance(v, F.Column) else F.lit(v)
        hit = F.col(key) % len(values) == k
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out


def s(name: str) -> F.Column:
    return F.col(name).cast("string")


def records(v: Views) -> DataFrame:
    """School and territory records of several extraction settings: lineitem rows."""
    line = v.table("lineitem")
    name = F.when(F.col("l_returnflag") == "R", text("без имени ", s("l_linenumber"))).otherwise(text("учреждение № ", (F.col("l_suppkey") % 7).cast("string")))
    return line.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 4).cast("int").alias("setting"), (F.col("l_partkey") % 5).cast("int").alias("table_ix"), F.col("l_suppkey").cast("int").alias("record_ix"), name.alias("school_name"), F.repeat(F.lit("ул. "), F.col("l_quantity").cast("int")).alias("territory_text")).distinct()


def raw_tables(v: Views) -> DataFrame:
    """Four-column tables with headers, schools named once and then left out, aliases and house cells."""
    p = v.table("part")
    school = F.when(F.col("p_partkey") % 4 == 1, text("МАОУ «СОШ № ", s("p_size"), "»"))
    street = by("p_partkey", F.col("p_name"), text(F.initcap("p_name"), " (", F.upper("p_brand"), ")"), text(F.col("p_name"), " (", F.upper("p_name"), ")"))
    houses = text(s("p_size"), ", ", (F.col("p_size") + 2).cast("string"), "; ", s("p_size"), "-", (F.col("p_size") + 9).cast("string"))
    cells = F.when(F.col("p_partkey") % 10 == 0, F.array(F.lit("№ п/п"), F.lit("Наименование"), F.lit("Улица"), F.lit("Номер дома"))).otherwise(F.array(s("p_partkey"), school, street, F.when(F.col("p_partkey") % 11 == 3, "—").otherwise(houses)))
    return p.select((F.col("p_partkey") % 40 + F.shiftright("p_partkey", 9)).cast("string").alias("doc_id"), F.lit("lines").alias("engine"), F.lit(0).alias("setting"), F.shiftright("p_partkey", 8).cast("int").alias("page"), (F.shiftright("p_partkey", 6) % 4).cast("int").alias("table_ix"), (F.col("p_partkey") % 10 + F.shiftright("p_partkey", 5) % 2 * 10).cast("int").alias("row_ix"), F.col("p_partkey").alias("id"), cells.alias("cells"))


def two_column_tables(v: Views) -> DataFrame:
    """Two-column tables in which territories go on over rows without a school."""
    p = v.table("part")
    name = by("p_partkey", text("МАОУ «Школа № ", s("p_size"), "»"), F.lit(None).cast("string"), text("«Школа № ", s("p_size"), "»"), F.lit(""))
    return p.select((F.col("p_partkey") % 50).cast("string").alias("doc_id"), F.lit("lines").alias("engine"), F.lit(0).alias("setting"), F.lit(1).alias("page"), (F.col("p_partkey") % 3).cast("int").alias("table_ix"), F.col("p_partkey").cast("int").alias("row_ix"), F.array(name, text("ул. ", F.col("p_name"), ", ", s("p_size"))).alias("cells"))


def territories(v: Views) -> DataFrame:
    """doc_id, school_name, and the territory text of a school: three streets with houses."""
    p = v.table("part")
    body = text("мкр. Балашиха-", s("p_size"), ": ул. Ивана ", F.translate(F.initcap("p_name"), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "абцдефгхийклмнопярстуввхуаАБЦДЕФГХИЙКЛМНОПЯРСТУВВХУА"), ", ", s("p_size"), ", ", (F.col("p_size") + 2).cast("string"), "; проспект Мира; переулок Школьный (кроме д.", s("p_size"), ")")
    return p.select(s("p_partkey").alias("doc_id"), F.lit("МАОУ «СОШ № 1»").alias("school_name"), body.alias("territory_text"))


def decree_texts(v: Views) -> DataFrame:
    o = v.spread("orders", "o_orderkey", "o_custkey", "o_orderdate")
    number, day = text(s("o_custkey"), "-п"), F.date_format("o_orderdate", "d.M.yyyy")
    head = by(
        "o_orderkey",
        text("ПОСТАНОВЛЕНИЕ от ", day, " № ", number, " Администрация города Перми"),
        text("В соответствии с Федеральным законом от 29.12.2012 № 273-ФЗ ", F.repeat(F.lit("текст "), 60), "постановление от ", F.date_format("o_orderdate", "d"), " апреля ", F.date_format("o_orderdate", "yyyy"), " года № ", number, " Городского округа Балашиха"),
        text("без даты и номера, муниципального района Пушкинский"),
    )
    return o.select(s("o_orderkey").alias("doc_id"), head.alias("text"))


def replies(v: Views) -> DataFrame:
    """Model replies with fences, spare commas, loose types, and some that are no JSON."""
    o = v.spread("orders", "o_orderkey", "o_custkey")
    body = text('{"decree": {"number": "', s("o_custkey"), '", "date": null, "extra": 1}, "schools": [{"name": " СОШ № ', s("o_custkey"), ' ", "address": null, "rules": [{"street": "Мира", "house_rule_raw": null, "parity": "', by("o_orderkey", "even", "weird", "all"), '", "house_from": "', s("o_custkey"), '", "house_to": ', by("o_orderkey", '"abc"', "17", "null"), ', "house_number": ', by("o_orderkey", '["1", "2а", ""]', '"5"', "null"), ", },]}, ]}")
    whole = by("o_orderkey", text("```json\n", body, "\n```"), text("Вот ответ: ", body, " Готово."), body, body, "ответа нет")
    return o.select(s("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("int").alias("chunk"), whole.alias("content"))


def raw_rules(v: Views) -> DataFrame:
    """Rules as a parser gives them: wording only, some of them empty."""
    keep = v.rules.select("id", "school_id", "decree_id", "locality", F.when(F.col("id") % 17 == 0, "  ").otherwise(F.col("street")).alias("street"), F.when(F.col("id") % 13 == 0, "  ").otherwise(F.col("house_rule_raw")).alias("house_rule_raw"), F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise("unknown").alias("parity"))
    null = F.lit(None)
    return keep.select("*", null.cast("string").alias("rule_type"), null.cast("int").alias("house_from"), null.cast("int").alias("house_to"), null.cast("string").alias("house_number"), null.cast("string").alias("house_numbers"), null.cast("string").alias("exceptions"))


def gazetteer(v: Views) -> DataFrame:
    """Answers for two of three streets; some under another name, some without a street."""
    names = v.table("part").select("p_name").distinct()
    n = F.length("p_name")
    return names.where(n % 3 != 0).select(F.col("p_name").alias("query"), text("г X, ", F.col("p_name")).alias("value"), F.when(n % 3 == 1, F.when(n % 2 == 0, text("ул ", F.col("p_name"))).otherwise(text(F.col("p_name"), " новая"))).alias("street"))
