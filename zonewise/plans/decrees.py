"""Whole decrees to raw rules: each document goes the way that its tables, or else its classification, call for."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.metadata import decree_metadata
from ..functions.replies import parse_decree, parse_territory, prompt
from ..operators import ingest, tables
from ..operators.ingest import bad_replies
from ..operators.rows import exploded
from ..runtime import cut_lineage
from ..sources.services import ask

RULE = ["locality", "street", "house_rule_raw", "parity", "rule_type", "house_from", "house_to", "house_number", "house_numbers", "exceptions", "comment"]
MULTI, TWO = tables.MULTI, tables.TWO
#: Fixed value: the question about a chunk of text, and its longest text.
QUESTION, LONGEST = "Разбери текст:\n{text}\nВерни JSON.", 4000


class Strategy(NamedTuple):
    """How a kind of document is told from its raw tables (doc_id and one flag column of the strategy's name; None: by the
    classifier only), and how its rules are read from raw tables and territory replies."""

    detect: Callable[[DataFrame], DataFrame] | None
    rules: Callable[[DataFrame, DataFrame], DataFrame]


#: Strategies by name; those that come first are tried first. ``register`` adds one.
STRATEGIES: dict[str, Strategy] = {}


def register(name: str, detect: Callable[[DataFrame], DataFrame] | None, rules: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    STRATEGIES[name] = Strategy(detect, rules)



def _null(kind: str = "string") -> F.Column:
    return F.lit(None).cast(kind)


def strategies(texts: DataFrame, raw: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id and strategy; classes (doc_id, document_type) is only asked where tables don't tell."""
    flags, names = texts.select("doc_id").distinct().join(classes.select("doc_id", "document_type"), "doc_id", "left"), {}
    for k, (name, strategy) in enumerate(STRATEGIES.items()):
        names[f"_is_{k}"] = name
        if strategy.detect is None:
            flags = flags.withColumn(f"_is_{k}", F.lit(False))
        else:
            found = strategy.detect(by_tables(raw))
            (flag,) = (c for c in found.columns if c != "doc_id")
            flags = flags.join(found.withColumnRenamed(flag, f"_is_{k}"), "doc_id", "left")
    return tables.choose_strategy(flags.fillna(False, list(names)), names)


def multi_column(raw: DataFrame) -> DataFrame:
    rules = tables.house_rules(tables.multi_column_rows(raw))
    place = F.struct("page", "table_ix", "row_ix", "alias_ix", "rule_ix")
    return rules.select(
        "doc_id", place.alias("ord"), "school_name", F.lit("").alias("school_address"), F.lit("").alias("locality"), "street", "house_rule_raw", F.lit("all").alias("parity"), "rule_type", "house_from", "house_to", "house_number",
        F.when(F.col("rule_type") == "exact_list", F.col("house_number")).alias("house_numbers"), _null().alias("exceptions"), F.lit("").alias("comment"),
    )


def by_tables(raw: DataFrame) -> DataFrame:
    """The rows by which a document's shape is told: of the first engine's own setting."""
    return raw.where("engine NOT IN ('second', 'columns') AND setting = 0")


def school_territories(raw: DataFrame) -> DataFrame:
    """doc_id, school_name, territory_text and first of two-column tables, by the better of the engines that read them.

    Documents whose tables give no school are read by the columns of their pages (rows of engine "columns").
    """
    records = tables.best_per_page(tables.process_tables(raw.where("engine <> 'columns'")).withColumn("doc_id", F.concat_ws("\u0001", "engine", "doc_id")))
    found = tables.meaningful(tables.dedupe_schools(tables.stitch_names(records)))
    found = found.select(F.substring_index("doc_id", "\u0001", 1).alias("engine"), F.substring_index("doc_id", "\u0001", -1).alias("doc_id"), "school_name", "territory_text", "first")
    count = lambda second: F.count_if((F.col("engine") == "second") == F.lit(second))
    chosen = tables.engine_choice(found.groupBy("doc_id").agg(count(False).alias("first"), count(True).alias("second"))).select("doc_id", (F.col("engine") == "second").alias("_second"))
    found = found.join(chosen, "doc_id").where((F.col("engine") == "second") == F.col("_second")).select("doc_id", "school_name", "territory_text", "first")
    columns = raw.where("engine = 'columns'").select("doc_id", "page", F.get("cells", F.lit(0)).alias("left_text"), F.get("cells", F.lit(1)).alias("right_text"))
    columns = tables.zip_columns(columns).join(chosen.select("doc_id"), "doc_id", "left_anti")
    return found.unionByName(columns.select("doc_id", "school_name", "territory_text", F.struct("page", F.lit(0).alias("table_ix"), "record_ix").alias("first")))


def two_column(raw: DataFrame, territory_replies: DataFrame) -> DataFrame:
    """Rules of a model about each school's territory (doc_id, school_name, content), and what the text has beyond them."""
    schools = school_territories(raw)
    keys = ["doc_id", "school_name"]
    model = exploded(schools.select(*keys).distinct().join(territory_replies, keys), parse_territory("content"), "ord", "r", *keys)
    model = model.select(*keys, "ord", "r.street", "r.house_rule_raw", F.struct("r.locality", "r.parity", "r.house_from", "r.house_to", "r.house_number", "r.comment").alias("more"))
    own = exploded(schools, T.territory_rules("territory_text"), "ord", "r", *keys)
    own = own.select(*keys, "ord", "r.street", "r.house_rule_raw", _null("struct<locality:string,parity:string,house_from:int,house_to:int,house_number:string,comment:string>").alias("more"))
    both = ingest.merge_fallback(model, own)
    place = F.struct(F.lit(0).alias("page"), F.lit(0).alias("table_ix"), F.when(F.col("origin") == "model", 0).otherwise(1).alias("row_ix"), F.lit(0).alias("alias_ix"), F.col("ord").alias("rule_ix"))
    return both.select(
        "doc_id", place.alias("ord"), "school_name", F.lit("").alias("school_address"), F.coalesce("more.locality", F.lit("")).alias("locality"), "street", "house_rule_raw", F.col("more.parity").alias("parity"), _null().alias("rule_type"),
        F.col("more.house_from").alias("house_from"), F.col("more.house_to").alias("house_to"), F.col("more.house_number").alias("house_number"), _null().alias("house_numbers"), _null().alias("exceptions"), F.coalesce("more.comment", F.lit("")).alias("comment"),
    )


def plain_text(replies: DataFrame) -> DataFrame:
    """Rules of a model's replies about chunks of whole texts."""
    rules = ingest.flatten_decree(replies)
    place = F.struct(F.col("chunk").alias("page"), F.lit(0).alias("table_ix"), F.col("school_ix").alias("row_ix"), F.lit(0).alias("alias_ix"), F.col("rule_ix").alias("rule_ix"))
    return rules.select("doc_id", place.alias("ord"), "school_name", "school_address", "locality", "street", "house_rule_raw", "parity", _null().alias("rule_type"), "house_from", "house_to", "house_number", _null().alias("house_numbers"), _null().alias("exceptions"), "comment")


def parse(texts: DataFrame, raw: DataFrame, replies: DataFrame, territory_replies: DataFrame, classes: DataFrame) -> dict[str, DataFrame]:
    """decrees (doc_id, number, date, municipality), rules, strategies and errors of all documents.

    texts: doc_id, text. A document whose tables give no rules falls back to the
    replies about its text. Branches see only the documents that go their way.
    """
    way = strategies(texts, raw, classes)
    own = lambda df, kind: df.join(way.where(F.col("strategy") == kind).select("doc_id"), "doc_id", "left_semi")
    structured = None
    for name, strategy in STRATEGIES.items():
        rules = strategy.rules(own(raw, name), territory_replies)
        structured = rules if structured is None else structured.unionByName(rules)
    rest = plain_text(replies.join(structured.select("doc_id").distinct(), "doc_id", "left_anti"))
    meta = texts.select("doc_id", decree_metadata("text").alias("m")).select("doc_id", F.col("m.number").alias("text_number"), F.col("m.date").alias("text_date"), F.col("m.municipality").alias("text_municipality"))
    said = ingest.merge_chunks(replies.select("doc_id", "chunk", parse_decree("content")["decree"].alias("d")).select("doc_id", "chunk", "d.*"))
    decrees = ingest.metadata_fill(meta.join(said, "doc_id", "left"))
    return {"decrees": decrees, "rules": structured.unionByName(rest), "strategies": way, "errors": bad_replies(replies)}


register(MULTI, tables.detect_multi_column, lambda raw, replies: multi_column(by_tables(raw)))
register(TWO, tables.detect_two_column, two_column)


def ask_texts(texts: DataFrame, client: Callable[[str], str | None], question: str = QUESTION, longest: int = LONGEST, **options) -> DataFrame:
    """doc_id, chunk, content and failed: a model's replies about the sections of texts (doc_id, text). Equal sections are asked once.

    The replies are written before they are returned, so that nothing is asked twice.
    """
    chunks = exploded(texts, T.split_sections("text"), "chunk", "section", "doc_id").select("doc_id", "chunk", prompt(question, "section", longest).alias("query"))
    answers = cut_lineage(ask(chunks, client, **options))
    return chunks.join(answers, "query").select("doc_id", "chunk", F.col("answer").alias("content"), "failed")


def text_rules(texts: DataFrame, client: Callable[[str], str | None], **options) -> dict[str, DataFrame]:
    """Texts to rules in one go: sections are asked with pauses and retries, each chunk's error is kept, and what could be read is merged.

    decrees (doc_id, number, date, municipality: the reply's, else the text's), rules and errors (doc_id, chunk, error, preview).
    """
    replies = ask_texts(texts, client, **options)
    read = replies.where("failed IS NULL").select("doc_id", "chunk", "content")
    meta = texts.select("doc_id", decree_metadata("text").alias("m")).select("doc_id", F.col("m.number").alias("text_number"), F.col("m.date").alias("text_date"), F.col("m.municipality").alias("text_municipality"))
    said = ingest.merge_chunks(read.select("doc_id", "chunk", parse_decree("content")["decree"].alias("d")).select("doc_id", "chunk", "d.*"))
    lost = replies.where("failed IS NOT NULL").select("doc_id", "chunk", F.concat(F.lit("not_asked: "), "failed").alias("error"), F.lit("").alias("preview"))
    return {"decrees": ingest.metadata_fill(meta.join(said, "doc_id", "left")), "rules": plain_text(read), "errors": bad_replies(read).unionByName(lost)}
