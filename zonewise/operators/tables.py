"""Raw table rows of decrees to school, street and house rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.houses import houses_to_rules
from .rows import exploded

ORDER = ("page", "table_ix", "row_ix")


def fill_forward(raw: DataFrame) -> DataFrame:
    """Rows of four-column tables with the school in force: the last one named before, over rows, tables and pages of a document.

    The window holds one document; documents are spread over tasks.
    """
    cells = F.transform(F.slice("cells", 1, 4), T.clean)
    rows = raw.where(F.size("cells") >= 4).withColumn("_c", cells).where(~T.is_header("_c"))
    named = F.when(T.is_school_or_prefix(F.col("_c")[1]), F.col("_c")[1])
    before = Window.partitionBy("doc_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("doc_id", *ORDER, F.last(named, ignorenulls=True).over(before).alias("school_name"), F.col("_c")[2].alias("street"), F.col("_c")[3].alias("houses"))


def multi_column_rows(raw: DataFrame) -> DataFrame:
    """One row per street name (aliases apart) with a school and house numbers."""
    rows = fill_forward(raw).where(F.col("school_name").isNotNull() & T.is_street_like("street") & T.has_digit("houses"))
    return exploded(rows, T.street_aliases("street"), "alias_ix", "name", "doc_id", *ORDER, "school_name", "houses").withColumnRenamed("name", "street")


def house_rules(rows: DataFrame) -> DataFrame:
    """Rules of (street, houses) rows: exact lists and ranges apart."""
    keep = [c for c in rows.columns if c != "houses"]
    return exploded(rows, houses_to_rules("houses"), "rule_ix", "r", *keep).select(*keep, "rule_ix", "r.*")


def nested_schools(rules: DataFrame) -> DataFrame:
    """doc_id, school_name, first place and the array of its rules in order. A group is one school of one document."""
    place = [*ORDER, "alias_ix", "rule_ix"]
    rule = F.struct(*place, "street", "house_rule_raw", "house_from", "house_to", "house_number", "rule_type")
    grouped = rules.groupBy("doc_id", "school_name").agg(F.sort_array(F.collect_list(rule)).alias("rules"))
    return grouped.withColumn("first", F.struct(*[F.col("rules")[0][p].alias(p) for p in ORDER]))


def detect_multi_column(raw: DataFrame, pages: int = 15, header_rows: int = 3, data_rows: int = 5, tables: int = 3) -> DataFrame:
    """doc_id and whether it has a four-column header table, or at least three tables of numbered school rows."""
    rows = raw.where((F.col("page") <= pages) & (F.col("row_ix") < data_rows))
    wide = F.max(F.when(F.col("row_ix") == 0, F.size("cells"))) >= 4
    seen = rows.groupBy("doc_id", "page", "table_ix").agg(wide.alias("wide"), F.bool_or((F.col("row_ix") < header_rows) & T.is_header("cells")).alias("header"), F.bool_or(T.is_numbered_school_row(F.transform(F.slice("cells", 1, 4), T.clean))).alias("data"))
    seen = seen.where("wide").groupBy("doc_id").agg(F.bool_or("header").alias("h"), F.count_if(F.col("data")).alias("n"))
    return raw.select("doc_id").distinct().join(seen, "doc_id", "left").select("doc_id", F.coalesce(F.col("h") | (F.col("n") >= tables), F.lit(False)).alias("multi_column"))


def detect_two_column(raw: DataFrame, pages: int = 10) -> DataFrame:
    """doc_id and whether a two-cell header row opens any of its tables."""
    first = raw.where((F.col("page") <= pages) & (F.col("row_ix") == 0))
    seen = first.groupBy("doc_id").agg(F.bool_or((F.size("cells") == 2) & T.is_two_column_header("cells")).alias("two_column"))
    return raw.select("doc_id").distinct().join(seen, "doc_id", "left").select("doc_id", F.coalesce("two_column", F.lit(False)).alias("two_column"))


MULTI, TWO = "multi_column_street_house", "two_column_school_territories"
#: Flag columns that tell a document's parser, in the order in which they count.
BY_TABLES = {"multi_column": MULTI, "two_column": TWO}


def choose_strategy(flags: DataFrame, by_tables: dict[str, str] | None = None, default: str = MULTI) -> DataFrame:
    """doc_id and its parser: table shape first, else the classifier's word if it names one, else the default."""
    by_tables, pick = by_tables or BY_TABLES, F
    for flag, name in by_tables.items():
        pick = pick.when(F.col(flag), name)
    pick = pick.when(F.col("document_type").isin(*by_tables.values()), F.col("document_type")).otherwise(default)
    return flags.select("doc_id", pick.alias("strategy"))


def process_tables(raw: DataFrame) -> DataFrame:
    """School and territory records of two-column tables; rows without a school go on with the record before.

    Each row depends on the record so far, so a table's rows are folded in order, as one array, in the JVM.
    """
    keys = ["doc_id", "engine", "setting", "page", "table_ix"]
    school_at = F.array_position(F.transform("cells", T.is_school_cell), F.lit(True)).cast("int") - 1
    others = F.filter("cells", lambda c, i: (i != F.col("_at")) & T.is_territory(c))
    rows = raw.withColumn("_at", school_at).select(*keys, "row_ix", F.when(F.col("_at") >= 0, T.clean(F.get("cells", F.col("_at")))).alias("school"), T.merge_cells(others).alias("addition"))
    rows = rows.where("addition <> ''").withColumn("quoted", F.lower(F.regexp_extract(F.coalesce("school", F.lit("")), P.SCHOOL_NAME, 0)))
    made = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row_ix", "school", "quoted", "addition"))).alias("rows"))
    null = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<struct<school_name:string,territory_text:string>>").alias("done"), null.alias("name"), null.alias("quoted"), null.alias("text"))

    def closed(acc: F.Column) -> F.Column:
        return F.when(acc["name"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["name"].alias("school_name"), acc["text"].alias("territory_text")))))

    def step(acc: F.Column, x: F.Column) -> F.Column:
        same = F.contains(acc["name"], x["school"]) | F.contains(x["school"], acc["name"]) | ((acc["quoted"] != "") & (acc["quoted"] == x["quoted"]))
        opens = x["school"].isNotNull() & ~F.coalesce(same, F.lit(False))
        adds = F.when(F.contains(acc["text"], x["addition"]), acc["text"]).otherwise(T.strip(F.concat(acc["text"], F.lit(" "), x["addition"])))
        pick = lambda new, old, name: F.when(opens, new).otherwise(old).alias(name)
        return F.struct(pick(closed(acc), acc["done"], "done"), pick(x["school"], acc["name"], "name"), pick(x["quoted"], acc["quoted"], "quoted"), pick(x["addition"], adds, "text"))

    return exploded(made, F.aggregate("rows", start, step, closed), "record_ix", "r", *keys).select(*keys, "record_ix", "r.*")


def extraction_score(records: DataFrame) -> DataFrame:
    """Length of the territories of named schools, by page and setting."""
    score = F.sum(F.when(T.names_a_school("school_name"), F.length("territory_text")).otherwise(0))
    return records.groupBy("doc_id", "page", "setting").agg(score.alias("score"))


def best_per_page(records: DataFrame) -> DataFrame:
    """Records of each page's best setting: the highest score, the lowest setting among equals; none where all score 0."""
    best = extraction_score(records).where("score > 0").groupBy("doc_id", "page").agg(F.max_by("setting", F.struct("score", -F.col("setting"))).alias("setting"))
    return records.join(best, ["doc_id", "page", "setting"], "left_semi")


def stitch_names(records: DataFrame) -> DataFrame:
    """Records whose name goes on from an unclosed one before are joined to it, in chains.

    A chain ends with the first closed name, so whether a record joins is told by its own name and the one just before.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "table_ix", "record_ix", "school_name", "territory_text")
    goes_on = F.col("school_name").rlike(P.NAME_CONTINUATION) & ~F.contains(F.lag("school_name").over(order), F.lit("»"))
    rows = records.withColumns({"_starts": F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1), "_at": F.row_number().over(order)})
    rows = rows.withColumn("_chain", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    chains = rows.groupBy("doc_id", "_chain").agg(F.sort_array(F.collect_list(F.struct("_at", "page", "table_ix", "record_ix", "school_name", "territory_text"))).alias("r"))
    first = F.col("r")[0]
    texts = F.filter(F.transform("r", lambda x: x["territory_text"]), lambda t: t != "")
    joined = lambda c: T.clean(F.array_join(c, " "))
    name = F.when(F.size("r") == 1, first["school_name"]).otherwise(joined(F.transform("r", lambda x: x["school_name"])))
    text = F.when(F.size("r") == 1, first["territory_text"]).when(F.size(texts) > 1, joined(texts)).otherwise(F.coalesce(F.get(texts, F.lit(0)), F.lit("")))
    return chains.select("doc_id", first["page"].alias("page"), first["table_ix"].alias("table_ix"), first["record_ix"].alias("record_ix"), name.alias("school_name"), text.alias("territory_text"))


def dedupe_schools(records: DataFrame) -> DataFrame:
    """One record per school of a document, that with the longest territory (the first among equals)."""
    place = F.struct("page", "table_ix", "record_ix")
    longest = F.max_by("territory_text", F.struct(F.length("territory_text"), -F.col("page"), -F.col("table_ix"), -F.col("record_ix")))
    return records.groupBy("doc_id", "school_name").agg(longest.alias("territory_text"), F.min(place).alias("first"))


def meaningful(records: DataFrame) -> DataFrame:
    return records.where(T.is_meaningful("school_name", "territory_text"))


def engine_choice(counts: DataFrame, enough: int = 3) -> DataFrame:
    """doc_id and engine of (doc_id, first, second) meaningful counts: the second only if the first found too few and fewer."""
    return counts.select("doc_id", F.when((F.col("first") < enough) & (F.col("second") > F.col("first")), "second").otherwise("first").alias("engine"))


def zip_columns(pages: DataFrame) -> DataFrame:
    """Schools of a page's left column with territories of its right one, by position; the first page is a cover."""
    left = F.filter(F.split(T.clean("left_text"), P.SCHOOL_SPLIT), lambda p: p.rlike(P.SCHOOL_NAME))
    right = F.filter(F.transform(F.split(T.clean("right_text"), P.TERRITORY_SPLIT), T.clean), lambda p: F.length(p) > 20)
    rows = pages.where("page > 1").select("doc_id", "page", F.transform(left, T.clean).alias("l"), right.alias("r"))
    size = F.least(F.size("l"), F.size("r"))
    pairs = F.arrays_zip(F.slice("l", F.lit(1), size), F.slice("r", F.lit(1), size))
    return exploded(rows, pairs, "record_ix", "x", "doc_id", "page").select("doc_id", "page", "record_ix", F.col("x.0").alias("school_name"), F.col("x.1").alias("territory_text"))

