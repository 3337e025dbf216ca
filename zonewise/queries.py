"""Registered queries of the engine: each operator over its whole input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import address, metadata
from .functions import houses as H
from .functions import replies as R
from .functions import text as T
from .operators import catalog, ingest, search, tables, validate
from .operators.rows import exploded
from .plans import inputs as I
from .plans.inputs import by, s
from .plans.inputs import text as cat
from .sources.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
    return f


def hit(v: Views) -> DataFrame:
    return search.find_school(v.addresses, v.rules, v.schools, v.municipalities)


# Scans, routing and sinks


@query
def scan_rules(v):
    return v.rules


@query
def rule_by_id(v):
    return catalog.rule_by_id(v.rules, 7)


@query
def ocr_routing(v):
    native = F.length(T.strip("text")) >= 500
    return v.table("documents").select("doc_id", F.when(native, "native").otherwise("ocr").alias("route"), F.md5(F.when(native, F.col("text")).otherwise(cat("ocr ", s("doc_id")))).alias("text_md5"))


@query
def format_dispatch(v):
    path = cat("decree_", s("o_orderkey"), by("o_orderkey", ".docx", ".PDF", ".doc", ".txt"))
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return v.table("orders").select("o_orderkey", suffix.alias("suffix"), F.when(suffix.isin(".docx", ".pdf", ".doc"), F.substring(suffix, 2, 4)).otherwise("unsupported").alias("reader"))


@query
def best_extraction_per_page(v):
    return tables.best_per_page(I.records(v)).select("doc_id", "page", "setting", "table_ix", "record_ix", "school_name", "territory_text")


@query
def engine_choice(v):
    counts = v.table("orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("first"), F.count_if(F.col("o_orderstatus") == "O").alias("second"))
    return tables.engine_choice(counts.withColumnRenamed("o_custkey", "doc_id"))


@query
def zip_columns(v):
    left = cat("МАОУ «Школа № ", s("p_size"), "» ", "МБОУ «Лицей № ", s("p_partkey"), "»")
    right = cat("ул. ", F.col("p_name"), " дома 1, 2, 3, 4, 5, 6 ", "проспект ", F.col("p_name"), " дома 10, 12, 14, 16")
    return tables.zip_columns(v.table("part").select(s("p_partkey").alias("doc_id"), (F.col("p_partkey") % 3 + 1).cast("int").alias("page"), left.alias("left_text"), right.alias("right_text")))


def responses(v: Views) -> DataFrame:
    body = cat('{"IsErroredOnProcessing": ', by("o_orderkey", "false", "false", "true"), ', "ParsedResults": [{"ParsedText": "стр ', s("o_custkey"), '"}, {"ParsedText": ""}, {"ParsedText": "', F.col("o_orderstatus"), '"}]}')
    return v.table("orders").select("o_orderkey", body.alias("response"))


@query
def ocr_response_text(v):
    return responses(v).select("o_orderkey", R.ocr_text("response").alias("text"))


@query
def suggest_projection(v):
    city, settlement = by("c_custkey", F.col("c_mktsegment"), ""), cat("п ", s("c_nationkey"))
    return v.table("customer").select("c_custkey", F.coalesce(F.nullif(city, F.lit("")), settlement).alias("city"), F.col("c_name").alias("value"))


@query
def text_preview(v):
    return v.table("documents").select("doc_id", F.substring("text", 1, 8000).alias("preview"))


# Predicates


@query
def street_match(v):
    a = v.addresses.groupBy(T.normalize_street("street").alias("street")).agg(F.count("*").alias("n_addresses"))
    return a.join(v.rules.groupBy(T.normalize_street("street").alias("street")).agg(F.count("*").alias("n_rules")), "street")


def houses_of(v: Views) -> DataFrame:
    house = cat((F.col("l_orderkey") % 60 + 1).cast("string"), by("l_orderkey", "", "А", " а", "/2"))
    return v.table("lineitem").select("l_orderkey", "l_partkey", house.alias("house")).join(v.rules, F.col("l_partkey") == F.col("id"))


@query
def house_matches(v):
    return houses_of(v).select("l_orderkey", "id", "house", H.house_matches("house", *search.RULE_COLUMNS).alias("covered"))


def town_pairs(v: Views) -> DataFrame:
    a = v.municipalities.select(F.col("id").alias("i"), F.col("name").alias("a"))
    rows = v.table("customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 25).alias("j"))
    rows = rows.join(a, F.col("c_nationkey") == F.col("i")).join(v.municipalities.select("id", "name"), F.col("j") == F.col("id"))
    return rows.select("c_custkey", by("c_custkey", F.col("a"), cat("г. ", F.col("a")), cat(F.col("a"), "ы"), "").alias("a"), by("c_custkey", F.col("name"), F.col("a"), cat("Московская обл, г ", F.col("a"))).alias("b"))


@query
def locality_match(v):
    return town_pairs(v).select("c_custkey", T.locality_match("a", "b").alias("matches"))


@query
def locality_applicable(v):
    rows = v.rules.join(search.towns_of(v.schools, v.municipalities), F.col("school_id") == F.col("_school"))
    target = v.municipalities.select(F.col("id").alias("m"), F.col("name").alias("target"))
    rows = rows.join(target, F.col("id") % 25 == F.col("m")).withColumn("target", F.when(F.col("id") % 10 == 0, "").otherwise(F.col("target")))
    return rows.select("id", T.locality_applicable("target", "locality", "town").alias("applicable"))


@query
def header_rows(v):
    return I.raw_tables(v).select("id", T.is_header("cells").alias("header"))


@query
def street_like(v):
    x = by("p_partkey", F.col("p_name"), "ул.", " Район ", F.repeat("p_name", 12), "—", F.substring("p_name", 1, 1))
    return v.table("part").select("p_partkey", T.is_street_like(x).alias("street_like"))


def name_pairs(v: Views) -> DataFrame:
    a = cat("МАОУ «Школа № ", s("p_size"), "»")
    b = by("p_partkey", a, cat("«школа № ", s("p_size"), "» г. Пермь"), cat("«Школа № ", (F.col("p_size") + 1).cast("string"), "»"), cat("АНО «ШКОЛА № ", s("p_size"), "»"), "")
    return v.table("part").select("p_partkey", a.alias("a"), b.alias("b"))


@query
def same_school(v):
    return name_pairs(v).select("p_partkey", T.same_school("a", "b").alias("same"))


@query
def school_cells(v):
    x = by("p_partkey", cat("МАОУ «Школа № ", s("p_size"), "»"), cat("Наименование «Школа № ", s("p_size"), "»"), cat("Муниципальное учреждение ", F.col("p_name")), cat("Муниципальное ", F.repeat("p_name", 40)), F.col("p_name"))
    return v.table("part").select("p_partkey", T.is_school_cell(x).alias("school_cell"), T.is_school_or_prefix(x).alias("school_or_prefix"))


@query
def territory_cells(v):
    x = by("p_partkey", cat("ул. ", F.col("p_name")), cat("дом ", s("p_size")), F.col("p_name"), "д.", cat("СНТ ", F.col("p_name")))
    return v.table("part").select("p_partkey", T.is_territory(x).alias("territory"))


@query
def numbered_school_rows(v):
    x = F.array(by("p_partkey", s("p_partkey"), cat(s("p_size"), ".2"), F.col("p_brand")), by("p_size", cat("МАОУ «СОШ № ", s("p_size"), "»"), F.col("p_name")), F.col("p_name"), s("p_size"))
    return v.table("part").select("p_partkey", T.is_numbered_school_row(x).alias("numbered"))


@query
def meaningful_rows(v):
    return tables.meaningful(I.records(v))


@query
def droppable_rules(v):
    return v.rules.select("id", H.is_droppable(by("id", F.col("street"), " "), by("id", "", " ", F.col("house_rule_raw")), "house_number", "house_from", "house_to", F.when(F.col("id") % 5 == 0, "all").otherwise("range")).alias("droppable"))


@query
def transient_errors(v):
    x = by("event_id", cat("HTTP ", (F.col("user_id") % 7 + 498).cast("string")), "Read timed out", cat("bad JSON ", F.col("event_type")), "SSL: UNEXPECTED_EOF", "Connection reset by peer")
    return v.table("events").select("event_id", T.is_transient(x).alias("transient"))


@query
def rules_by_street(v):
    return catalog.rules_by_street(v.rules, "ул. red").select("id", "street", "house_rule_raw", "parity", "house_from", "house_to")


@query
def rules_by_school(v):
    return catalog.rules_by_school(v.rules, v.schools, "SUPPLIER#00000001").select("id", "school_name", "street", "parity")


# Scalar functions


@query
def normalize_street(v):
    x = by("p_partkey", F.col("p_name"), cat("ул. ", F.col("p_name")), cat("Проспект  ", F.initcap("p_name")), cat(F.col("p_name"), " улица"), cat("пр-кт ", F.col("p_name")), cat(" наб. ", F.upper("p_name")), cat(F.col("p_name"), " шоссе"), "")
    return v.table("part").select("p_partkey", T.normalize_street(x).alias("street"))


@query
def normalize_locality(v):
    return town_pairs(v).select("c_custkey", T.normalize_locality("a").alias("a"), T.normalize_locality("b").alias("b"))


@query
def house_number(v):
    return houses_of(v).select("l_orderkey", "id", H.house_number(F.when(F.col("l_orderkey") % 9 == 0, "нет").otherwise(F.col("house"))).alias("number"), H.normalize_house("house").alias("house"))


@query
def house_list(v):
    x = cat(s("p_size"), ", ", s("p_size"), ",, ", (F.col("p_size") + 1).cast("string"), " А, ")
    return v.table("part").select("p_partkey", F.array_join(H.number_list(x), "|").alias("houses"))


def free_addresses(v: Views) -> DataFrame:
    a = v.addresses
    place = by("address_id", cat("г ", F.col("locality")), F.col("locality"), cat("Московская обл, г ", F.col("locality")), cat("г ", F.col("locality"), ", мкр Южный"))
    return a.select("address_id", by("address_id", cat(place, ", ", F.col("street"), ", д ", F.col("house")), cat(place, ", ", F.regexp_replace("street", "^ул ", ""), " ", F.col("house")), cat(place, ", ", F.col("street"), ", ", F.col("house"))).alias("address"))


@query
def parse_address(v):
    return free_addresses(v).select("address_id", address.parse_address("address").alias("p")).select("address_id", "p.*")


@query
def clean_cell(v):
    x = cat(" ", F.col("p_name"), " ­ \n", F.col("p_brand"), "\t")
    return v.table("part").select("p_partkey", T.clean(x).alias("cell"))


@query
def merge_cells(v):
    x = F.array(F.col("p_name"), F.substring_index("p_name", " ", 1), F.lit(None).cast("string"), F.col("p_brand"), F.col("p_name"), F.lit(""))
    return v.table("part").select("p_partkey", T.merge_cells(x).alias("row"))


@query
def street_aliases(v):
    x = by("p_partkey", F.col("p_name"), cat(F.col("p_name"), " (", F.col("p_brand"), ")"), cat(F.col("p_name"), " (", F.upper("p_name"), ") "), "")
    return exploded(v.table("part"), T.street_aliases(x), "ix", "street", "p_partkey")


@query
def parse_ranges(v):
    x = by("p_partkey", cat(s("p_size"), " - ", (F.col("p_size") + 8).cast("string")), cat(s("p_size"), "–", s("p_partkey")), s("p_size"), cat(s("p_size"), "а-7"))
    n = lambda k: F.regexp_extract(x, H.P.WHOLE_RANGE, k).try_cast("int")
    return v.table("part").select("p_partkey", H.is_range(x).alias("is_range"), n(1).alias("house_from"), n(2).alias("house_to"))


@query
def house_tokens(v):
    x = cat("д. ", s("p_size"), "а, ", s("p_size"), "/3; ", s("p_partkey"), "-", s("p_size"), "ё")
    return v.table("part").select("p_partkey", F.array_join(H.house_tokens(x), "|").alias("tokens"))


@query
def detect_parity(v):
    x = by("p_partkey", "Четные дома", cat(s("p_size"), " (нечётные)"), "четные и нечетные", F.col("p_name"), "чётные")
    return v.table("part").select("p_partkey", H.detect_parity(x).alias("parity"))


@query
def normalize_rules(v):
    return I.raw_rules(v).select("id", ingest.rule_fields().alias("n")).select("id", "n.*")


@query
def sanitize_address(v):
    n = s("p_size")
    x = by("p_partkey", cat("г. Пермь, ул. ", F.col("p_name"), ", д. ", n), cat("ул. ", F.col("p_name"), ", ", n, ", 6"), cat("мкр. ", F.col("p_name")), cat(F.col("p_name"), "; ", n), cat("ул. A, д. ", n, ", корп. 2"), cat("ул. A, ул. ", F.col("p_name")), " ", F.repeat("p_name", 30), cat(n, " 1 2"))
    return v.table("part").select("p_partkey", T.sanitize_address(x).alias("address"))


@query
def normalize_values(v):
    number = by("p_partkey", s("p_size"), "-5", "abc", " 17 ", F.lit(None).cast("string"))
    items = F.array(s("p_size"), F.lit(" "), F.col("p_brand"))
    return v.table("part").select("p_partkey", H.normalize_parity(by("p_partkey", "even", "weird", "mixed")).alias("parity"), H.normalize_rule_type(by("p_partkey", "range", "list")).alias("rule_type"), H.normalize_int(number).alias("n"), H.normalize_list(items).alias("items"))


@query
def street_keys(v):
    x = by("p_partkey", cat(" Берёзовая  ", F.col("p_name")), F.upper("p_name"))
    return v.table("part").select("p_partkey", T.street_key(x).alias("street_key"))


@query
def clean_street(v):
    return v.rules.select("id", T.clean_street("street").alias("street"))


@query
def decree_metadata(v):
    return I.decree_texts(v).select("doc_id", metadata.decree_metadata("text").alias("m")).select("doc_id", "m.*")


@query
def decree_number(v):
    return I.decree_texts(v).select("doc_id", metadata.decree_number("text").alias("number"))


@query
def decree_date(v):
    return I.decree_texts(v).select("doc_id", metadata.decree_date("text").alias("date"))


@query
def municipality(v):
    return I.decree_texts(v).select("doc_id", metadata.municipality("text").alias("municipality"))


@query
def json_parse(v):
    rows = I.replies(v).select("doc_id", "chunk", R.parse_decree("content").alias("d"))
    return rows.select("doc_id", "chunk", F.col("d").isNotNull().alias("ok"), F.col("d.decree.number").alias("number"), F.size("d.schools").alias("n_schools"))


@query
def bad_replies(v):
    return ingest.bad_replies(I.replies(v))


@query
def flatten_decree(v):
    return ingest.flatten_decree(I.replies(v)).select("doc_id", "chunk", "school_ix", "school_name", "rule_ix", "street")


@query
def json_repair(v):
    return I.replies(v).select("doc_id", "chunk", R.json_repair("content").alias("json"), R.error_of("content").isNotNull().alias("failed"))


@query
def coerce_rules(v):
    return ingest.flatten_decree(I.replies(v))


@query
def classify_reply(v):
    x = cat('```json {"document_type": "', by("o_orderkey", "plain_text_list", "unknown"), '", "confidence": 0.5, "reason": "', F.col("o_orderstatus"), '"} ```')
    return v.table("orders").select("o_orderkey", R.parse_class(x).alias("c")).select("o_orderkey", "c.*")


@query
def prompts(v):
    return v.table("documents").select("doc_id", R.prompt("Разбери текст:\n{text}\nВерни JSON.", "text", 4000).alias("prompt"))


# Joins


@query
def find_school(v):
    return hit(v)


@query
def search_result(v):
    return search.search_result(hit(v), v.rules, v.schools, v.decrees)


@query
def search_status(v):
    rows = v.addresses.withColumn("house", F.when(F.col("address_id") % 50 == 0, "").otherwise(F.col("house")))
    return search.search_status(rows, search.find_school(rows, v.rules, v.schools, v.municipalities))


@query
def search_text(v):
    return search.search_text(free_addresses(v), v.rules, v.schools, v.municipalities)


@query
def check_address(v):
    lines = v.addresses.select("address_id", F.when(F.col("address_id") % 20 == 0, F.col("street")).otherwise(cat(F.col("locality"), ", ", F.col("street"), ", ", F.col("house"))).alias("line"))
    return search.check_address(lines, v.rules, v.schools, v.municipalities)


@query
def locality_join(v):
    left = v.schools.join(v.municipalities.select(F.col("id").alias("m"), F.col("name").alias("town")), F.col("municipality_id") == F.col("m")).select("id", by("id", F.col("town"), cat("г. ", F.col("town"), "а")).alias("name"))
    return search.locality_join(left, v.municipalities)


@query
def admin_rules(v):
    return catalog.admin_rules(v.rules, v.schools, v.decrees)


@query
def summary(v):
    return catalog.summary(v.municipalities, v.schools, v.rules)


@query
def totals(v):
    return catalog.totals(v.schools, v.rules)


@query
def intersections(v):
    return validate.intersections(v.rules, v.schools)


@query
def validate_rules(v):
    rules = v.rules.withColumns({"street": F.when(F.col("id") % 50 == 0, " ").otherwise(F.col("street")), "parity": F.when(F.col("id") % 40 == 0, "weird").otherwise(F.col("parity")), "house_from": F.when(F.col("id") % 30 == 0, F.col("house_to") + 5).otherwise(F.col("house_from"))})
    return validate.validate_rules(rules, v.schools)


@query
def merge_fallback(v):
    rules = v.rules.select(s("school_id").alias("doc_id"), F.lit("s").alias("school_name"), F.col("id").alias("ord"), "street", "house_rule_raw")
    return ingest.merge_fallback(rules.where(F.col("ord") % 3 == 0), rules.where(F.col("ord") % 3 > 0))


@query
def new_schools(v):
    wanted = v.table("customer").select(F.col("c_nationkey").cast("long").alias("municipality_id"), cat(" Supplier#", F.lpad((F.col("c_custkey") % 300).cast("string"), 9, "0")).alias("name"), cat("ул. A, д. ", s("c_custkey")).alias("address"), F.col("c_custkey").alias("ord"))
    return ingest.new_schools(wanted, v.schools)


# Aggregates and folds


@query
def extraction_score(v):
    return tables.extraction_score(I.records(v))


@query
def dedupe_schools(v):
    return tables.dedupe_schools(I.records(v)).select("doc_id", "school_name", "territory_text")


@query
def rules_by_school_nested(v):
    out = tables.nested_schools(tables.house_rules(tables.multi_column_rows(I.raw_tables(v))))
    return out.select("doc_id", "school_name", F.size("rules").alias("n_rules"), F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["street"], r["rule_type"])), "|").alias("rules"))


def chunks(v: Views) -> DataFrame:
    o = v.table("orders")
    return o.select(s("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("chunk"), by("o_orderkey", "", F.col("o_orderpriority")).alias("number"), by("o_orderkey", F.lit(None).cast("string"), "", F.date_format("o_orderdate", "dd.MM.yyyy")).alias("date"), by("o_orderkey", F.col("o_orderstatus"), "").alias("municipality"))


@query
def merge_chunks(v):
    return ingest.merge_chunks(chunks(v))


@query
def metadata_fill(v):
    rows = chunks(v).select(s("chunk").alias("doc_id"), "number", "date", "municipality", cat("т", s("chunk")).alias("text_number"), F.lit("01.01.2000").alias("text_date"), F.lit("").alias("text_municipality"))
    return ingest.metadata_fill(rows)


@query
def detect_multi_column(v):
    return tables.detect_multi_column(I.raw_tables(v))


@query
def detect_two_column(v):
    head = F.when(F.col("p_partkey") % 7 == 0, F.array(F.lit("Наименование школы"), F.lit("Закрепленная территория"))).otherwise(F.array(F.col("p_name"), F.col("p_brand")))
    return tables.detect_two_column(v.table("part").select(s("p_size").alias("doc_id"), (F.col("p_partkey") % 12).cast("int").alias("page"), F.col("p_partkey").cast("int").alias("table_ix"), (F.col("p_partkey") % 2).cast("int").alias("row_ix"), head.alias("cells")))


@query
def choose_strategy(v):
    flags = v.table("orders").select(s("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 3 == 0).alias("multi_column"), (F.col("o_orderkey") % 2 == 0).alias("two_column"), F.when(F.col("o_orderstatus") == "F", "two_column_school_territories").when(F.col("o_orderstatus") == "O", "unknown").alias("document_type"))
    return tables.choose_strategy(flags)


@query
def fill_forward(v):
    return tables.fill_forward(I.raw_tables(v))


@query
def multi_column_rows(v):
    return tables.multi_column_rows(I.raw_tables(v))


@query
def houses_to_rules(v):
    return tables.house_rules(I.raw_tables(v).where(F.col("id") % 10 != 0).select("id", F.col("cells")[3].alias("houses")))


@query
def process_table(v):
    return tables.process_tables(I.two_column_tables(v)).select("doc_id", "table_ix", "record_ix", "school_name", "territory_text")


@query
def stitch_names(v):
    p = v.table("part")
    name = by("p_partkey", "Муниципальное учреждение", cat("Городского округа «Школа № ", s("p_size"), "»"), cat("МАОУ «Школа № ", s("p_size"), "»"))
    return tables.stitch_names(p.select((F.col("p_partkey") % 40).cast("string").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("table_ix"), F.col("p_partkey").cast("int").alias("record_ix"), name.alias("school_name"), by("p_size", "", cat("ул. ", F.col("p_name"))).alias("territory_text")))


@query
def territory_rules(v):
    return exploded(I.territories(v), T.territory_rules("territory_text"), "ix", "r", "doc_id").select("doc_id", "ix", "r.*")


@query
def split_sections(v):
    body = F.repeat(F.concat(F.col("p_name"), F.lit(" ")), F.col("p_size") + 20)
    x = by("p_partkey", cat("вводная часть\n 1.\n", body, "\n2.1.\n", body, "\n3.\nкороткий"), F.repeat("p_name", 600))
    return exploded(v.table("part"), T.split_sections(x), "ix", "chunk", "p_partkey")


@query
def split_by_size(v):
    return exploded(v.table("documents"), T.split_by_size("text"), "ix", "chunk", "doc_id")


@query
def rule_numbers(v):
    nums = F.array_sort(F.array_distinct(H.rule_numbers("house_rule_raw", "house_number", "house_from", "house_to", "parity")))
    return v.rules.select("id", F.size(nums).alias("n"), F.array_join(nums.cast("array<string>"), ",").alias("numbers"))


# Changes


@query
def build_rules(v):
    return ingest.build_rules(I.raw_rules(v)).drop("school_id", "decree_id")


@query
def verify_streets(v):
    rules = v.table("part").select(F.col("p_partkey").alias("id"), by("p_partkey", F.lit(None).cast("string"), "").alias("locality"), F.col("p_name").alias("street"))
    return ingest.verify_streets(rules, I.gazetteer(v))


@query
def update_rule(v):
    changes = v.rules.where(F.col("id") % 10 == 3).select("id", cat(" ", F.col("street"), " ").alias("street"), F.lit("1-9").alias("house_rule_raw"), F.lit("odd ").alias("parity"), by("id", "7", "x").alias("house_from"), F.lit(" 9 ").alias("house_to"), F.lit(" ").alias("house_number"), F.lit("range").alias("rule_type"), F.lit("").alias("house_numbers"), F.lit("3").alias("exceptions"))
    return catalog.update_rules(v.rules, changes)


@query
def delete_rule(v):
    return catalog.delete_rules(v.rules, v.rules.where(F.col("id") % 10 == 3).select("id"))


def _saved(v: Views) -> dict[str, DataFrame]:
    decrees = v.municipalities.select(s("id").alias("doc_id"), by("id", F.lit("12-п"), "").alias("number"), F.lit("").alias("date"), by("id", F.col("name"), cat("новый ", F.col("name")), "").alias("municipality"))
    rules = I.raw_rules(v).join(v.schools.select(F.col("id").alias("sid"), F.col("name").alias("school_name"), "municipality_id"), F.col("school_id") == F.col("sid"))
    rules = rules.select(F.col("municipality_id").cast("string").alias("doc_id"), F.col("id").alias("ord"), "school_name", cat("ул. A, д. ", s("sid")).alias("school_address"), "locality", "street", "house_rule_raw", "parity", "rule_type", "house_from", "house_to", "house_number", "house_numbers", "exceptions", F.lit("").alias("comment"))
    null = F.lit(None).cast("string")
    stored_rules = v.rules.withColumns({"normalized_street": T.normalize_street("street"), "comment": null, "dadata_value": null, "dadata_confidence": null, "validation_status": F.lit("unchecked"), "validation_comment": null})
    return ingest.save_decrees(decrees, rules, {"municipalities": v.municipalities, "schools": v.schools, "decrees": v.decrees, "address_rules": stored_rules}, I.gazetteer(v))


@query
def save_summary(v):
    return _saved(v)["summary"]


@query
def save_decree(v):
    return _saved(v)["address_rules"]
