"""Operators from tables to answers."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from zonewise import streaming
from zonewise.functions import replies as R
from zonewise.operators import catalog, ingest, search, tables, validate
from zonewise.plans import decrees as D
from zonewise.sources import documents, services
from zonewise.sources import tables as S
from zonewise.sources.schemas import GAZETTEER, RAW_TABLES, REPLIES


@pytest.fixture
def seeded(spark):
    return S.seed(spark)


def look_up(spark, t, *addresses):
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(addresses)], "address_id int, locality string, street string, house string")
    found = search.find_school(df, t["address_rules"], t["schools"], t["municipalities"])
    return {r["address_id"]: r["rule_id"] for r in found.collect()}


def test_find_school(spark, seeded):
    town, street = "г Березники", "ул Пятилетки"
    got = look_up(spark, seeded, (town, street, "22"), (town, street, "23"), (town, street, "50"), ("Балашиха", street, "22"), ("Берёзники", "Пятилетки", "30"), ("", street, "22"), (town, "Ленина", "22"))
    assert got == {0: 2, 1: 1, 4: 2, 5: 2}


def test_first_rule_wins(spark, seeded):
    rules = seeded["address_rules"].unionByName(seeded["address_rules"].where("id = 2").withColumn("id", F.lit(7).cast("long")))
    assert look_up(spark, seeded | {"address_rules": rules}, ("Березники", "Пятилетки", "22")) == {0: 2}


def test_search_text_and_check(spark, seeded):
    t = seeded
    df = spark.createDataFrame([(1, "Пермский край, г Березники, ул Пятилетки, д 22"), (2, "непонятно")], "address_id int, address string")
    got = {r["address_id"]: (r["house"], r["rule_id"]) for r in search.search_text(df, t["address_rules"], t["schools"], t["municipalities"]).collect()}
    assert got == {1: ("22", 2), 2: (None, None)}
    df = spark.createDataFrame([(1, "Березники, Пятилетки, 22"), (2, "Березники, Пятилетки")], "address_id int, line string")
    assert [tuple(r) for r in search.check_address(df, t["address_rules"], t["schools"], t["municipalities"]).collect()] == [(1, 2)]


def rules_for(spark, seeded, *rows):
    base = seeded["address_rules"].where("id = 1").drop("id", "school_id", "house_from", "house_to", "house_rule_raw", "street", "parity")
    df = spark.createDataFrame(rows, "id long, school_id long, street string, house_rule_raw string, parity string, house_from int, house_to int")
    return df.join(base, F.lit(True)).select(*seeded["address_rules"].columns)


def test_validator(spark, seeded):
    kinds = lambda rules: sorted(r["type"] for r in validate.validate_rules(rules, seeded["schools"]).collect())
    apart = rules_for(spark, seeded, (1, 1, "Мира", "1-10", "all", 1, 10), (2, 2, "ул. Мира", "11-20", "all", 11, 20))
    assert kinds(apart) == []
    over = rules_for(spark, seeded, (1, 1, "Мира", "1-10", "all", 1, 10), (2, 2, "ул. Мира", "5-40", "all", 5, 40), (3, 2, "Мира", "1", "all", 1, 300))
    got = validate.intersections(over, seeded["schools"]).collect()
    assert sorted((r["rule_id"], r["second_rule_id"]) for r in got) == [(1, 2), (1, 3)]
    assert {r["message"] for r in got} == {"Пересечение правил по улице Мира: дома [5, 6, 7, 8, 9, 10]", "Пересечение правил по улице Мира: дома [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]"}
    assert kinds(rules_for(spark, seeded, (1, 1, "Мира", "x", "all", 20, 10))) == ["invalid_range"]
    assert kinds(rules_for(spark, seeded, (1, 1, " ", " ", "weird", 0, 10))) == ["empty_house_rule", "empty_street", "unknown_parity"]


RAW = [
    ("d", 1, 0, 0, ["№", "Наименование", "улица", "номер дома"]), ("d", 1, 0, 1, ["1", "МАОУ «СОШ № 1»", "Ленина", "1-10"]), ("d", 1, 0, 2, [None, None, "Пушкина (Новая)", "2, 4"]), ("d", 2, 0, 0, [None, None, "Мира", "5; 7-9"]), ("d", 2, 0, 1, ["2", "МАОУ «СОШ № 2»", "—", "1"]), ("d", 2, 0, 2, ["2", None, "Лесная", "нет"]),
]


def raw_tables(spark, rows):
    return spark.createDataFrame([(d, "lines", 0, p, t, r, c) for d, p, t, r, c in rows], RAW_TABLES)


def test_multi_column(spark):
    raw = raw_tables(spark, RAW)
    rows = [(r["school_name"], r["street"], r["houses"]) for r in tables.multi_column_rows(raw).orderBy("page", "row_ix", "alias_ix").collect()]
    one = "МАОУ «СОШ № 1»"
    assert rows == [(one, "Ленина", "1-10"), (one, "Пушкина", "2, 4"), (one, "Новая", "2, 4"), (one, "Мира", "5; 7-9")]
    assert tables.detect_multi_column(raw).first()["multi_column"]
    nested = tables.nested_schools(tables.house_rules(tables.multi_column_rows(raw))).collect()
    assert len(nested) == 1 and [r["rule_type"] for r in nested[0]["rules"]] == ["range", "exact_list", "exact_list", "exact_list", "range"]


def test_two_column(spark):
    a, b = "Муниципальное учреждение «Школа № 1»", "Муниципальное учреждение «Школа № 2»"
    rows = [("d", 1, 0, 0, [a, "ул. Мира, 1, 2"]), ("d", 1, 0, 1, ["", "ул. Лесная, 3"]), ("d", 1, 0, 2, [None, "ул. Мира, 1, 2"]), ("d", 1, 0, 3, ["«Школа № 1»", "пер. Новый"]), ("d", 1, 0, 4, [b, None]), ("d", 1, 0, 5, [b, "ул. Садовая, 9"])]
    got = tables.process_tables(raw_tables(spark, rows)).orderBy("record_ix").collect()
    assert [(r["school_name"], r["territory_text"]) for r in got] == [(a, "ул. Мира, 1, 2 ул. Лесная, 3 пер. Новый"), (b, "ул. Садовая, 9")]
    assert tables.process_tables(raw_tables(spark, [])).count() == 0


def test_stitch_and_dedupe(spark):
    rows = [("d", 1, 0, 0, "Муниципальное учреждение", "ул. A"), ("d", 2, 0, 0, "Городского округа", ""), ("d", 2, 0, 1, "«Школа № 1»", "ул. B"), ("d", 3, 0, 0, "«Школа № 2»", "ул. C")]
    df = spark.createDataFrame(rows, "doc_id string, page int, table_ix int, record_ix int, school_name string, territory_text string")
    got = tables.stitch_names(df).orderBy("page").collect()
    assert [(r["school_name"], r["territory_text"]) for r in got] == [("Муниципальное учреждение Городского округа «Школа № 1»", "ул. A ул. B"), ("«Школа № 2»", "ул. C")]
    twice = df.unionByName(df.withColumn("territory_text", F.concat("territory_text", F.lit(" и ещё"))))
    assert {r["territory_text"] for r in tables.dedupe_schools(twice).collect()} == {"ул. A и ещё", " и ещё", "ул. B и ещё", "ул. C и ещё"}


def test_replies(spark):
    texts = ['```json\n{"a": 1}\n```', '{"a": 1,}', '{"a": [1, 2,]}', 'вот {"a": 1} всё', "нет", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    assert [r[1] for r in df.select("i", R.json_repair("x")).orderBy("i").collect()] == ['{"a": 1}', '{"a": 1}', '{"a": [1, 2]}', '{"a": 1}', None, None]
    one = '{"decree": {"number": "5"}, "schools": [{"name": "A", "rules": [{"street": "Мира", "house_from": "19", "house_to": "abc", "house_number": ["21", "23", null], "parity": "weird", "extra": 1}]}, {"name": "B", "rules": null}]}'
    got = spark.createDataFrame([(one,)], "x string").select(R.parse_decree("x").alias("d")).first()["d"]
    rule = got["schools"][0]["rules"][0]
    assert (rule["house_from"], rule["house_to"], rule["house_number"], rule["parity"], rule["locality"]) == (19, None, "21,23", "unknown", "")
    assert got["schools"][1]["rules"] == [] and got["schools"][1]["address"] == "" and got["decree"]["date"] == ""


def test_merge_fallback(spark):
    cols = "doc_id string, school_name string, ord int, street string, house_rule_raw string"
    model = spark.createDataFrame([("d", "s", 0, "Берёзовая", "1")], cols)
    text = spark.createDataFrame([("d", "s", 0, "Березовая", "2"), ("d", "s", 1, "Пушкина", "3"), ("d", "s", 2, "Пушкина", "4")], cols)
    assert sorted((r["street"], r["house_rule_raw"]) for r in ingest.merge_fallback(model, text).collect()) == [("Берёзовая", "1"), ("Пушкина", "3")]
    assert ingest.merge_fallback(model.limit(0), text.limit(0)).count() == 0


def test_verify_streets(spark):
    rules = spark.createDataFrame([(1, "Пермь", "Мира"), (2, None, "Мира"), (3, "", "Лесная"), (4, None, "Нет"), (5, None, "Сбой")], "id long, locality string, street string")
    answers = spark.createDataFrame([("Пермь, Мира", "г Пермь, ул Мира", "ул Мира", None), ("Мира", "v", None, None), ("Лесная", "v", "Новая", None), ("Сбой", None, None, "timeout")], GAZETTEER + ", failed STRING")
    got = {r["id"]: (r["validation_status"], r["dadata_confidence"]) for r in ingest.verify_streets(rules, answers).collect()}
    assert got == {1: ("verified", "high"), 2: ("needs_review", "low"), 3: ("needs_review", "medium"), 4: ("needs_review", "low"), 5: ("skipped", None)}


def test_save_then_search_and_update(spark, tmp_path):
    folder = str(tmp_path)
    S.create(spark, folder)
    stored = lambda: {n: S.read(spark, folder, n) for n in ("municipalities", "schools", "decrees", "address_rules")}
    decrees = spark.createDataFrame([("d", "01-02-252", "06.03.2025", "Березники")], "doc_id string, number string, date string, municipality string")
    schema = "doc_id string, ord int, school_name string, school_address string, locality string, street string, house_rule_raw string, parity string, rule_type string, house_from int, house_to int, house_number string, house_numbers string, exceptions string, comment string"
    rules = spark.createDataFrame([("d", i, "СОШ № 1", "мусор; 1", "", "ул. Пятилетки", raw, None, None, None, None, None, None, None, "") for i, raw in enumerate(("19-39 (нечетные)", "22-48 (четные)"))], schema)
    none = spark.createDataFrame([], GAZETTEER)
    for _ in range(2):
        out = ingest.save_decrees(decrees, rules, stored(), none)
        summary = out.pop("summary").collect()
        for name, df in out.items():
            S.append(df, folder, name)
        first = summary if _ == 0 else first  # noqa: F821
    assert (first[0]["schools_count"], first[0]["rules_count"]) == (1, 2) and summary[0]["schools_count"] == 0
    t = stored()
    assert {n: df.count() for n, df in t.items()} == {"municipalities": 1, "schools": 1, "decrees": 2, "address_rules": 4}
    assert t["schools"].first()["address"] is None
    assert look_up(spark, t, ("Березники", "Пятилетки", "22"), ("Березники", "Пятилетки", "23"), ("Березники", "Пятилетки", "50")) == {0: 2, 1: 1}
    change = spark.createDataFrame([(1, " Мира ", "1-9", "odd", "1", "x", " ", "range", "", "3")], "id long, street string, house_rule_raw string, parity string, house_from string, house_to string, house_number string, rule_type string, house_numbers string, exceptions string")
    new = {r["id"]: r for r in catalog.update_rules(t["address_rules"], change).collect()}
    assert (new[1]["street"], new[1]["house_from"], new[1]["house_to"], new[1]["house_number"], new[1]["normalized_street"]) == ("Мира", 1, None, None, "пятилетки") and new[2]["street"] == "Пятилетки"
    assert S.reset(spark, folder)["address_rules"] == 4 and stored()["address_rules"].count() == 0


def docx(paragraphs, table):
    cell = lambda c: f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, row)) + "</w:tr>" for row in table) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_documents_to_rules(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(["ПОСТАНОВЛЕНИЕ от 06.03.2025 № 12-п города Перми", " "], [["№", "Наименование", "улица", "номер дома"], ["1", "МАОУ «СОШ № 1»", "Ленина", "1, 3, 5-9"]]))
    files = documents.files(spark, str(tmp_path))
    texts, raw = documents.docx_texts(files), documents.docx_tables(files)
    assert texts.first()["text"].split("\n")[1] == "№ | Наименование | улица | номер дома"
    none = lambda schema: spark.createDataFrame([], schema)
    out = D.parse(texts, raw, none(REPLIES), none("doc_id string, school_name string, content string"), none("doc_id string, document_type string"))
    assert [(r["number"], r["date"], r["municipality"]) for r in out["decrees"].collect()] == [("12-п", "06.03.2025", "Перми")]
    assert {(r["street"], r["rule_type"], r["house_from"]) for r in out["rules"].collect()} == {("Ленина", "exact_list", None), ("Ленина", "range", 5)}
    assert {(r["rule_type"], r["house_number"]) for r in out["rules"].collect()} == {("exact_list", "1,3"), ("range", None)}


def test_two_column_document_with_replies(spark):
    school = "Муниципальное учреждение «Школа № 1»"
    raw = raw_tables(spark, [("d", 1, 0, 0, ["Наименование", "Закрепленная территория"]), ("d", 1, 0, 1, [school, "ул. Мира, 1, 2; ул. Лесная, 3"])])
    texts = spark.createDataFrame([("d", "№ 5"), ("e", "")], "doc_id string, text string")
    territory = spark.createDataFrame([("d", school, '{"rules": [{"street": "Мира", "house_rule_raw": "1, 2"}]}')], "doc_id string, school_name string, content string")
    whole = spark.createDataFrame([("e", 1, '{"schools": [{"name": "B", "rules": [{"street": "Садовая"}]}]}'), ("e", 2, "сбой")], REPLIES)
    out = D.parse(texts, raw, whole, territory, spark.createDataFrame([], "doc_id string, document_type string"))
    assert sorted((r["doc_id"], r["street"], r["house_rule_raw"]) for r in out["rules"].collect()) == [("d", "Лесная", "3"), ("d", "Мира", "1, 2"), ("e", "Садовая", "")]
    assert [r["error"] for r in out["errors"].collect()] == ["no_json"]


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"doc_id": "d", "chunk": 1, "content": "{\\"schools\\": [{\\"name\\": \\"A\\", \\"rules\\": [{\\"street\\": \\"ул. Мира\\", \\"house_rule_raw\\": \\"1-9\\"}]}]}"}\n')
    rules = streaming.raw_rules(streaming.replies(spark, str(tmp_path / "in")))
    streaming.write(rules, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).first()
    assert (got["street"], got["rule_type"], got["house_from"], got["house_to"]) == ("Мира", "range", 1, 9)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 43
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_services(spark):
    waits, calls = [], []

    def flaky(q):
        calls.append(q)
        if len(calls) < 3:
            raise OSError("Connection reset by peer")
        return q.upper()

    assert services.with_retry(flaky, "a", sleep=waits.append) == "A" and waits == [4.0, 8.0]
    with pytest.raises(ValueError, match="bad"):
        services.with_retry(lambda _: (_ for _ in ()).throw(ValueError("bad")), "a", sleep=waits.append)
    assert len(waits) == 2

    def client(q):
        if q == "x":
            raise ValueError("no such place")
        return q + "!"

    df = spark.createDataFrame([("a",), ("a",), ("x",), (None,)], "query string")
    got = {r["query"]: (r["answer"], r["failed"]) for r in services.ask(df, client, pause=0).collect()}
    assert got == {"a": ("a!", None), "x": (None, "no such place")}


def test_pages_and_routes(spark):
    pages = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("d", 3, " ")], "doc_id string, page int, text string")
    assert documents.join_pages(pages).first()["text"] == "a\n\nb"
    texts = spark.createDataFrame([("d", "x" * 500, "o"), ("e", " short ", "o")], "doc_id string, native string, ocr string")
    assert {r["doc_id"]: r["text"][0] for r in documents.route_text(texts).collect()} == {"d": "x", "e": "o"}
    assert documents.pdf_pages(spark.createDataFrame([], "path string, content binary")).count() == 0
    old = spark.createDataFrame([("a.doc", b"x")], "path string, content binary")
    assert documents.convert_doc(old).first()["path"] == "a.doc"
