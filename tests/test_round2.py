"""Overlaps by bounds, prefix blocks, changes, readers by suffix, texts to rules in one plan, added strategies."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from zonewise.functions import houses as H
from zonewise.functions.text import locality_key, locality_match
from zonewise.operators import catalog, ingest, search, validate
from zonewise.plans import decrees
from zonewise.sources import documents

RULES = "id long, school_id long, locality string, street string, house_rule_raw string, house_number string, house_from int, house_to int, parity string"


def brute_set(raw, number, low, high, parity):
    if (raw or "").lower() in ("все", "все дома"):
        return set(range(1, 301))
    out = {int(x) for x in (x.strip() for x in (number or "").split(",")) if x.isdigit()}
    if low is not None and high is not None:
        out |= {n for n in range(low, high + 1) if not (parity == "even" and n % 2) and not (parity == "odd" and n % 2 == 0)}
    return out


def test_overlaps_equal_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(120):
        low = r.choice([None, -3, 0, *range(1, 60)])
        high = r.choice([None, 5, 20, 40, 9000, 2_000_000_000 if i < 4 else 33])
        rows.append((i, r.choice([None, *range(6)]), None, r.choice(["ул. А", "Б"]), r.choice(["", "x", None, "все"] if i % 9 == 0 else [""]), r.choice([None, "", "3, 4,x,17", "250"]), low, high, r.choice([None, "all", "even", "odd"])))
    got = {(x["rule_id"], x["second_rule_id"]): x["message"] for x in validate.intersections(spark.createDataFrame(rows, RULES), spark.createDataFrame([], "id long, name string")).collect()}
    cut = [(*x[:7], None if x[7] is None else min(x[7], 10_000), x[8]) for x in rows]  # the ten least common numbers are below
    want = {}
    for a, b in itertools.combinations(cut, 2):
        both = sorted(brute_set(*a[4:]) & brute_set(*b[4:]))[:10]
        if a[3] == b[3] and a[1] != b[1] and both:
            want[a[0], b[0]] = str(both)
    assert len(want) > 300 and set(got) == set(want)
    assert all(got[k].endswith(f"дома {want[k]}") for k in want)


def test_wide_spans_are_not_written_out(spark):
    df = spark.createDataFrame([(1, 1, None, "А", "", None, 1, 2_000_000_000, None), (2, 2, None, "А", "", "7", None, None, None)], RULES)
    assert [r["n"] for r in df.orderBy("id").select(F.size(H.rule_numbers("house_rule_raw", "house_number", "house_from", "house_to", "parity")).alias("n")).collect()] == [None, 1]
    (row,) = validate.intersections(df, spark.createDataFrame([], "id long, name string")).collect()
    assert row["message"].endswith("[7]")


def test_prepared_rules_agree_with_the_cases(spark):
    r = random.Random(5)
    rows = []
    for i in range(1500):
        rows.append((i, r.choice(["1", "2", "7а", "", None, "x", "12"]), r.choice(["", "все", None, "x"]), r.choice(["range", "up_to", "from_to_end", "all", "exact_list", None]), r.choice(["even", "odd", "all", None]), r.choice([None, 0, 1, 2, 7]), r.choice([None, 0, 2, 9]), r.choice([None, "7а", "1"]), r.choice([None, "2, 12", ""]), r.choice([None, "1", "7а,2"])))
    names = ["house_rule_raw", "rule_type", "parity", "house_from", "house_to", "house_number", "house_numbers", "exceptions"]
    df = spark.createDataFrame(rows, "id long, house string, house_rule_raw string, rule_type string, parity string, house_from int, house_to int, house_number string, house_numbers string, exceptions string")
    both = df.select(H.house_matches("house", *names).alias("a"), H.prepared_covers(H.house_number("house"), H.normalize_house("house"), H.prepared_rule(*names)).alias("b"))
    assert both.where("NOT (coalesce(a, false) <=> coalesce(b, false))").count() == 0
    assert both.where("a").count() > 100


def test_locality_join_loses_no_pair(spark):
    names = ["Новосёлово", "Новоселова", "Новосел", "Ново", "Новая", "Нова", "ёж", "еж", "ежи", "г. Пермь", "Перми", "Пермский", "", None, "Балашиха", "Балашихи", "Балаших", "Балаш"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = sorted(map(tuple, search.locality_join(df, df).collect()))
    a, b = df.select(F.col("id").alias("left_id"), F.col("name").alias("x")), df.select(F.col("id").alias("right_id"), F.col("name").alias("y"))
    want = a.crossJoin(b).where(locality_match("x", "y") & (locality_key("x") != "")).select("left_id", "right_id")
    assert got == sorted(map(tuple, want.collect())) and len(got) == len(set(got)) > len(names)


def test_several_changes_of_one_rule(spark):
    stored = spark.createDataFrame([(1, "а"), (2, "б")], "id long, street string")
    fields = "id long, street string, house_rule_raw string, parity string, rule_type string, house_from string, house_to string, house_number string, house_numbers string, exceptions string"
    change = lambda *ids: spark.createDataFrame([(i, s, "1", "all", "range", "1", None, "", None, "") for i, s in ids], fields)
    assert sorted(map(tuple, catalog.update_rules(stored, change((1, "в"), (1, "в"), (9, "г"))).collect())) == [(1, "в"), (2, "б")]
    with pytest.raises(Exception, match="several changes of rule 1"):
        catalog.update_rules(stored, change((1, "в"), (1, "г"))).collect()


def test_json_errors_tell_the_place(spark):
    long = '{"a": "' + "x" * 2000 + '", "b": oops, "c": "' + "y" * 2000 + '"}'
    rows = [("d", 0, "no braces"), ("d", 1, '{"decree": {"number": "1"},}'), ("d", 2, long), ("d", 3, None)]
    got = {r["chunk"]: r for r in ingest.bad_replies(spark.createDataFrame(rows, "doc_id string, chunk int, content string")).collect()}
    assert set(got) == {0, 2, 3} and got[0]["error"] == got[3]["error"] == "no_json"
    at = long.index("oops")
    assert got[2]["error"] == f"bad_json: Expecting value at {at}: {long[at - 300 : at + 300]}" and got[2]["preview"] == long[:500]


def test_texts_to_rules_in_one_plan(spark):
    body = '{"decree": {"number": "%s", "date": "", "municipality": ""}, "schools": [{"name": "СОШ %s", "address": "", "rules": [{"street": "Мира", "house_rule_raw": "1-9"}]}]}'
    asked = {"первый": body % ("77", 1), "второй": body % ("", 2)}

    def client(question):
        if "сбой" in question:
            raise ValueError("refused")
        return next((v for k, v in asked.items() if k in question), "ничего")

    long = lambda word: f"{word} " + "текст " * 80
    sections = "".join(f"\n{k}.\n{long(word)}" for k, word in enumerate(("первый", "второй", "сбой", "пустой"), 1))
    texts = [("a", sections), ("b", "второй"), ("c", None)]
    out = decrees.text_rules(spark.createDataFrame(texts, "doc_id string, text string"), client, pause=0.0, first_wait=0.0)
    assert {(r["doc_id"], r["number"]) for r in out["decrees"].collect()} == {("a", "77"), ("b", ""), ("c", "")}
    assert sorted((r["doc_id"], r["school_name"], r["street"]) for r in out["rules"].collect()) == [("a", "СОШ 1", "Мира"), ("a", "СОШ 2", "Мира"), ("b", "СОШ 2", "Мира")]
    assert sorted((r["doc_id"], r["error"]) for r in out["errors"].collect()) == [("a", "no_json"), ("a", "not_asked: refused")]


def test_strategies_can_be_added(spark, monkeypatch):
    from zonewise.sources.schemas import RAW_TABLES

    monkeypatch.setattr(decrees, "STRATEGIES", dict(decrees.STRATEGIES))
    decrees.register("lists", lambda raw: raw.groupBy("doc_id").agg(F.max(F.size("cells") == 1).alias("found")), lambda raw, replies: decrees.multi_column(raw.withColumn("cells", F.array(F.lit("1"), F.lit("МАОУ «СОШ № 1»"), F.col("cells")[0], F.lit("5")))))
    raw = spark.createDataFrame([("x", "lines", 0, 1, 0, 0, ["Мира"]), ("y", "lines", 0, 1, 0, 0, ["1", "МАОУ «СОШ № 2»", "Лесная", "7"])], RAW_TABLES)
    texts = spark.createDataFrame([("x", ""), ("y", "")], "doc_id string, text string")
    none = lambda ddl: spark.createDataFrame([], ddl)
    out = decrees.parse(texts, raw, none("doc_id string, chunk int, content string"), none("doc_id string, school_name string, content string"), none("doc_id string, document_type string"))
    assert {(r["doc_id"], r["strategy"]) for r in out["strategies"].collect()} == {("x", "lists"), ("y", decrees.MULTI)}
    assert {(r["doc_id"], r["street"]) for r in out["rules"].collect()} == {("x", "Мира"), ("y", "Лесная")}


def test_readers_by_suffix(spark, monkeypatch):
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Привет</w:t></w:r></w:p></w:body></w:document>')
    monkeypatch.setitem(documents.READERS, ".txt", lambda df: df.select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text")))
    rows = [("/a/x.DOCX", held.getvalue()), ("/a/y.txt", b"plain"), ("/a/z.xyz", b""), ("/a/none", b""), ("/a/old.doc", b"not a doc")]
    got = {r["doc_id"]: (r["text"], r["error"]) for r in documents.texts_of(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["/a/x.DOCX"] == ("Привет", None) and got["/a/y.txt"] == ("plain", None)
    assert got["/a/z.xyz"] == (None, "unsupported format: .xyz") and got["/a/none"] == (None, "unsupported format: ")
    assert got["/a/old.doc"][0] is not None or got["/a/old.doc"][1] == "conversion failed"
