"""Golden values of the text functions."""

import random

import pytest
from pyspark.sql import functions as F

from zonewise.functions import text as T


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", fn("x").alias("y")).orderBy("i").select("y").collect()]


def test_normalize_street(spark):
    want = {
        "ул. Ленина": "ленина", "Ленина": "ленина", "проспект Ленина": "ленина", "пр-кт Ленина": "ленина", "шоссе Энтузиастов": "энтузиастов", "ш. Энтузиастов": "энтузиастов", "ш Энтузиастов": "энтузиастов", "переулок Школьный": "школьный",
        "пер. Школьный": "школьный", "Школьная улица": "школьная", "бульвар Нестерова": "нестерова", "б-р Нестерова": "нестерова", "набережная Шуйская": "шуйская", "наб. Шуйская": "шуйская", "площадь Победы": "победы", "пл. Победы": "победы",
        "Маршала Рыбалко": "маршала рыбалко", "40 лет Победы": "40 лет победы", "9-15 линия": "9-15", "школа № 5": "школа № 5", None: "", "": "", "пр-д Серова": "-д серова", "Берёзовая": "берёзовая",
    }
    assert apply(spark, T.normalize_street, list(want)) == list(want.values())


def test_normalize_locality(spark):
    want = {
        "Балашиха": "балашиха", "г Балашиха": "балашиха", "г. Балашиха": "балашиха", "город Балашиха": "балашиха", "Городской округ Балашиха": "балашиха", "г.о. Балашиха": "балашиха", "Московская обл, г Балашиха": "балашиха", "Пермский край, г Пермь": "пермь",
        "Берёзники": "берёзники", "г Березники": "березники", "п Сосновка": "сосновка", "д Малиновка": "малиновка", "муниципальный район Пушкинский": "пушкинский", None: "",
    }
    assert apply(spark, T.normalize_locality, list(want)) == list(want.values())


def test_locality_match(spark):
    yes = [("Пермь", "Перми"), ("Берёзники", "Березников"), ("Берёзники", "Березники"), ("Балашиха", "Балашихи"), ("Москва", "Москвы"), ("Электросталь", "Электростали")]
    no = [("Балашиха", "Балахна"), ("Пермь", "Тверь"), ("Москва", "Минск"), ("", "Пермь"), ("Пермь", "")]
    df = spark.createDataFrame([(a, b, True) for a, b in yes] + [(a, b, False) for a, b in no], "a string, b string, want boolean")
    assert df.where(T.locality_match("a", "b") != F.col("want")).count() == 0


def test_keys_match_is_the_prefix_and_tail_rule(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("аб") for _ in range(r.randint(0, 8)))

    def rule(a, b):
        if not a or not b:
            return False
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a == b or (n >= 4 and len(a) - n <= 2 and len(b) - n <= 2)

    pairs = [(a, b, rule(a, b)) for a, b in ((word(), word()) for _ in range(3000))]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.where(T.keys_match("a", "b") != F.col("want")).count() == 0


def test_locality_applicable(spark):
    rows = [("", "Пермь", None, True), ("Пермь", "г. Пермь", None, True), ("Москва", "г. Пермь", None, False), ("Пермь", None, "Перми", True), ("Балашиха", None, "Перми", False), ("Пермь", None, None, True), ("Пермь", "", "", True)]
    df = spark.createDataFrame(rows, "t string, a string, b string, want boolean")
    assert df.where(T.locality_applicable("t", "a", "b") != F.col("want")).count() == 0


def test_street_aliases(spark):
    assert apply(spark, T.street_aliases, ["Ленина", "Монастырская (Орджоникидзе)", "Ленина (Ленина)", "", None]) == [["Ленина"], ["Монастырская", "Орджоникидзе"], ["Ленина"], [], []]


def test_cells(spark):
    assert apply(spark, T.clean, [" a­b\xa0 c\n", None]) == ["ab c", ""]
    assert apply(spark, T.merge_cells, [["ул. Мира", "Мира", None, "ул. Мира", "д. 5"], []], "array<string>") == ["ул. Мира д. 5", ""]
    assert apply(spark, T.is_header, [["№", "Наименование", "улица", "номер дома"], ["1", "a", "b", "c"], [None]], "array<string>") == [True, False, False]
    assert apply(spark, T.is_school_or_prefix, ["МАОУ «СОШ № 1»", "«Гимназия № 2»", "Ленина", None]) == [True, True, False, False]


def test_sanitize_address(spark):
    keep = ["г. Балашиха, ул. Ленина, д. 10", "ул. Пятилетки, д. 21", "г. Берёзники, ул. Пятилетки, д. 21, корп. 1", "ул. Школьная", "Москва, Тверская 7"]
    drop = ["ул. Объединения, 4, 6", "мкр. Балашиха-1: ул. Живописная; проспект Ленина, 10, 10а, 12", "проспект Ленина, 10, 10а, 12, 14", "ул. Мира; ул. Молодежная (кроме д.11)", None, "", "x" * 201]
    assert apply(spark, T.sanitize_address, keep + drop) == keep + [None] * len(drop)


def test_territory_rules(spark):
    got = apply(spark, lambda x: F.transform(T.territory_rules(x), lambda r: r["street"]), ["ул. Белякова; ул. Восточная; ул. Комсомольская", "мкр. Балашиха-3: ул. Карла Маркса, 1; ул. Крупской, шоссе Энтузиастов", "", None])
    assert got == [["Белякова", "Восточная", "Комсомольская"], ["Карла Маркса", "Крупской", "Энтузиастов"], [], []]
    got = apply(spark, T.territory_rules, ["проспект Ленина, 72, 74, 76"])
    assert [tuple(r) for r in got[0]] == [("Ленина", "72, 74, 76")]


def test_splitting(spark):
    long = "слово " * 60
    got = apply(spark, T.split_sections, [f"начало\n1.\n{long}\n2.1.\nкоротко\n3.\n{long}", "x" * 4001, "", None])
    assert [len(x) for x in got] == [2, 2, 0, 0] and got[0][0].startswith("1.") and got[0][1].startswith("3.")


def test_transient(spark):
    yes = ["Read timed out", "HTTP 429", "Error 502", "Connection reset by peer", "SSL: UNEXPECTED_EOF", "handshake failed", "too many requests"]
    assert apply(spark, T.is_transient, [*yes, "bad JSON", "no field", None]) == [True] * len(yes) + [False] * 3


@pytest.mark.parametrize(("a", "b", "same"), [("МАОУ «Школа № 1»", "«школа № 1» г. Пермь", True), ("«Школа № 1»", "МАОУ «Школа № 1»", True), ("«Школа № 1»", "«Школа № 2»", False), ("", "«Школа № 1»", False), (None, None, False)])
def test_same_school(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(T.same_school("a", "b")).first()[0] is same
