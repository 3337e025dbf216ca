"""Golden values of house rules."""

from pyspark.sql import functions as F

from zonewise.functions import houses as H
from zonewise.functions.address import parse_address
from zonewise.functions.metadata import decree_metadata

RULE = "raw string, kind string, parity string, lo int, hi int, num string, nums string, exc string"


def matches(spark, rule: dict, house):
    row = {"raw": "", "kind": "unknown", "parity": "all", "lo": None, "hi": None, "num": None, "nums": None, "exc": None} | rule
    df = spark.createDataFrame([(house, *row.values())], f"house string, {RULE}")
    cols = ("raw", "kind", "parity", "lo", "hi", "num", "nums", "exc")
    plain, prepared = df.withColumn("r", H.prepared_rule(*cols)).select(H.house_matches("house", *cols), H.prepared_covers(H.house_number("house"), H.normalize_house("house"), F.col("r"))).first()
    assert plain == prepared
    return plain


def test_house_matches(spark):
    cases = [
        ({"nums": "10,12,14"}, {"12": True, "11": False}), ({"nums": "10а,12,14"}, {"10а": True, "10А": True}), ({"kind": "range", "parity": "even", "lo": 22, "hi": 48}, {"22": True, "48": True, "30": True, "21": False, "50": False}),
        ({"kind": "range", "parity": "odd", "lo": 19, "hi": 39}, {"19": True, "39": True, "20": False, "41": False}), ({"kind": "all", "raw": "все"}, {"1": True, "999": True, None: True}), ({"kind": "all", "raw": "все", "exc": "11,15"}, {"11": False, "10": True}),
        ({"kind": "up_to", "hi": 18}, {"10": True, "18": True, "20": False}), ({"kind": "from_to_end", "lo": 36}, {"36": True, "100": True, "35": False}), ({"kind": "range", "lo": 10, "hi": 20}, {None: False, "12/3": True}), ({"kind": "range", "parity": "even", "lo": 10, "hi": 20}, {"12/3": True}),
        ({"kind": "all_except", "exc": "5"}, {"7": False}), ({"nums": "11", "parity": "even"}, {"11": True}),
    ]
    for rule, want in cases:
        for house, hit in want.items():
            assert matches(spark, rule, house) is hit, (rule, house)


def test_detect_parity(spark):
    want = {"четные дома": "even", "чётные": "even", "нечетные дома": "odd", "нечётные": "odd", "45 – 85 (нечетные)": "odd", "четные и нечетные до дома 18": "all", "1-17": None, "": None, "просто текст": None}
    df = spark.createDataFrame([(k, v) for k, v in want.items()], "x string, want string")
    assert df.where(~H.detect_parity("x").eqNullSafe(F.col("want"))).count() == 0


def normalized(spark, raw, parity=None):
    df = spark.createDataFrame([(raw, parity, None, None, None, None, None)], "raw string, parity string, kind string, lo int, hi int, nums string, exc string")
    return df.select(H.normalize_rule("raw", "parity", "kind", "lo", "hi", "nums", "exc").alias("n")).select("n.*").first().asDict()


def test_normalize_rule(spark):
    cases = {
        "1-17": {"rule_type": "range", "house_from": 1, "house_to": 17}, "45 – 85": {"rule_type": "range", "house_from": 45, "house_to": 85}, "45 – 85 (нечетные)": {"rule_type": "range", "parity": "odd"}, "начиная с дома 36": {"rule_type": "from_to_end", "house_from": 36, "house_to": None},
        "до дома 18": {"rule_type": "up_to", "house_from": None, "house_to": 18}, "10, 10а, 12, 14": {"rule_type": "exact_list", "house_numbers": "10,10а,12,14"}, "кроме д.11": {"rule_type": "all_except", "exceptions": "11"}, "": {"rule_type": "all"}, "все": {"rule_type": "all"},
        "от 20 до 40": {"rule_type": "from_to_end", "house_from": 20}, "12": {"rule_type": None}, "1, 3, 5-9": {"rule_type": "range", "house_from": 5, "house_to": 9},
    }
    for raw, want in cases.items():
        got = normalized(spark, raw)
        assert want.items() <= got.items(), (raw, got)
    assert normalized(spark, "1-17", "even")["parity"] == "even"
    assert normalized(spark, "четные", "all")["parity"] == "all"
    assert normalized(spark, "1-17 (четные)", "all")["parity"] == "even"


def test_rule_numbers(spark):
    df = spark.createDataFrame([("", "5, 7а,9", 1, 4, "even"), ("все", None, None, None, "all"), ("x", None, 20, 10, "all"), ("x", None, 1, 3, None)], "raw string, num string, lo int, hi int, parity string")
    got = [sorted(r[0]) for r in df.select(H.rule_numbers("raw", "num", "lo", "hi", "parity")).collect()]
    assert got == [[2, 4, 5, 9], list(range(1, 301)), [], [1, 2, 3]]


def test_houses_to_rules(spark):
    df = spark.createDataFrame([("1, 2; 5а, 7-9",), ("1-10",), ("",)], "x string")
    got = [[tuple(r) for r in row[0]] for row in df.select(H.houses_to_rules("x")).collect()]
    assert got == [[("1, 2; 5а, 7-9", None, None, "1,2,5а", "exact_list"), ("7-9", 7, 9, None, "range")], [("1-10", 1, 10, None, "range")], []]


def test_parse_address(spark):
    want = {
        "Московская обл, г Балашиха, ул Ленина, д 42": ("Балашиха", "Ленина", "42"), "г Пермь, ул Монастырская, д 96": ("Пермь", "Монастырская", "96"), "г Пермь, Монастырская 96": ("Пермь", "Монастырская", "96"), "Пермский край, г Пермь, шоссе Космонавтов, 96": ("Пермь", "Космонавтов", "96"),
        "г Берёзники, ул Пятилетки, 22": ("Берёзники", "Пятилетки", "22"), "Москва, Тверская, 7": ("Москва", "Тверская", "7"), "мкр Железнодорожный, Маяковского 3": (None, "Маяковского", "3"), "г Пермь, ул Ленина, д 42к1": ("Пермь", "Ленина", "42к1"), "": (None, None, None), None: (None, None, None),
    }
    df = spark.createDataFrame([(i, a) for i, a in enumerate(want)], "i int, a string")
    got = [tuple(r[0]) for r in df.select("i", parse_address("a").alias("p")).orderBy("i").select("p").collect()]
    assert got == list(want.values())


def test_metadata(spark):
    far = "слово " * 40
    want = {
        "ПОСТАНОВЛЕНИЕ от 06.03.2025 № 01-02-252": ("01-02-252", "06.03.2025", ""), "постановление № 458-п": ("458-п", "", ""), "№ 135": ("135", "", ""), "№ 171-ПА": ("171-ПА", "", ""), "Закона от 29.12.2012 № 273-ФЗ": ("", "", ""), "от 6.3.2025": ("", "06.03.2025", ""),
        "от 06/03/25": ("", "06.03.2025", ""), "от 15 апреля 2024 года": ("", "15.04.2024", ""), "от 1 сентября 2023 г.": ("", "01.09.2023", ""), "Городского округа Балашиха": ("", "", "Балашиха"), "городского округа Электросталь от 15": ("", "", "Электросталь"), "города Перми": ("", "", "Перми"),
        "муниципального района Пушкинский": ("", "", "Пушкинский"), "муниципальный округ Электросталь": ("", "", "Электросталь"), f"Признать утратившим силу постановление от 05.03.2022 № 171-ПА {far} № 12": ("12", "", ""), "": ("", "", ""), None: ("", "", ""),
    }
    df = spark.createDataFrame([(i, a) for i, a in enumerate(want)], "i int, a string")
    got = [tuple(r[0]) for r in df.select("i", decree_metadata("a").alias("p")).orderBy("i").select("p").collect()]
    assert got == list(want.values())
