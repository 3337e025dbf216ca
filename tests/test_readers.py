"""PDF readers by openers of made pages, DOC conversion, settings, and documents without tables."""

import json
from contextlib import contextmanager

import pytest

from zonewise import settings
from zonewise.plans import decrees
from zonewise.sources import documents
from zonewise.sources.schemas import RAW_TABLES

SCHOOL, OTHER = "МАОУ «СОШ № 1»", "МАОУ «Лицей № 2»"
LAND = "ул. Мира, дома 1-9, ул. Лесная"
LONG, MORE = "ул. Мира, дома 1-9 и 11-25", "ул. Садовая, дома 2-40 все"


class Page:
    """A page from JSON: tables by setting (null: fails), text, texts of the columns."""

    width, height = 100, 50

    def __init__(self, given):
        self.given = given

    def extract_text(self):
        return self.given.get("text")

    def extract_tables(self, table_settings=None):
        tables = self.given["tables"][0 if table_settings is None else documents.TABLE_SETTINGS.index(table_settings)]
        if tables is None:
            raise ValueError("no such table")
        return tables

    def crop(self, box):
        return Page({"text": self.given["halves"][box[0] > 0]})

    def find_tables(self):
        return [Table(t) for t in self.given["second"]]


class Table:
    def __init__(self, rows):
        self.rows = rows

    def extract(self):
        if self.rows is None:
            raise ValueError("unreadable")
        return self.rows


class File(list):
    @property
    def pages(self):
        return list(self)


@contextmanager
def opener(content):
    yield File(Page(p) for p in json.loads(content))


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    """This module's classes reach the workers by value."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    yield
    cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def pdf(spark, **pages):
    return spark.createDataFrame([(f"/in/{k}.pdf", json.dumps(v).encode()) for k, v in pages.items()], "path string, content binary")


def test_tables_of_all_settings_and_engines(spark):
    page = {"text": "т", "tables": [[[["Школа", None]], None], None, [], [[["a"], ["b", ""]]]], "second": [[["x", None]], None, [["y"]]], "halves": ["лево", None]}
    files = pdf(spark, a=[page, page | {"tables": [None] * 4, "second": []}]).union(spark.createDataFrame([("/in/n.txt", b"")], "path string, content binary"))
    got = sorted(tuple(r) for r in documents.tables_of(files, opener, opener).collect())
    a = "/in/a.pdf"
    assert got == sorted([
        (a, "first", 0, 1, 0, 0, ["Школа", ""]), (a, "first", 3, 1, 0, 0, ["a"]), (a, "first", 3, 1, 0, 1, ["b", ""]),
        (a, "second", 0, 1, 0, 0, ["x", ""]), (a, "second", 0, 1, 2, 0, ["y"]),
        (a, "columns", 0, 1, 0, 0, ["лево", ""]), (a, "columns", 0, 2, 0, 0, ["лево", ""]),
    ])
    assert [tuple(r) for r in documents.pdf_pages(pdf(spark, b=[page, {"text": None}]), opener).orderBy("page").collect()] == [("/in/b.pdf", 1, "т"), ("/in/b.pdf", 2, "")]


def test_a_file_that_the_second_engine_cannot_open_gives_none(spark):
    def broken(content):
        raise ValueError("damaged")

    assert documents.pdf_second_tables(pdf(spark, a=[]), broken).count() == 0
    assert documents.pdf_second_tables(pdf(spark, a=[])).count() == 0  # or the library is missing


def row(doc, engine, cells, setting=0, page=2, table=0, at=0):
    return doc, engine, setting, page, table, at, cells


def test_tables_first_then_the_second_engine_then_columns(spark):
    rows = [
        row("tables", "first", [SCHOOL, LAND]), row("tables", "first", [SCHOOL, LAND + ", ул. Новая"], setting=2), row("tables", "columns", [OTHER, LAND]),
        row("second", "first", [SCHOOL, LAND]), row("second", "second", [SCHOOL, LAND]), row("second", "second", [OTHER, LAND], table=1), row("second", "columns", [OTHER, LAND]),
        row("columns", "first", ["x", "y"]), row("columns", "columns", [f"{SCHOOL} {OTHER}", f"{LONG} {MORE}"]), row("columns", "columns", [SCHOOL, LAND], page=1),
    ]
    got = {}
    for r in decrees.school_territories(spark.createDataFrame(rows, RAW_TABLES)).collect():
        got.setdefault(r["doc_id"], {})[r["school_name"]] = r["territory_text"]
    assert got["tables"] == {SCHOOL: LAND + ", ул. Новая"}
    assert got["second"] == {SCHOOL: LAND, OTHER: LAND}
    assert got["columns"] == {SCHOOL: LONG, OTHER: MORE}


def test_other_settings_add_no_rows_to_wide_tables(spark):
    cells = ["1", SCHOOL, "Лесная", "7"]
    raw = spark.createDataFrame([row("w", engine, cells, setting) for engine, setting in (("first", 0), ("first", 1), ("first", 2), ("second", 0))], RAW_TABLES)
    none = lambda ddl: spark.createDataFrame([], ddl)
    out = decrees.parse(spark.createDataFrame([("w", "")], "doc_id string, text string"), raw, none("doc_id string, chunk int, content string"), none("doc_id string, school_name string, content string"), none("doc_id string, document_type string"))
    assert [(r["street"], r["house_rule_raw"]) for r in out["rules"].collect()] == [("Лесная", "7")]


def test_doc_conversion(spark, tmp_path, monkeypatch):
    assert documents._office(b"x", 1) is None or documents._office(b"x", 180)
    tool = tmp_path / "textutil"
    tool.write_text("#!/bin/sh\ncat \"$4\"\n")
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    assert documents._textutil("текст".encode(), 10) == "текст"
    office = tmp_path / "soffice"
    office.write_text("#!/bin/sh\nsleep 5\n")
    office.chmod(0o755)
    assert documents._office(b"x", 1) is None  # takes too long
    office.write_text("#!/bin/sh\nexit 1\n")
    assert documents._office(b"x", 10) is None
    tool.write_text("#!/bin/sh\nexit 1\n")
    assert documents._textutil(b"x", 10) is None
    df = spark.createDataFrame([("/in/a.doc", b"x")], "path string, content binary")
    (got,) = documents.doc_texts(df).collect()
    assert got["text"] is not None or got["error"] == "conversion failed"


def test_settings(tmp_path):
    file = tmp_path / ".env"
    file.write_text("# a comment\n\nSTORE=./data\nexport GAZETTEER_TOKEN = 'abc'\nMODEL_VERIFY_CERTIFICATES=True\nOTHER=1\nnot a line\n")
    got = settings.load(file, {"GAZETTEER_SECRET": "env", "gazetteer_token": "over"})
    assert got == settings.Settings(store=str(tmp_path / "data"), gazetteer_token="over", gazetteer_secret="env", model_verify_certificates=True)
    assert "env" not in repr(got)
    assert settings.load(tmp_path / "none", {}) == settings.Settings(store=str(tmp_path / "store"))
    assert settings.load(file, {"STORE": "hdfs://x/y"}).store == "hdfs://x/y"
