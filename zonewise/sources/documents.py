"""Decree files as tables of text and of raw table rows.

DOCX files are read with the standard library: a zip of XML parts. PDF files need
a PDF library in the workers, or an opener that the caller brings; where there is none, their pages come as tables
from elsewhere (``schemas.RAW_TABLES``). Old DOC files are converted first.
"""

from __future__ import annotations

import io
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, nullcontext
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .schemas import RAW_TABLES

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _text(p: ElementTree.Element) -> str:
    out = []
    for node in p.iter():
        if node.tag == f"{W}t":
            out.append(node.text or "")
        elif node.tag in (f"{W}tab", f"{W}br", f"{W}cr"):
            out.append("\t" if node.tag.endswith("tab") else "\n")
    return "".join(out)


def docx_parts(content: bytes) -> tuple[list[str], list[list[list[str]]]]:
    """Paragraphs of the body, and its tables as rows of cell texts. Merged cells repeat their text."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{W}body")
    paragraphs, tables = [], []
    for node in body if body is not None else ():
        if node.tag == f"{W}p":
            paragraphs.append(_text(node))
        elif node.tag == f"{W}tbl":
            rows: list[list[str]] = []
            for tr in node.findall(f"{W}tr"):
                cells: list[str] = []
                for tc in tr.findall(f"{W}tc"):
                    span, merged = tc.find(f"{W}tcPr/{W}gridSpan"), tc.find(f"{W}tcPr/{W}vMerge")
                    text = "\n".join(_text(p) for p in tc.findall(f"{W}p"))
                    if merged is not None and merged.get(f"{W}val") in (None, "continue") and rows and len(rows[-1]) > len(cells):
                        text = rows[-1][len(cells)]
                    cells += [text] * int(span.get(f"{W}val") if span is not None else 1)
                rows.append(cells)
            tables.append(rows)
    return paragraphs, tables


def files(spark: SparkSession, path: str, pattern: str = "*.docx") -> DataFrame:
    """path and content of the files in a folder whose names fit the pattern; one row a file, so a task reads files one by one."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def docx_text(content: bytes) -> str:
    """Paragraphs that aren't blank, then table rows with bars between cells."""
    paragraphs, tables = docx_parts(content)
    lines = [p.strip() for p in paragraphs if p.strip()]
    return "\n".join([*lines, *(" | ".join(c.strip() for c in row) for table in tables for row in table if any(c.strip() for c in row))])


def docx_texts(docx: DataFrame) -> DataFrame:
    """doc_id and text of DOCX files (path, content)."""
    ship(docx.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["path"], "text": [docx_text(content) for content in frame["content"]]})

    return docx.mapInPandas(run, "doc_id string, text string")


def docx_tables(docx: DataFrame) -> DataFrame:
    """Raw table rows; a table's page is its number."""
    ship(docx.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                for t, table in enumerate(docx_parts(content)[1], 1):
                    out += [(path, "docx", 0, t, 0, i, cells) for i, cells in enumerate(table)]
            yield pd.DataFrame(out, columns=["doc_id", "engine", "setting", "page", "table_ix", "row_ix", "cells"])

    return docx.mapInPandas(run, RAW_TABLES)


#: Settings with which a page's tables are looked for, in this order; the first are the library's own.
TABLE_SETTINGS = ({}, *({"vertical_strategy": v, "horizontal_strategy": h, "snap_tolerance": 4} for v, h in (("lines", "lines"), ("text", "text"), ("lines", "text"))))
#: Where the left column of a page without tables ends, and where the right one starts, as shares of its width.
LEFT_END, RIGHT_START = 0.42, 0.38

#: Opens a PDF file's bytes, as a context manager.
Opener = Callable[[bytes], AbstractContextManager]


def first_engine(content: bytes) -> AbstractContextManager:
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("PDF files need pdfplumber; bring an opener, or give their pages as tables instead") from e
    return pdfplumber.open(io.BytesIO(content))


def second_engine(content: bytes) -> AbstractContextManager:
    """Pages by PyMuPDF; none where it isn't installed."""
    try:
        import pymupdf
    except ImportError:
        return nullcontext(())
    return pymupdf.open(stream=content, filetype="pdf")


def _each_pdf(pdf: DataFrame, rows_of: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """The rows of each PDF file (path, content), after its path."""
    ship(pdf.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([(path, *row) for row in rows_of(content)], columns=names)

    return pdf.mapInPandas(run, schema)


def pdf_pages(pdf: DataFrame, opener: Opener = first_engine) -> DataFrame:
    """doc_id, page and text of PDF files (path, content)."""

    def rows_of(content: bytes) -> list[tuple]:
        with opener(content) as doc:
            return [(k, page.extract_text() or "") for k, page in enumerate(doc.pages, 1)]

    return _each_pdf(pdf, rows_of, "doc_id string, page int, text string")


def _table_rows(engine: str, setting: int, page: int, tables: list) -> list[tuple]:
    return [(engine, setting, page, t, i, [c or "" for c in cells]) for t, table in enumerate(tables or ()) for i, cells in enumerate(table or ())]


def pdf_tables(pdf: DataFrame, opener: Opener = first_engine) -> DataFrame:
    """Raw table rows of PDF files (path, content), of each page by each of TABLE_SETTINGS.

    A setting that fails on a page gives none of its rows there.
    """

    def rows_of(content: bytes) -> list[tuple]:
        out = []
        with opener(content) as doc:
            for k, page in enumerate(doc.pages, 1):
                for n, setting in enumerate(TABLE_SETTINGS):
                    try:
                        found = page.extract_tables(table_settings=setting) if setting else page.extract_tables()
                    except Exception:
                        continue
                    out += _table_rows("first", n, k, found)
        return out

    return _each_pdf(pdf, rows_of, RAW_TABLES)


def pdf_second_tables(pdf: DataFrame, opener: Opener = second_engine) -> DataFrame:
    """Raw table rows of PDF files (path, content) by the second engine; files, pages and tables that it can't read give none."""

    def rows_of(content: bytes) -> list[tuple]:
        out = []
        try:
            opened = opener(content)
        except Exception:
            return out
        with opened as doc:
            for k, page in enumerate(doc, 1):
                try:
                    found = page.find_tables()
                except Exception:
                    continue
                read = []
                for table in getattr(found, "tables", None) or list(found):
                    try:
                        read.append(table.extract())
                    except Exception:
                        read.append([])
                out += _table_rows("second", 0, k, read)
        return out

    return _each_pdf(pdf, rows_of, RAW_TABLES)


def pdf_columns(pdf: DataFrame, opener: Opener = first_engine) -> DataFrame:
    """The texts of each page's left and right column as one raw row of engine "columns"."""

    def rows_of(content: bytes) -> list[tuple]:
        out = []
        with opener(content) as doc:
            for k, page in enumerate(doc.pages, 1):
                halves = ((0, 0, page.width * LEFT_END, page.height), (page.width * RIGHT_START, 0, page.width, page.height))
                out.append(("columns", 0, k, 0, 0, [page.crop(box).extract_text() or "" for box in halves]))
        return out

    return _each_pdf(pdf, rows_of, RAW_TABLES)


def join_pages(pages: DataFrame) -> DataFrame:
    """doc_id and the texts of its pages that aren't blank, with a blank line between. One document is one row."""
    kept = pages.where(F.trim("text") != "").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    return kept.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def _office(content: bytes, timeout: int) -> bytes | None:
    """DOCX content of a DOC file by LibreOffice; None where the worker has none, or it fails or takes too long."""
    if not (office := shutil.which("soffice")):
        return None
    with tempfile.TemporaryDirectory() as folder:  # scratch of one conversion, gone with it
        source = Path(folder) / "in.doc"
        source.write_bytes(content)
        try:
            subprocess.run([office, "--headless", "--convert-to", "docx", "--outdir", folder, str(source)], capture_output=True, timeout=timeout, check=True)
        except (subprocess.CalledProcessError, subprocess.TimeoutExpired):
            return None
        return next((p.read_bytes() for p in Path(folder).glob("*.docx")), None)


def _textutil(content: bytes, timeout: int) -> str | None:
    """Text of a DOC file by the converter that macOS brings; None where there is none or it fails."""
    if not (tool := shutil.which("textutil")):
        return None
    with tempfile.NamedTemporaryFile(suffix=".doc") as source:
        source.write(content)
        source.flush()
        try:
            return subprocess.run([tool, "-convert", "txt", "-stdout", source.name], capture_output=True, timeout=timeout, check=True).stdout.decode()
        except (subprocess.CalledProcessError, subprocess.TimeoutExpired):
            return None


def convert_doc(doc: DataFrame, timeout: int = 180) -> DataFrame:
    """DOC files (path, content) as DOCX content, by LibreOffice where the workers have it; null content where it fails."""
    ship(doc.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(path, _office(content, timeout)) for path, content in zip(frame["path"], frame["content"], strict=True)], columns=["path", "content"])

    return doc.mapInPandas(run, "path string, content binary")


def doc_texts(doc: DataFrame, timeout: int = 180) -> DataFrame:
    """doc_id, text and error of DOC files (path, content): by LibreOffice, else by textutil; each file is converted once."""
    ship(doc.sparkSession)

    def text_of(content: bytes) -> str | None:
        made = _office(content, timeout)
        return docx_text(made) if made else _textutil(content, timeout)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [text_of(content) for content in frame["content"]]
            yield pd.DataFrame({"doc_id": frame["path"], "text": texts, "error": [None if t is not None else "conversion failed" for t in texts]}, dtype=object)

    return doc.mapInPandas(run, "doc_id string, text string, error string")


#: Readers by suffix: files (path, content) to doc_id and text, and error where one can tell. More can be added.
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {".docx": docx_texts, ".doc": doc_texts, ".pdf": lambda pdf: join_pages(pdf_pages(pdf))}


def texts_of(files: DataFrame) -> DataFrame:
    """doc_id, text and error of files (path, content), each read by its suffix's reader, whatever its case. Files of no known suffix are errors."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    rows = files.withColumn("_suffix", suffix)
    null = F.lit(None).cast("string")
    out = rows.where(~F.col("_suffix").isin(*READERS)).select(F.col("path").alias("doc_id"), null.alias("text"), F.concat(F.lit("unsupported format: "), "_suffix").alias("error"))
    for name, reader in READERS.items():
        read = reader(rows.where(F.col("_suffix") == name).select("path", "content"))
        out = out.unionByName(read.select("doc_id", "text", F.col("error") if "error" in read.columns else null.alias("error")))
    return out


def _of(files: DataFrame, suffix: str) -> DataFrame:
    return files.where(F.lower("path").endswith(suffix)).select("path", "content")


def tables_of(files: DataFrame, first: Opener = first_engine, second: Opener = second_engine) -> DataFrame:
    """Raw table rows of DOCX, DOC and PDF files (path, content); of PDF files by both engines and by columns. Others give none."""
    pdf, old = _of(files, ".pdf"), convert_doc(_of(files, ".doc")).where("content IS NOT NULL")
    out = docx_tables(_of(files, ".docx").unionByName(old))
    for rows in (pdf_tables(pdf, first), pdf_second_tables(pdf, second), pdf_columns(pdf, first)):
        out = out.unionByName(rows)
    return out


def route_text(texts: DataFrame, enough: int = 500) -> DataFrame:
    """native text where it is long enough, else the OCR text (doc_id, native, ocr)."""
    return texts.select("doc_id", F.when(F.length(F.trim("native")) >= enough, F.col("native")).otherwise(F.col("ocr")).alias("text"))
