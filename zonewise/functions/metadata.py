"""Number, date and municipality of a decree from the head of its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import Name, blank, let, strip

HEAD, BEFORE, AFTER = 3000, 150, 30


def head(text: Name) -> Column:
    return F.substring(blank(text), 1, HEAD)


def own_matches(text: Name, pattern: str) -> Column:
    """Matches in the head that don't stand near words of laws, orders or repealed decrees."""
    return let(F.translate(head(text), "\u0001\u0002", ""), lambda h: _own_matches(h, pattern))


def _own_matches(h: Column, pattern: str) -> Column:
    pieces = F.split(F.regexp_replace(h, pattern, "\u0001$0\u0002"), "\u0001")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,hit:string>>").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        closed = F.contains(p, F.lit("\u0002"))
        hit = F.substring_index(p, "\u0002", 1)
        size = F.length(p) - F.when(closed, 1).otherwise(0)
        found = F.when(closed, F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), hit.alias("hit"))))).otherwise(acc["found"])
        return F.struct((acc["at"] + size).alias("at"), found.alias("found"))

    def own(m: Column) -> Column:
        begin = F.greatest(m["start"] - BEFORE, F.lit(0))
        return ~F.substring(h, begin + 1, m["start"] + F.length(m["hit"]) + AFTER - begin).rlike(P.FOREIGN_CONTEXT)

    found = F.aggregate(pieces, start, step, lambda acc: acc["found"])
    # texts without a match, the greater part of most heads, don't enter the fold
    return F.when(h.rlike(pattern), F.transform(F.filter(found, own), lambda m: m["hit"])).otherwise(F.array().cast("array<string>"))


def decree_number(text: Name) -> Column:
    """The first own number, or the empty string."""
    number = F.regexp_extract(blank(F.get(own_matches(text, P.DECREE_NUMBER), F.lit(0))), P.DECREE_NUMBER, 1)
    return F.regexp_replace(F.regexp_replace(number, r"^[.\-/]+", ""), r"[.\-/]+$", "")


def _pad(x: Column, n: int) -> Column:
    return F.when(F.length(x) < n, F.lpad(x, n, "0")).otherwise(x)


def _figures(hit: Column) -> Column:
    part = lambda k: F.regexp_extract(hit, P.DATE_NUMERIC, k)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    return F.when(hit.isNotNull(), F.concat_ws(".", _pad(part(1), 2), _pad(part(2), 2), _pad(year, 4)))


def _words(hit: Column) -> Column:
    name = F.lower(F.regexp_extract(hit, P.DATE_TEXT, 2))
    month = F.lit("")
    for stem, number in reversed(P.MONTHS):
        month = F.when(name.startswith(stem), f"{number:02}").otherwise(month)
    return F.when(hit.isNotNull(), F.concat_ws(".", _pad(F.regexp_extract(hit, P.DATE_TEXT, 1), 2), month, F.regexp_extract(hit, P.DATE_TEXT, 3)))


def decree_date(text: Name) -> Column:
    """dd.MM.yyyy: the first own date in figures, else the first own one in words, else the empty string. No calendar check."""
    first = lambda pattern: F.get(own_matches(text, pattern), F.lit(0))
    return F.coalesce(let(first(P.DATE_NUMERIC), _figures), let(first(P.DATE_TEXT), _words), F.lit(""))


def municipality(text: Name) -> Column:
    return strip(F.regexp_extract(head(text), P.MUNICIPALITY, 1))


def decree_metadata(text: Name) -> Column:
    return F.struct(decree_number(text).alias("number"), decree_date(text).alias("date"), municipality(text).alias("municipality"))
