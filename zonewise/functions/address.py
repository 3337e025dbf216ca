"""Free addresses as columns: a fold over the parts between commas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import Name, blank, given, strip


def _drop_first(x: Column, marker: str) -> Column:
    """x without the first match of a marker."""
    flags = marker[: marker.index(")") + 1]
    return strip(F.regexp_replace(strip(x), f"{flags[:-1]}s)^(.*?)(?:{marker[len(flags) :]})(.*)$".replace("\\b(", "\\b(?:"), "$1$2"))


def parse_address(address: Name) -> Column:
    """STRUCT<city, street, house>; what isn't found is null.

    Each part is judged in this order: region (skipped), house, district
    (skipped), street (the last one stays), locality (the first one stays), bare
    name (locality, then street).
    """
    text = blank(address)
    parts = F.filter(F.transform(F.split(text, r"[,\n]"), strip), lambda p: p != "")
    state = lambda city, street, house: F.struct(city.alias("city"), street.alias("street"), house.alias("house"))

    def step(acc: Column, p: Column) -> Column:
        city, street, house = acc["city"], acc["street"], acc["house"]
        is_house = p.rlike(P.PART_HOUSE) | p.rlike(P.BARE_HOUSE)
        return (
            F.when(p.rlike(P.PART_REGION), acc)
            .when(is_house, state(city, street, F.when(house == "", _drop_first(p, P.PART_HOUSE)).otherwise(house)))
            .when(p.rlike(P.PART_DISTRICT), acc)
            .when(p.rlike(P.PART_STREET), state(city, _drop_first(p, P.PART_STREET), house))
            .when(p.rlike(P.PART_LOCALITY), state(F.when(city == "", _drop_first(p, P.PART_LOCALITY)).otherwise(city), street, house))
            .when(city == "", state(p, street, house))
            .when(street == "", state(city, p, house))
            .otherwise(acc)
        )

    none = F.lit("")

    def finish(acc: Column) -> Column:
        city, street, house = acc["city"], acc["street"], acc["house"]
        moved = (street == "") & city.rlike(r"(?U)\s+\d")
        city, street = F.when(moved, "").otherwise(city), F.when(moved, city).otherwise(street)
        tail = F.regexp_extract(street, P.TRAILING_HOUSE, 1)
        cut = (house == "") & (tail != "")
        null = lambda x: F.when(given(x), x)
        return F.struct(null(city).alias("city"), null(F.when(cut, strip(F.regexp_replace(street, P.TRAILING_HOUSE, ""))).otherwise(street)).alias("street"), null(F.when(cut, tail).otherwise(house)).alias("house"))

    return F.aggregate(parts, state(none, none, none), step, finish)
