"""Column functions for house numbers and house rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import Name, _c, blank, empty, given, let, strip

LIMIT = 300  # houses that "all houses" stands for when rules are compared


def house_number(x: Name) -> Column:
    """The first run of digits, as an int; null if there is none."""
    return F.regexp_extract(blank(x), r"(?U)\d+", 0).try_cast("int")


def normalize_house(x: Name) -> Column:
    return strip(F.replace(F.lower(blank(x)), F.lit(" "), F.lit("")))


def number_list(x: Name) -> Column:
    """Distinct normalized items of a comma list."""
    return F.array_distinct(F.transform(F.filter(F.split(blank(x), ","), lambda i: strip(i) != ""), normalize_house))


def house_matches(house: Name, raw: Name, rule_type: Name, parity: Name, house_from: Name, house_to: Name, number: Name, numbers: Name, exceptions: Name) -> Column:
    """Whether a rule covers a house. The order of the cases is the semantics: an
    exception beats everything, "all" comes next, then lists (whatever the parity), then ranges."""
    n, target = house_number(house), normalize_house(house)
    kind, low, high = F.coalesce(_c(rule_type), F.lit("unknown")), _c(house_from), _c(house_to)
    listed = F.array_contains(F.array_union(number_list(numbers), number_list(number)), target)
    return (
        F.when(F.array_contains(number_list(exceptions), target), False)
        .when(strip(F.lower(blank(raw))).isin(*P.ALL_HOUSES) | (kind == "all"), True)
        .when(listed, True)
        .when(n.isNull(), False)
        .when((_c(parity) == "even") & (n % 2 != 0), False)
        .when((_c(parity) == "odd") & (n % 2 == 0), False)
        .when((kind == "up_to") & high.isNotNull(), n <= high)
        .when((kind == "from_to_end") & low.isNotNull(), n >= low)
        .when(low.isNotNull() & high.isNotNull(), n.between(low, high))
        .otherwise(False)
    )


def prepared_rule(raw: Name, rule_type: Name, parity: Name, house_from: Name, house_to: Name, number: Name, numbers: Name, exceptions: Name) -> Column:
    """What ``prepared_covers`` needs of a rule: lists split, wording read, and the bounds that its kind leaves open or closes."""
    kind, low, high = F.coalesce(_c(rule_type), F.lit("unknown")), _c(house_from), _c(house_to)
    up, down = (kind == "up_to") & high.isNotNull(), (kind == "from_to_end") & low.isNotNull()
    closed = low.isNotNull() & high.isNotNull()
    least = F.when(up, -1).when(down | closed, low)
    most = F.when(up, high).when(down, (1 << 31) - 1).when(closed, high)
    rest = F.when(_c(parity) == "even", 0).when(_c(parity) == "odd", 1)
    return F.struct(
        number_list(exceptions).alias("except"),
        (strip(F.lower(blank(raw))).isin(*P.ALL_HOUSES) | (kind == "all")).alias("all"),
        F.array_union(number_list(numbers), number_list(number)).alias("listed"),
        least.alias("least"), most.alias("most"), rest.alias("rest"),
    )


def prepared_covers(n: Column, target: Column, rule: Column) -> Column:
    """house_matches of a house's number and normal form, and a prepared rule."""
    inside = F.coalesce(n.between(rule["least"], rule["most"]) & (rule["rest"].isNull() | (F.abs(n % 2) == rule["rest"])), F.lit(False))
    return ~F.array_contains(rule["except"], target) & (rule["all"] | inside | F.array_contains(rule["listed"], target))


def rule_set(raw: Name, number: Name, house_from: Name, house_to: Name, parity: Name, limit: int = LIMIT) -> Column:
    """What a rule lists or spans, for comparison with other rules: listed numbers, bounds (null without a span), and the rest modulo two (null for both)."""
    low, high, every = _c(house_from).cast("long"), _c(house_to).cast("long"), F.coalesce(F.lower(blank(raw)).isin(*P.ALL_HOUSES), F.lit(False))
    listed = F.transform(F.filter(F.transform(F.split(blank(number), ","), strip), lambda i: i.rlike(r"(?U)^\d+$")), lambda i: i.try_cast("int").cast("long"))
    spans = F.coalesce(low <= high, F.lit(False))
    rest = F.when(_c(parity) == "even", 0).when(_c(parity) == "odd", 1)
    return F.struct(
        F.when(every, empty("bigint")).otherwise(F.array_distinct(listed)).alias("listed"),
        F.when(every, F.lit(1).cast("long")).when(spans, low).alias("low"), F.when(every, F.lit(limit).cast("long")).when(spans, high).alias("high"), F.when(~every, rest).alias("rest"),
    )


def spans(rule: Column, n: Column) -> Column:
    return F.coalesce(n.between(rule["low"], rule["high"]) & (rule["rest"].isNull() | (F.abs(n % 2) == rule["rest"])), F.lit(False))


def _first(low: Column, high: Column, rest: Column, count: int) -> Column:
    """The first so many numbers from low to high with this rest modulo two; no array is longer, however wide the bounds."""
    step = F.when(rest.isNull(), 1).otherwise(2).cast("long")
    start = F.when(rest.isNull() | (F.abs(low % 2) == rest), low).otherwise(low + 1)
    return F.when(F.coalesce(start <= high, F.lit(False)), F.sequence(start, F.least(high, start + step * (count - 1)), step)).otherwise(empty("bigint"))


def shared_numbers(a: Column, b: Column, count: int) -> Column:
    """The least numbers that two rule sets have in common, by their bounds; the sets are not written out."""
    both = F.array_union(F.filter(a["listed"], lambda n: F.array_contains(b["listed"], n) | spans(b, n)), F.filter(b["listed"], lambda n: spans(a, n)))
    apart = F.coalesce(a["rest"] != b["rest"], F.lit(False))
    low = F.when(a["low"].isNotNull() & b["low"].isNotNull() & ~apart, F.greatest(a["low"], b["low"]))
    return F.slice(F.array_sort(F.array_union(both, _first(low, F.least(a["high"], b["high"]), F.coalesce(a["rest"], b["rest"]), count))), 1, count)


#: House numbers that ``rule_numbers`` writes out for one span.
WIDEST = 1_000_000


def rule_numbers(raw: Name, number: Name, house_from: Name, house_to: Name, parity: Name, limit: int = LIMIT) -> Column:
    """House numbers that a rule lists or spans, written out; null if it spans more than WIDEST (``shared_numbers`` compares any)."""
    return let(rule_set(raw, number, house_from, house_to, parity, limit), lambda x: F.when(F.coalesce(x["high"] - x["low"], F.lit(0)) < WIDEST, F.array_union(x["listed"], _first(x["low"], x["high"], x["rest"], WIDEST)).cast("array<int>")))


def house_tokens(raw: Name) -> Column:
    return F.regexp_extract_all(_c(raw), F.lit(P.HOUSE_TOKEN), 0)


def detect_parity(raw: Name) -> Column:
    low = F.lower(_c(raw))
    odd = low.rlike("неч[её]т")
    even = F.regexp_replace(low, "неч[её]т", "").rlike("ч[её]т")
    return F.when(odd & even, "all").when(odd, "odd").when(even, "even")


def normalize_rule(raw: Name, parity: Name, rule_type: Name, house_from: Name, house_to: Name, numbers: Name, exceptions: Name) -> Column:
    """The rule's kind, bounds and lists as its wording says: the first pattern that matches decides.

    house_numbers and exceptions are comma lists. Bounds, lists and kind that the
    wording doesn't touch are left as they are.
    """
    low = F.lower(blank(raw))
    said, before = detect_parity(low), _c(parity)
    open_parity = F.when(said.isNotNull() & F.coalesce(before.isin("", "unknown"), F.lit(True)), said).otherwise(before)
    patched = F.when(said.isNotNull() & F.coalesce(open_parity.isin("", "unknown", "all"), F.lit(True)), said).otherwise(open_parity)
    from_house, to_house = F.regexp_extract(low, P.FROM_HOUSE, 2), F.regexp_extract(low, P.UP_TO_HOUSE, 1)
    excepted = F.regexp_extract_all(low, F.lit(P.EXCEPT_HOUSES), 1)
    first, last = F.regexp_extract(low, P.HOUSE_RANGE, 1), F.regexp_extract(low, P.HOUSE_RANGE, 2)
    tokens = house_tokens(low)
    is_from, is_to, is_except, is_range = from_house != "", to_house != "", F.size(excepted) > 0, first != ""
    is_list, is_all = (F.size(tokens) > 0) & F.contains(low, F.lit(",")), low.isin("", *P.ALL_HOUSES)
    null = F.lit(None).cast("int")

    def pick(on_from, on_to, on_except, on_range, on_list, on_all, other) -> Column:
        return F.when(is_from, on_from).when(is_to, on_to).when(is_except, on_except).when(is_range, on_range).when(is_list, on_list).when(is_all, on_all).otherwise(other)

    hf, ht, kind, nums, exc = (_c(x) for x in (house_from, house_to, rule_type, numbers, exceptions))
    except_list = F.array_join(F.flatten(F.transform(excepted, house_tokens)), ",")
    return F.struct(
        pick(F.lit("from_to_end"), F.lit("up_to"), F.lit("all_except"), F.lit("range"), F.lit("exact_list"), F.lit("all"), kind).alias("rule_type"),
        pick(patched, patched, open_parity, patched, open_parity, open_parity, open_parity).alias("parity"),
        pick(from_house.try_cast("int"), null, hf, first.try_cast("int"), null, hf, hf).alias("house_from"),
        pick(null, to_house.try_cast("int"), ht, last.try_cast("int"), null, ht, ht).alias("house_to"),
        pick(nums, nums, nums, nums, F.array_join(tokens, ","), nums, nums).alias("house_numbers"),
        pick(exc, exc, except_list, exc, exc, exc, exc).alias("exceptions"),
    )


def split_houses(x: Name) -> Column:
    return F.filter(F.transform(F.split(blank(x), "[;,]"), strip), lambda i: i != "")


def is_range(item: Name) -> Column:
    return _c(item).rlike(P.WHOLE_RANGE)


def houses_to_rules(houses: Name) -> Column:
    """One exact-list rule for the single houses of a cell, and one range rule for each of its ranges."""
    houses = _c(houses)
    items = split_houses(houses)
    exact, ranges = F.filter(items, lambda i: ~is_range(i)), F.filter(items, is_range)
    bound = lambda i, k: F.regexp_extract(i, P.WHOLE_RANGE, k).try_cast("int")
    rule = lambda raw, lo, hi, num, kind: F.struct(raw.alias("house_rule_raw"), lo.alias("house_from"), hi.alias("house_to"), num.alias("house_number"), F.lit(kind).alias("rule_type"))
    null = F.lit(None).cast("int")
    one = F.array(rule(houses, null, null, F.array_join(exact, ","), "exact_list"))
    many = F.transform(ranges, lambda i: rule(F.concat_ws("-", bound(i, 1), bound(i, 2)), bound(i, 1), bound(i, 2), F.lit(None).cast("string"), "range"))
    return F.concat(F.when(F.size(exact) > 0, one).otherwise(F.slice(one, 1, 0)), many)


def normalize_parity(x: Name) -> Column:
    return F.when(_c(x).isin(*P.PARITIES), _c(x)).otherwise("unknown")


def normalize_rule_type(x: Name) -> Column:
    return F.when(_c(x).isin(*P.RULE_TYPES), _c(x)).otherwise("unknown")


def normalize_int(x: Name) -> Column:
    """Strings of digits only; signs and fractions give null."""
    s = strip(x)
    return F.when(s.rlike(r"(?U)^\d+$"), s.try_cast("int"))


def normalize_list(items: Name) -> Column:
    """An array as a comma list, blank items left out; null if nothing is left."""
    return F.nullif(F.array_join(F.filter(F.transform(_c(items), strip), lambda i: i != ""), ","), F.lit(""))


def is_droppable(street: Name, raw: Name, number: Name, house_from: Name, house_to: Name, rule_type: Name) -> Column:
    """A rule without street, or without any description of houses that isn't about all of them."""
    none = ~given(strip(blank(raw))) & ~given(number) & (F.coalesce(_c(house_from), F.lit(0)) == 0) & (F.coalesce(_c(house_to), F.lit(0)) == 0)
    return (strip(blank(street)) == "") | (none & (F.coalesce(_c(rule_type), F.lit("")) != "all"))
