"""Column functions for names, streets, localities and cells. All of them run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

Name = Column | str


def _c(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once per row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: Name) -> Column:
    """Without white space of any kind at both ends (``trim`` only knows blanks)."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def blank(x: Name) -> Column:
    """Null as the empty string."""
    return F.coalesce(_c(x), F.lit(""))


def given(x: Name) -> Column:
    """Neither null nor empty; never null."""
    return blank(x) != ""


def squeeze(x: Name) -> Column:
    return F.regexp_replace(_c(x), r"(?U)\s+", " ")


def clean(x: Name) -> Column:
    """A cell without soft hyphens, with single blanks."""
    return strip(squeeze(F.translate(blank(x), " ­", " ")))


def normalize_street(x: Name) -> Column:
    """Lower-case street name without its type; ё stays."""
    return strip(squeeze(F.regexp_replace(strip(F.lower(blank(x))), P.STREET_TYPE, " ")))


def normalize_locality(x: Name) -> Column:
    """Lower-case locality without region and type words; the words go wherever they stand, in their fixed order."""
    out = F.regexp_replace(strip(F.lower(blank(x))), "(?U)" + P.REGION, "")
    for word in P.LOCALITY_WORDS:
        out = F.replace(out, F.lit(word), F.lit(" "))
    out = F.regexp_replace(out, "[,;]", " ")
    out = F.regexp_replace(out, r"(?U)(^|\s)[гсдп](\s)", "$1$2")
    return strip(squeeze(out))


def locality_key(x: Name) -> Column:
    return F.replace(normalize_locality(x), F.lit("ё"), F.lit("е"))


def keys_match(a: Name, b: Name) -> Column:
    """Whether two locality keys agree but for endings of up to two letters after a common start of four.

    Equal prefixes of length L = max(4, both lengths less two) say just this, so a
    match always has its first four letters in common: a lossless blocking key.
    """
    a, b = _c(a), _c(b)
    size = F.greatest(F.lit(4), F.length(a) - 2, F.length(b) - 2)
    near = (size <= F.least(F.length(a), F.length(b))) & (F.substring(a, F.lit(1), size) == F.substring(b, F.lit(1), size))
    return (a != "") & (b != "") & ((a == b) | near)


def locality_match(a: Name, b: Name) -> Column:
    return keys_match(locality_key(a), locality_key(b))


def locality_applicable(target: Name, *candidates: Name) -> Column:
    """True for an empty target or without candidates, else whether any candidate matches."""
    found = F.lit(False)
    for c in candidates:
        found |= F.coalesce(given(c) & locality_match(c, target), F.lit(False))
    none = F.lit(True)
    for c in candidates:
        none &= ~given(c)
    return ~given(target) | none | found


def street_key(x: Name) -> Column:
    """Key by which rules of two origins are told apart: ё is folded, street types stay."""
    return squeeze(F.replace(strip(F.lower(blank(x))), F.lit("ё"), F.lit("е")))


def clean_street(x: Name) -> Column:
    return strip(F.replace(F.replace(_c(x), F.lit("ул. "), F.lit("")), F.lit("пр-кт "), F.lit("")))


def street_aliases(x: Name) -> Column:
    """[main, alias] of ``Main (Alias)``, one name if both are equal but for case, none for an empty one."""
    x = _c(x)
    main, alias = strip(F.regexp_extract(x, P.ALIAS, 1)), strip(F.regexp_extract(x, P.ALIAS, 2))
    both = F.concat(F.when(main != "", F.array(main)).otherwise(empty()), F.when((alias != "") & (F.lower(alias) != F.lower(main)), F.array(alias)).otherwise(empty()))
    return F.when(~given(x), empty()).when(x.rlike(P.ALIAS), both).otherwise(F.array(strip(x)))


def empty(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def merge_cells(cells: Name) -> Column:
    """The cells of a row in one text: cleaned, without empty ones and without parts of longer ones."""
    kept = F.array_distinct(F.filter(F.transform(_c(cells), clean), lambda x: x != ""))
    whole = F.filter(kept, lambda x: ~F.exists(kept, lambda y: (y != x) & F.contains(y, x)))
    return F.array_join(whole, " ")


def is_header(cells: Name) -> Column:
    """At least two header markers in the joined lower-case row."""
    text = F.array_join(F.transform(_c(cells), lambda x: F.lower(blank(x))), " ")
    hits = F.filter(F.array(*[F.lit(m) for m in P.HEADER_MARKERS]), lambda m: F.contains(text, m))
    return F.size(hits) >= 2


def is_two_column_header(cells: Name) -> Column:
    text = F.lower(F.array_join(F.transform(_c(cells), blank), " "))
    return F.contains(text, F.lit("наименование")) & F.exists(F.array(*[F.lit(m) for m in P.TWO_COLUMN_MARKERS]), lambda m: F.contains(text, m))


def is_school_or_prefix(x: Name) -> Column:
    s = strip(blank(x))
    return s.rlike(P.SCHOOL_NAME) | s.rlike(P.SCHOOL_PREFIX)


def is_school_cell(x: Name) -> Column:
    s = strip(blank(x))
    named = s.rlike(P.SCHOOL_NAME) | (s.rlike(P.SCHOOL_PREFIX) & (F.length(s) < 250))
    return (s != "") & (F.length(s) <= 600) & ~F.contains(s, F.lit("Наименование")) & named


def is_territory(x: Name) -> Column:
    return (F.length(strip(blank(x))) >= 3) & blank(x).rlike(P.TERRITORY_MARKER)


def is_street_like(x: Name) -> Column:
    s = strip(blank(x))
    return F.length(s).between(2, 80) & ~F.lower(s).isin(*P.NOT_STREETS)


def has_digit(x: Name) -> Column:
    return blank(x).rlike(r"(?U)\d")


def is_numbered_school_row(cells: Name) -> Column:
    """A data row of a table without header: an item number, then a school."""
    cells = _c(cells)
    number, school = strip(blank(F.get(cells, F.lit(0)))), strip(blank(F.get(cells, F.lit(1))))
    return (F.size(cells) >= 4) & number.rlike(r"(?U)^\d+(\.\d+)?$") & (school != "") & is_school_or_prefix(school)


def same_school(a: Name, b: Name) -> Column:
    """Equal, one inside the other, or equal quoted names."""
    x, y = strip(blank(a)), strip(blank(b))
    qa, qb = F.regexp_extract(x, P.SCHOOL_NAME, 0), F.regexp_extract(y, P.SCHOOL_NAME, 0)
    return given(a) & given(b) & (F.contains(x, y) | F.contains(y, x) | ((qa != "") & (F.lower(qa) == F.lower(qb))))


def is_meaningful(school: Name, territory: Name) -> Column:
    return (F.length(_c(territory)) >= 10) & names_a_school(school)


def names_a_school(school: Name) -> Column:
    s = _c(school)
    return s.rlike(P.SCHOOL_NAME) | F.contains(F.lower(s), F.lit("учреждение"))


def sanitize_address(x: Name) -> Column:
    """A school's address, or null if the text is rather a territory."""
    s = strip(x)
    low = F.lower(s)
    numbers = F.regexp_count(s, F.lit(r"(?U)\d+"))
    bad = (
        (s == "") | (F.length(s) > 200) | F.contains(s, F.lit(";")) | (F.regexp_count(low, F.lit(r"ул\.")) >= 2) | F.contains(low, F.lit("мкр."))
        | (numbers > 2) | ((numbers >= 2) & ~low.rlike(P.BUILDING_MARKER) & ~low.rlike(P.GEO_MARKER))
    )
    return F.when(~bad, s)


def is_transient(error: Name) -> Column:
    low = F.lower(blank(error))
    return F.exists(F.array(*[F.lit(m) for m in P.TRANSIENT_MARKERS]), lambda m: F.contains(low, m))


def segments(text: Name, pattern: str) -> Column:
    """Matches of a one-group pattern as (name, rest): the group, and the text up to the next match.

    Matches are marked first and then split, so they stay leftmost and non-overlapping.
    """
    marked = F.regexp_replace(F.translate(_c(text), "\u0001\u0002", ""), pattern, "\u0001$1\u0002")
    parts = F.slice(F.split(marked, "\u0001"), 2, 1 << 30)
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "\u0002", 1).alias("name"), F.substring(p, F.instr(p, "\u0002") + 1, F.length(p)).alias("rest")))


def territory_rules(text: Name) -> Column:
    """(street, house_rule_raw) of a school's territory text, in order."""
    found = segments(F.regexp_replace(blank(text), P.MKR_PREFIX, " "), P.TERRITORY_STREET)
    edge = lambda s, chars: F.regexp_replace(F.regexp_replace(s, f"^[{chars}]+", ""), f"[{chars}]+$", "")
    named = F.transform(found, lambda x: F.struct(edge(x["name"], r" ,.\-").alias("street"), strip(edge(x["rest"], " ,;.")).alias("house_rule_raw")))
    return F.filter(named, lambda x: F.length(x["street"]).between(2, 80))


def split_by_size(text: Name, size: int = 4000) -> Column:
    """Slices of this many characters, stripped, empty ones dropped."""
    t = blank(text)
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(size))).otherwise(empty("int"))
    return F.filter(F.transform(starts, lambda i: strip(F.substring(t, i + 1, F.lit(size)))), lambda x: x != "")


def split_sections(text: Name) -> Column:
    """Numbered sections of more than 300 characters; slices by size if no line is a section number."""
    t = blank(text)
    marked = F.regexp_replace(F.translate(t, "\u0001", ""), P.SECTION, "\u0001$0")
    parts = F.filter(F.transform(F.slice(F.split(marked, "\u0001"), 2, 1 << 30), strip), lambda x: F.length(x) > 300)
    return F.when(t.rlike(P.SECTION), parts).otherwise(split_by_size(t))
