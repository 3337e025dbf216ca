"""Model replies: JSON repair, parsing and coercion. Replies come as a table; no model is called here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .houses import normalize_parity
from .text import Name, _c, blank, let, strip

RULE = "STRUCT<locality: STRING, street: STRING, house_rule_raw: STRING, parity: STRING, house_from: STRING, house_to: STRING, house_number: STRING, comment: STRING>"
DECREE = f"decree STRUCT<number: STRING, date: STRING, municipality: STRING>, schools ARRAY<STRUCT<name: STRING, address: STRING, rules: ARRAY<{RULE}>>>"
TERRITORY = f"rules ARRAY<{RULE}>"
CLASS = "document_type STRING, confidence DOUBLE, reason STRING"


def json_block(reply: Name) -> Column:
    """The text from the first to the last brace, fences dropped; null without braces."""
    s = F.replace(F.replace(strip(blank(reply)), F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    block = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.when(block != "", block)


def json_repair(reply: Name) -> Column:
    """json_block without commas before closing braces and brackets."""
    return F.regexp_replace(F.regexp_replace(json_block(reply), r"(?U),\s*}", "}"), r"(?U),\s*]", "]")


def list_text(x: Name) -> Column:
    """house_number: a JSON list becomes a comma list, an object stays JSON, a blank becomes null."""

    def joined(items: Column) -> Column:
        return F.array_join(F.filter(items, lambda i: i.isNotNull() & (strip(i) != "")), ",")

    s = strip(x)
    out = F.when(s.startswith("["), F.coalesce(joined(F.from_json(s, "array<string>")), s)).otherwise(s)
    return F.nullif(out, F.lit(""))


def digits_or_null(x: Name) -> Column:
    """Bounds as read into strings, where a JSON number and a string of digits look alike."""
    s = strip(x)
    return F.when(s.rlike(r"(?U)^-?\d+$"), s.try_cast("int"))


def coerce_rule(r: Column) -> Column:
    """A rule with the types of the engine: text never null, parity in its domain, bounds whole numbers or null."""
    text = lambda k: strip(blank(r[k])).alias(k)
    return F.struct(text("locality"), text("street"), text("house_rule_raw"), normalize_parity(r["parity"]).alias("parity"), digits_or_null(r["house_from"]).alias("house_from"), digits_or_null(r["house_to"]).alias("house_to"), list_text(r["house_number"]).alias("house_number"), text("comment"))


def _rules(rules: Column) -> Column:
    return F.transform(F.coalesce(rules, F.array().cast(f"array<{RULE}>")), coerce_rule)


def _when_json(block: Column, schema: str, body) -> Column:
    """body of the parsed block; null if the block isn't JSON. The block is repaired and parsed once."""
    return let(block, lambda j: F.when(is_json(j), let(F.from_json(j, schema), body)))


def parse_decree(reply: Name) -> Column:
    """STRUCT<decree, schools> of a reply about a whole decree; null if it isn't a JSON object."""
    text = lambda s, k: strip(blank(s[k])).alias(k)

    def body(x: Column) -> Column:
        decree = F.struct(text(x["decree"], "number"), text(x["decree"], "date"), text(x["decree"], "municipality"))
        schools = F.transform(F.coalesce(x["schools"], F.array().cast(f"array<STRUCT<name: STRING, address: STRING, rules: ARRAY<{RULE}>>>")), lambda s: F.struct(text(s, "name"), text(s, "address"), _rules(s["rules"]).alias("rules")))
        return F.struct(decree.alias("decree"), schools.alias("schools"))

    return _when_json(json_repair(reply), DECREE, body)


def parse_territory(reply: Name) -> Column:
    """Rules of a reply about one school; null if it isn't a JSON object."""
    return _when_json(json_repair(reply), TERRITORY, lambda x: _rules(x["rules"]))


def parse_class(reply: Name) -> Column:
    """STRUCT<document_type, confidence, reason>; commas are not repaired here."""
    return F.when(is_json(json_block(reply)), F.from_json(json_block(reply), CLASS))


def is_json(x: Name) -> Column:
    return F.try_parse_json(_c(x)).isNotNull()


def error_of(reply: Name) -> Column:
    """Why a reply can't be used; null if it can."""
    return F.when(json_block(reply).isNull(), "no_json").when(~is_json(json_repair(reply)), F.concat(F.lit("bad_json: "), F.substring(json_repair(reply), 1, 300)))


def ocr_text(response: Name) -> Column:
    """Text of an OCR service's JSON response: the parsed texts with a blank line between; null if it reports an error."""
    x = F.from_json(_c(response), "IsErroredOnProcessing BOOLEAN, ParsedResults ARRAY<STRUCT<ParsedText: STRING>>")
    texts = F.filter(F.transform(F.coalesce(x["ParsedResults"], F.array().cast("array<struct<ParsedText:string>>")), lambda r: r["ParsedText"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.when(~F.coalesce(x["IsErroredOnProcessing"], F.lit(False)), strip(F.array_join(texts, "\n\n")))


def prompt(template: str, text: Name, limit: int) -> Column:
    """A prompt template with the head of a text in place of ``{text}``."""
    return F.replace(F.lit(template), F.lit("{text}"), F.substring(blank(text), 1, limit))
