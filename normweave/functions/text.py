"""Scalar functions on text, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import EXPRESSION_SYMBOLS, FORMULA_SYMBOLS, FUNCTION_NAMES, ID, NUM, OPERATORS, QUANTITIES, UNIT_SYMBOLS, VALUE_UNIT


def strip(c) -> Column:
    """All white space at both ends (trim takes spaces only)."""
    return F.regexp_replace(c, r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$", "")


def swap(c: Column, pairs) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def numeric(c: Column) -> Column:
    """The number that a string spells, else null; forms such as 12d and 5f, which a cast takes, are none."""
    c = strip(c)
    return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), c.try_cast("double"))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]+"), strip), lambda s: s != "")


def non_blank_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end>> of the matches (code points, end exclusive): the gaps between matches give the places."""
    found, gaps = extract_all(text, pattern), F.split(text, pattern, -1)

    def step(acc, x):
        start = acc["pos"] + F.char_length(F.get(gaps, F.size(acc["out"])))
        end = start + F.char_length(x)
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    first = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(found, first, step, lambda acc: acc["out"])


def normalized_formula(raw: Column) -> Column:
    return strip(swap(F.regexp_replace(raw, r"\s+", " "), FORMULA_SYMBOLS))


def formula_type(raw: Column) -> Column:
    return (
        F.when(raw.rlike("[<>≤≥]"), "inequality")
        .when(F.contains(raw, F.lit("=")) & raw.rlike(r"\d+\s*[×*]\s*\d+"), "calculation")
        .when(F.contains(raw, F.lit("=")), "equation")
        .when(F.contains(F.lower(raw), F.lit("is defined as")), "definition")
        .otherwise("reference")
    )


def formula_variables(normal: Column) -> Column:
    names = F.array(*map(F.lit, FUNCTION_NAMES))
    return F.array_distinct(F.filter(extract_all(normal, ID), lambda v: ~F.array_contains(names, F.lower(v))))


def formula_operators(normal: Column) -> Column:
    return F.filter(F.array(*map(F.lit, OPERATORS)), lambda o: F.contains(normal, o))


def calculation_parts(normal: Column) -> Column:
    """struct<left, op, right, result> of a numeric product, null if there is none."""
    pattern = rf"({NUM})\s*([*/+-])\s*({NUM})\s*=\s*({NUM})"
    part = lambda i: F.regexp_extract(normal, pattern, i)
    return F.when(normal.rlike(pattern), F.struct(part(1).try_cast("double").alias("left"), part(2).alias("op"), part(3).try_cast("double").alias("right"), part(4).try_cast("double").alias("result")))


def value_and_unit(text: Column) -> Column:
    """struct<num, unit, str>: the first number and the unit after it; without a number the stripped text."""
    has = text.rlike(VALUE_UNIT)
    unit = F.nullif(F.regexp_extract(text, VALUE_UNIT, 2), F.lit(""))
    return F.struct(F.when(has, F.regexp_extract(text, VALUE_UNIT, 1).try_cast("double")).alias("num"), F.when(has, unit).alias("unit"), F.when(~has, strip(text)).alias("str"))


def quantity(text: Column) -> Column:
    """struct<value, unit> of the first quantity in a text, else null."""
    one = lambda p: F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).try_cast("double").alias("value"), strip(F.regexp_extract(text, p, 2)).alias("unit")))
    return F.coalesce(*map(one, QUANTITIES))


def clean_expression(text: Column) -> Column:
    return strip(F.regexp_replace(swap(text, EXPRESSION_SYMBOLS), r"\s+", " "))


def normalized_unit(unit: Column, aliases: dict[str, str]) -> Column:
    unit = strip(unit)
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(table[unit], swap(unit, UNIT_SYMBOLS))


def section_key(number: Column) -> Column:
    """Sort key of a section number: its runs of digits as integers; arrays compare in order."""
    return F.transform(extract_all(number, r"\d+"), lambda x: x.try_cast("int"))


def slug(label: Column) -> Column:
    return F.concat(F.lit("concept_"), F.replace(F.lower(label), F.lit(" "), F.lit("_")))


def preview(text: Column, size: int = 200) -> Column:
    return F.when(F.char_length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def title(text: Column) -> Column:
    """Of the first ten lines, the first of over ten characters that does not begin with a digit."""
    lines = F.slice(F.split(strip(text), "\n"), 1, 10)
    good = F.filter(F.transform(lines, strip), lambda s: (F.char_length(s) > 10) & ~s.rlike(r"^\d"))
    return F.coalesce(F.get(good, F.lit(0)), F.lit("Untitled Document"))


def joined_map(entries: Column, later: Column) -> Column:
    """Union of two maps, the later one winning (map_concat fails on a common key)."""
    return F.map_concat(F.map_filter(entries, lambda k, _: ~F.array_contains(F.map_keys(later), k)), later)
