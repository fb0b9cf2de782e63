"""Formulas and definitions of variables in text: (doc_id, text) in, rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import DEFINITIONS, FORMULAS
from ..functions.text import calculation_parts, extract_all, formula_operators, formula_type, formula_variables, match_spans, normalized_formula, strip


def _numbered(k: int):
    return lambda m, i: F.struct(F.lit(k).alias("pattern"), i.alias("pos"), m.alias("raw_text"))


def formulas(docs: DataFrame) -> DataFrame:
    """(doc_id, formula_no, line_no, raw_text, normalized_text, formula_type, variables, operators, context).

    All matches of all patterns on each line, in the order line, pattern, position; ordinals replace random ids.
    """
    lines = F.split("text", "\n")
    rows = docs.select("doc_id", lines.alias("lines"), F.posexplode(lines).alias("line_no", "line"))
    hits = F.concat(*[F.transform(extract_all(F.col("line"), p), _numbered(k)) for k, p in enumerate(FORMULAS)])
    rows = rows.select("doc_id", "line_no", line_context("lines", "line_no").alias("context"), F.explode(hits).alias("m")).select("doc_id", "line_no", "context", "m.*")
    rows = rows.withColumn("raw_text", strip("raw_text")).withColumn("normalized_text", normalized_formula(F.col("raw_text")))
    w = Window.partitionBy("doc_id").orderBy("line_no", "pattern", "pos")
    normal = F.col("normalized_text")
    return rows.select("doc_id", F.row_number().over(w).alias("formula_no"), "line_no", "pattern", "raw_text", "normalized_text", formula_type(F.col("raw_text")).alias("formula_type"), formula_variables(normal).alias("variables"), formula_operators(normal).alias("operators"), "context")


def line_context(lines: str, at: str, around: int = 2):
    """The lines around a line, blank ones included."""
    first = F.greatest(F.col(at) + 1 - around, F.lit(1))
    return F.array_join(F.slice(lines, first, F.col(at) + 1 + around - first + 1), "\n")


def formula_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern, start, end) of the formulas of each pattern in the text."""
    return docs.select("doc_id", F.posexplode(F.array(*[match_spans(F.col("text"), p) for p in FORMULAS])).alias("pattern", "spans")).select("doc_id", "pattern", F.explode("spans").alias("s")).select("doc_id", "pattern", "s.*")


def variable_definitions(docs: DataFrame) -> DataFrame:
    """(doc_id, symbol, name, unit, ord): the first definition of each symbol, in the order pattern, position."""
    def rows(k: int, p: str):
        groups = [extract_all(F.col("text"), p, g) for g in ((1, 2, 3) if p.count("([^)]+)") and p.count("([^(]+)") else (1, 2))]
        unit = groups[2] if len(groups) == 3 else F.transform(groups[0], lambda _: F.lit(None).cast("string"))
        return F.transform(F.arrays_zip(groups[0].alias("s"), groups[1].alias("d"), unit.alias("u")), lambda x, i: F.struct(F.struct(F.lit(k).alias("pattern"), i.alias("pos")).alias("ord"), x["s"].alias("symbol"), x["d"].alias("name"), x["u"].alias("unit")))

    out = docs.select("doc_id", F.explode(F.concat(*[rows(k, p) for k, p in enumerate(DEFINITIONS)])).alias("d")).select("doc_id", "d.*")
    out = out.withColumn("name", strip("name"))
    tail = F.regexp_extract("name", r"\(([^)]+)\)$", 1)
    unit = F.coalesce("unit", F.nullif(tail, F.lit("")))
    name = F.when(F.col("unit").isNull() & (tail != ""), strip(F.regexp_replace("name", r"\s*\([^)]+\)$", ""))).otherwise(F.col("name"))
    out = out.select("doc_id", "symbol", name.alias("name"), unit.alias("unit"), "ord")
    w = Window.partitionBy("doc_id", "symbol").orderBy("ord")
    return out.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def with_definitions(found: DataFrame, definitions: DataFrame) -> DataFrame:
    """(doc_id, formula_no, var_defs): each formula's variables that are defined in the text."""
    one = found.select("doc_id", "formula_no", F.explode("variables").alias("symbol")).join(definitions, ["doc_id", "symbol"])
    return one.groupBy("doc_id", "formula_no").agg(F.map_from_entries(F.collect_list(F.struct("symbol", F.struct("name", "unit")))).alias("var_defs"))


def shared_variables(found: DataFrame) -> DataFrame:
    """(doc_id, a, b, variable): formulas a < b of a document that share a variable."""
    v = found.select("doc_id", F.col("formula_no"), F.explode("variables").alias("variable"))
    a, b = v.withColumnRenamed("formula_no", "a"), v.withColumnRenamed("formula_no", "b")
    return a.join(b, ["doc_id", "variable"]).where("a < b").select("doc_id", "a", "b", "variable")


def dependencies(found: DataFrame) -> DataFrame:
    """(doc_id, formula_no, depends_on): sorted set of formulas that share any variable."""
    pairs = shared_variables(found)
    both = pairs.select("doc_id", F.col("a").alias("formula_no"), F.col("b").alias("other")).unionByName(pairs.select("doc_id", F.col("b").alias("formula_no"), F.col("a").alias("other")))
    return both.groupBy("doc_id", "formula_no").agg(F.array_sort(F.collect_set("other")).alias("depends_on"))


def parsed_calculations(found: DataFrame) -> DataFrame:
    out = found.where("formula_type = 'calculation'").withColumn("c", calculation_parts(F.col("normalized_text")))
    return out.where("c IS NOT NULL").select("doc_id", "formula_no", "c.*")


def by_variable(found: DataFrame) -> DataFrame:
    """(doc_id, variable, formulas)."""
    v = found.select("doc_id", "formula_no", F.explode("variables").alias("variable"))
    return v.groupBy("doc_id", "variable").agg(F.array_sort(F.collect_list("formula_no")).alias("formulas"))
