"""Calculations whose expressions, equations and units are data: a row each, in Arrow batches, without eval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr, units

_RESULT = "result struct<numeric:double,error:string>"


def _by_row(rows: DataFrame, asked: list, one: Callable[..., float | None]) -> DataFrame:
    """The rows plus ``result``: what one gives for the values of asked, or the error that it raises."""
    names = [c for c in rows.columns if c != "result"]
    kept = rows.select(*[F.col(f"`{c}`") for c in names], F.struct(*[a.alias(f"x{i}") for i, a in enumerate(asked)]).alias("__asked"))
    schema = rows.select(*[F.col(f"`{c}`") for c in names]).withColumn("result", F.lit(None).cast(_RESULT.split(" ", 1)[1])).schema
    kind = pa.struct([("numeric", pa.float64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(b.num_columns - 1).to_pylist():
                try:
                    got = one(*x.values())
                    out.append({"numeric": None if got is None else float(got), "error": None})
                except (ValueError, ArithmeticError, KeyError, TypeError) as e:
                    out.append({"numeric": None, "error": str(e)})
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, kind)], [*b.schema.names[:-1], "result"])

    return kept.mapInArrow(run, schema)


def _known(pairs) -> dict:
    return {k: v for k, v in pairs or [] if v is not None}


def calculate_rows(rows: DataFrame, expression: str = "expression", known: str = "known") -> DataFrame:
    """The rows plus ``result``: the value of each expression under a map<string,double>.  A free variable gives neither value nor error."""

    def one(text, pairs):
        got = expr.calculate(text or "", _known(pairs))
        if got["error"]:
            raise expr.ExpressionError(got["error"])
        return got["numeric"]

    return _by_row(rows, [F.col(expression), F.col(known)], one)


def solve_rows(rows: DataFrame, equation: str = "equation", unknown: str = "unknown", known: str = "known") -> DataFrame:
    """The rows plus ``result``: the unknown of each equation."""
    return _by_row(rows, [F.col(equation), F.col(unknown), F.col(known)], lambda text, name, pairs: expr.solve(text or "", name, _known(pairs)))


def calculate_units_rows(rows: DataFrame, expression: str = "expression", quantities: str = "quantities") -> DataFrame:
    """The rows plus ``result``: the value in base units of each expression over a map<string,struct<value,unit>>; none where dimensions do not fit."""

    def one(text, pairs):
        got = units.calculate_with_units(text or "", {k: (v["value"], v["unit"]) for k, v in pairs or []})
        if got is None:
            raise units.UnitError("units do not fit")
        return got[0]

    return _by_row(rows, [F.col(expression), F.col(quantities)], one)


def performed(intents: DataFrame) -> DataFrame:
    """(q_id, pos, expression, result): the calculations that intents (q_id, required_calculations, parameters) ask for; failing ones are left out."""
    asked = intents.select("q_id", "parameters", F.posexplode("required_calculations").alias("pos", "expression"))
    out = calculate_rows(asked, "expression", "parameters").where("result.error IS NULL")
    return out.select("q_id", "pos", "expression", F.col("result.numeric").alias("result"))
