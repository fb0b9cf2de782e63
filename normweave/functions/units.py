"""Units as exponent vectors over nine base dimensions, with factor and offset to the base unit."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = ["length", "mass", "time", "current", "temperature", "substance", "luminosity", "occupancy", "vehicle"]


def _v(**e: int) -> tuple[int, ...]:
    return tuple(e.get(d, 0) for d in DIMENSIONS)


#: Names, factor to the base unit, offset, dimensions.
_UNITS = [
    ("meter metre m meters metres", 1.0, 0, _v(length=1)),
    ("millimeter mm millimeters", 1e-3, 0, _v(length=1)),
    ("centimeter cm centimeters", 1e-2, 0, _v(length=1)),
    ("kilometer km kilometers", 1e3, 0, _v(length=1)),
    ("inch in inches", 0.0254, 0, _v(length=1)),
    ("foot ft feet", 0.3048, 0, _v(length=1)),
    ("yard yd yards", 0.9144, 0, _v(length=1)),
    ("mile mi miles", 1609.344, 0, _v(length=1)),
    ("kilogram kg kilograms", 1.0, 0, _v(mass=1)),
    ("gram g grams", 1e-3, 0, _v(mass=1)),
    ("pound lb pounds", 0.45359237, 0, _v(mass=1)),
    ("tonne t", 1e3, 0, _v(mass=1)),
    ("second s sec seconds", 1.0, 0, _v(time=1)),
    ("minute min minutes", 60.0, 0, _v(time=1)),
    ("hour h hr hours", 3600.0, 0, _v(time=1)),
    ("day d days", 86400.0, 0, _v(time=1)),
    ("kelvin K", 1.0, 0, _v(temperature=1)),
    ("degree_C celsius degC", 1.0, 273.15, _v(temperature=1)),
    ("degree_F fahrenheit degF", 5 / 9, 459.67 * 5 / 9, _v(temperature=1)),
    ("ampere A", 1.0, 0, _v(current=1)),
    ("mole mol", 1.0, 0, _v(substance=1)),
    ("candela cd", 1.0, 0, _v(luminosity=1)),
    ("liter litre L l liters", 1e-3, 0, _v(length=3)),
    ("gallon gallons", 0.003785411784, 0, _v(length=3)),
    ("newton N", 1.0, 0, _v(mass=1, length=1, time=-2)),
    ("pound_force lbf", 4.4482216152605, 0, _v(mass=1, length=1, time=-2)),
    ("pascal Pa", 1.0, 0, _v(mass=1, length=-1, time=-2)),
    ("kilopascal kPa", 1e3, 0, _v(mass=1, length=-1, time=-2)),
    ("bar", 1e5, 0, _v(mass=1, length=-1, time=-2)),
    ("joule J", 1.0, 0, _v(mass=1, length=2, time=-2)),
    ("watt W", 1.0, 0, _v(mass=1, length=2, time=-3)),
    ("kilowatt kW", 1e3, 0, _v(mass=1, length=2, time=-3)),
    ("people person persons", 1.0, 0, _v(occupancy=1)),
    ("car cars vehicle vehicles", 1.0, 0, _v(vehicle=1)),
    ("ACH air_changes_per_hour", 1 / 3600, 0, _v(time=-1)),
    ("cubic_feet cubic_foot", 0.3048**3, 0, _v(length=3)),
    ("dimensionless", 1.0, 0, _v()),
]
UNITS = {n: (f, o, v) for names, f, o, v in _UNITS for n in names.split()}
#: Other spellings.
ALIASES = {"cfm": "cubic_feet/minute", "gpm": "gallons/minute", "psi": "pound_force/inch**2", "psf": "pound_force/foot**2", "mph": "miles/hour", "kph": "kilometers/hour", "sqft": "foot**2", "sqm": "meter**2", "cuft": "foot**3", "cum": "meter**3", "L/s": "liter/second", "m³/h": "meter**3/hour", "m³/hour": "meter**3/hour", "m3/h": "meter**3/hour", "m3/hour": "meter**3/hour", "L/s/person": "liter/second/person", "m³/h/car": "meter**3/hour/car"}
#: Categories by dimensions, and units that suit them.
CATEGORIES = {
    "length": _v(length=1), "area": _v(length=2), "volume": _v(length=3), "mass": _v(mass=1), "time": _v(time=1), "temperature": _v(temperature=1), "velocity": _v(length=1, time=-1),
    "acceleration": _v(length=1, time=-2), "force": _v(mass=1, length=1, time=-2), "pressure": _v(mass=1, length=-1, time=-2), "energy": _v(mass=1, length=2, time=-2), "power": _v(mass=1, length=2, time=-3),
    "flow_rate_volume": _v(length=3, time=-1), "flow_rate_mass": _v(mass=1, time=-1),
}
SUGGESTIONS = {"length": ["meter", "foot", "inch", "kilometer", "mile"], "area": ["meter**2", "foot**2"], "volume": ["meter**3", "liter", "gallon", "foot**3"], "mass": ["kilogram", "gram", "pound"], "time": ["second", "minute", "hour", "day"], "temperature": ["degree_C", "degree_F", "kelvin"], "flow_rate_volume": ["meter**3/hour", "liter/second", "cubic_feet/minute", "gallons/minute"]}
_TERM = re.compile(r"\s*([*/])?\s*([^\W\d]\w*|\d+(?:\.\d+)?)\s*(?:(?:\*\*|\^)\s*(-?\d+))?")


class UnitError(ValueError):
    pass


def normalized(unit: str) -> str:
    unit = unit.strip()
    return ALIASES.get(unit) or unit.replace("²", "**2").replace("³", "**3").replace("°", "degree_")


def parsed(unit: str) -> tuple[float, float, tuple[int, ...]]:
    """(factor, offset, dimensions) of a unit expression."""
    text, at, factor, offset, dims, terms = normalized(unit), 0, 1.0, 0.0, [0] * len(DIMENSIONS), 0
    while at < len(text):
        m = _TERM.match(text, at)
        if not m or (terms and not m[1]):
            raise UnitError(f"'{unit}' is not defined in the unit registry")
        sign = (-1 if m[1] == "/" else 1) * int(m[3] or 1)
        if m[2][0].isdigit():
            factor *= float(m[2]) ** sign
        elif m[2] in UNITS:
            f, o, v = UNITS[m[2]]
            factor *= f**sign
            offset = o
            dims = [a + sign * b for a, b in zip(dims, v)]
        else:
            raise UnitError(f"'{m[2]}' is not defined in the unit registry")
        terms += 1
        at = m.end()
        if text[at:].strip() == "":
            break
    return factor, offset if terms == 1 and sign == 1 else 0.0, tuple(dims)


def convert(value: float, source: str, target: str) -> dict:
    """converted, magnitude_change, dimension and error of one quantity."""
    try:
        (f1, o1, v1), (f2, o2, v2) = parsed(source), parsed(target)
    except UnitError as e:
        return {"converted": 0.0, "magnitude_change": 0.0, "dimension": None, "error": f"Undefined unit: {e}"}
    if v1 != v2:
        return {"converted": 0.0, "magnitude_change": 0.0, "dimension": None, "error": f"Incompatible units: {source} and {target}"}
    out = (value * f1 + o1 - o2) / f2
    return {"converted": out, "magnitude_change": out / value if value else 0.0, "dimension": category(source), "error": None}


def convert_column(value: Column, source: str, target: str) -> Column:
    """A column of quantities, with the factors folded into the plan."""
    (f1, o1, v1), (f2, o2, v2) = parsed(source), parsed(target)
    if v1 != v2:
        raise UnitError(f"Incompatible units: {source} and {target}")
    return (value * F.lit(f1) + F.lit(o1 - o2)) / F.lit(f2)


def unit_table(spark, units: list[str]):
    """(unit, factor, offset, dims, category) for a join; null factors where a unit is unknown."""
    rows = []
    for u in units:
        try:
            f, o, v = parsed(u)
            rows.append((u, float(f), float(o), list(v), category(u)))
        except UnitError:
            rows.append((u, None, None, None, None))
    return spark.createDataFrame(rows, "unit string, factor double, offset double, dims array<int>, category string")


def convert_rows(rows, units):
    """rows (value, from_unit, to_unit, ...) with ``converted`` and ``error``, by two joins with the small unit table."""
    a = F.broadcast(units.select(F.col("unit").alias("from_unit"), F.col("factor").alias("f1"), F.col("offset").alias("o1"), F.col("dims").alias("d1")))
    b = F.broadcast(units.select(F.col("unit").alias("to_unit"), F.col("factor").alias("f2"), F.col("offset").alias("o2"), F.col("dims").alias("d2")))
    out = rows.join(a, "from_unit", "left").join(b, "to_unit", "left")
    error = F.when(F.col("f1").isNull() | F.col("f2").isNull(), "Undefined unit").when(F.col("d1") != F.col("d2"), "Incompatible units")
    return out.withColumn("error", error).withColumn("converted", F.when(F.col("error").isNull(), (F.col("value") * F.col("f1") + F.col("o1") - F.col("o2")) / F.col("f2")).otherwise(0.0)).drop("f1", "f2", "o1", "o2", "d1", "d2")


def to_si(value: Column, unit: str) -> Column:
    """In base units; an unknown unit leaves the value."""
    try:
        factor, offset, _ = parsed(unit)
    except UnitError:
        return value
    return value * F.lit(factor) + F.lit(offset)


def consistent(*units: str) -> bool:
    try:
        return len({parsed(u)[2] for u in units}) <= 1
    except UnitError:
        return False


def category(unit: str) -> str | None:
    try:
        dims = parsed(unit)[2]
    except UnitError:
        return None
    return next((k for k, v in CATEGORIES.items() if v == dims), None)


def suggestions(unit: str) -> list[str]:
    return SUGGESTIONS.get(category(unit) or "", [])


def calculate_with_units(text: str, quantities: dict[str, tuple[float, str]]) -> tuple[float, tuple[int, ...]] | None:
    """Value in base units and dimensions of an arithmetic expression over quantities; None if dimensions do not fit."""
    from .expr import ExpressionError, clean, parse

    def run(t):
        if t[0] == "num":
            return t[1], _v()
        if t[0] == "var":
            value, unit = quantities[t[1]]
            f, o, v = parsed(unit)
            return value * f + o, v
        if t[0] == "neg":
            x, v = run(t[1])
            return -x, v
        if t[0] == "call":
            raise ExpressionError("no functions over quantities")
        (x, v), (y, w) = run(t[1]), run(t[2])
        if t[0] in "+-":
            if v != w:
                raise UnitError("dimensions differ")
            return (x + y if t[0] == "+" else x - y), v
        if t[0] == "*":
            return x * y, tuple(a + b for a, b in zip(v, w))
        if t[0] == "/":
            return x / y, tuple(a - b for a, b in zip(v, w))
        if any(w) or y != int(y):
            raise UnitError("an exponent is a whole number")
        return x**y, tuple(int(y) * a for a in v)

    try:
        return run(parse(clean(text)))
    except (ValueError, ArithmeticError, KeyError):
        return None
