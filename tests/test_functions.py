import math

import pytest

from normweave.functions import expr, units


def test_numbers():
    assert expr.calculate("2+3")["numeric"] == 5
    assert expr.calculate("x*y+2", {"x": 5, "y": 3})["numeric"] == 17
    assert expr.calculate("6 × 300")["numeric"] == 1800
    assert expr.calculate("2x", {"x": 4})["numeric"] == 8
    assert expr.calculate("-2^2")["numeric"] == -4
    assert expr.calculate("2**-1")["numeric"] == 0.5
    assert expr.calculate("log(e)")["numeric"] == 1
    assert expr.calculate("a + 1")["numeric"] is None


@pytest.mark.parametrize("bad", ["2 +", "", ")", "1 2 $", "sqrt(-1)", "1/0", "sin(1, 2)"])
def test_errors(bad):
    assert expr.calculate(bad)["error"]


def test_variables():
    assert expr.extract_variables("Q = n × q_car") == ["Q", "n", "q_car"]
    assert expr.extract_variables("2 +") == []


def test_solve():
    assert expr.solve("A = B*C", "C", {"A": 1800, "B": 6}) == pytest.approx(300)
    assert expr.solve("x**2 = 4", "x") == pytest.approx(-2)
    assert expr.solve("exp(x) = 3", "x") == pytest.approx(math.log(3))
    assert expr.solve("v = d / t", "t", {"v": 4, "d": 10}) == pytest.approx(2.5)
    with pytest.raises(expr.ExpressionError):
        expr.solve("x + y = 1", "x")
    with pytest.raises(expr.ExpressionError):
        expr.solve("x**2 = 0 - 4", "x")


def test_formula_function():
    assert expr.formula_function("a = b + c", "z") is None
    assert expr.formula_function("a = b = c", "a") is None


def test_units():
    assert units.convert(100, "m", "ft")["converted"] == pytest.approx(328.084, abs=1e-3)
    assert units.convert(1800, "m³/h", "L/s")["converted"] == pytest.approx(500)
    assert units.convert(1, "mile", "m")["converted"] == pytest.approx(1609.34, abs=1e-2)
    assert units.convert(100, "°C", "°F")["converted"] == pytest.approx(212)
    assert "Incompatible" in units.convert(1, "m", "kg")["error"]
    assert "Undefined" in units.convert(1, "furlong", "m")["error"]
    assert units.category("m³/h") == "flow_rate_volume"
    assert "foot" in units.suggestions("m")
    assert units.consistent("m", "ft") and not units.consistent("m", "s") and units.consistent()
    assert units.calculate_with_units("a*b + c", {"a": (2, "m"), "b": (3, "m"), "c": (1, "m²")})[0] == 7
    assert units.calculate_with_units("a + b", {"a": (2, "m"), "b": (3, "s")}) is None
