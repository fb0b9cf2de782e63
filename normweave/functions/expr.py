"""Arithmetic expressions: own tokenizer and parser, compiled to Columns.  No ``eval``.

A tree is ("num", x), ("var", name), ("neg", t), ("call", name, [t...]) or (op, left, right).  ``2x`` multiplies.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import EXPRESSION_SYMBOLS

CONSTANTS = {"pi": math.pi, "e": math.e, "inf": math.inf, "infinity": math.inf}
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([^\W\d]\w*)|(\*\*|[-+*/(),]))")
_ONE = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "exp": F.exp, "ln": F.ln, "sqrt": F.sqrt, "abs": F.abs, "floor": lambda c: F.floor(c).cast("double"), "ceil": lambda c: F.ceil(c).cast("double")}
_PY = {"sin": math.sin, "cos": math.cos, "tan": math.tan, "asin": math.asin, "acos": math.acos, "atan": math.atan, "sinh": math.sinh, "cosh": math.cosh, "tanh": math.tanh, "exp": math.exp, "ln": math.log, "sqrt": math.sqrt, "abs": abs, "floor": math.floor, "ceil": math.ceil}


class ExpressionError(ValueError):
    pass


def clean(text: str) -> str:
    for a, b in EXPRESSION_SYMBOLS:
        text = text.replace(a, b)
    return " ".join(text.split())


def parse(text: str):
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"cannot read {text[at:]!r}")
        tokens.append(m[1] and ("num", float(m[1])) or m[2] and ("name", m[2]) or ("op", m[3]))
        at = m.end()
    place = 0

    def peek(op: str | None = None):
        got = tokens[place] if place < len(tokens) else ("end", None)
        return got if op is None else got == ("op", op)

    def take(op: str | None = None):
        nonlocal place
        if op and not peek(op):
            raise ExpressionError(f"{op!r} expected in {text!r}")
        place += 1
        return tokens[place - 1]

    def total():
        left = product()
        while peek("+") or peek("-"):
            left = (take()[1], left, product())
        return left

    def product():
        left = signed()
        while True:
            if peek("*") or peek("/"):
                left = (take()[1], left, signed())
            elif peek()[0] in ("num", "name") or peek("("):
                left = ("*", left, power())
            else:
                return left

    def signed():
        if peek("-"):
            take()
            return ("neg", signed())
        if peek("+"):
            take()
            return signed()
        return power()

    def power():
        base = atom()
        if peek("**"):
            take()
            return ("**", base, signed())
        return base

    def atom():
        kind, value = peek()
        if kind == "num":
            take()
            return ("num", value)
        if kind == "name":
            take()
            if peek("(") and (value in _ONE or value in ("log", "min", "max")):
                take("(")
                args = [total()]
                while peek(","):
                    take()
                    args.append(total())
                take(")")
                if value not in ("min", "max") and len(args) > 1 + (value == "log"):
                    raise ExpressionError(f"too many arguments for {value}")
                return ("call", value, args)
            return ("num", CONSTANTS[value]) if value in CONSTANTS else ("var", value)
        if peek("("):
            take()
            inner = total()
            take(")")
            return inner
        raise ExpressionError(f"operand expected in {text!r}")

    tree = total()
    if place < len(tokens):
        raise ExpressionError(f"unexpected {tokens[place][1]!r} in {text!r}")
    return tree


def variables(tree) -> list[str]:
    found: set[str] = set()

    def walk(t):
        if t[0] == "var":
            found.add(t[1])
        elif t[0] == "call":
            for x in t[2]:
                walk(x)
        elif t[0] != "num":
            for x in t[1:]:
                walk(x)

    walk(tree)
    return sorted(found)


def extract_variables(text: str) -> list[str]:
    """Sorted names; one ``=`` is allowed; what cannot be parsed has none."""
    try:
        return sorted({v for side in clean(text).split("=", 1) for v in variables(parse(side))})
    except ExpressionError:
        return []


def compile_column(tree, get: Callable[[str], Column]) -> Column:
    kind = tree[0]
    if kind == "num":
        return F.lit(tree[1])
    if kind == "var":
        return get(tree[1]).cast("double")
    if kind == "neg":
        return -compile_column(tree[1], get)
    if kind == "call":
        args = [compile_column(t, get) for t in tree[2]]
        if tree[1] == "log":
            return F.ln(args[0]) if len(args) == 1 else F.ln(args[0]) / F.ln(args[1])
        if tree[1] in ("min", "max"):
            # least and greatest skip nulls; here an unknown operand makes the result unknown
            known = args[0].isNotNull()
            for a in args[1:]:
                known = known & a.isNotNull()
            picked = args[0] if len(args) == 1 else (F.least if tree[1] == "min" else F.greatest)(*args)
            return F.when(known, picked)
        return _ONE[tree[1]](args[0])
    a, b = compile_column(tree[1], get), compile_column(tree[2], get)
    return {"+": a + b, "-": a - b, "*": a * b}[kind] if kind in "+-*" and kind != "**" else F.try_divide(a, b) if kind == "/" else F.pow(a, b)


def evaluate(text: str, **columns: Column) -> Column:
    """The value of an expression for each row; names without a column make it null."""
    return compile_column(parse(clean(text)), lambda name: columns.get(name, F.lit(None)))


def value(tree, known: dict[str, float]) -> float | None:
    """The number that a tree gives on the driver; null if a variable is free."""
    kind = tree[0]
    if kind == "num":
        return tree[1]
    if kind == "var":
        return known.get(tree[1])
    if kind == "neg":
        x = value(tree[1], known)
        return None if x is None else -x
    args = [value(t, known) for t in (tree[2] if kind == "call" else tree[1:])]
    if any(a is None for a in args):
        return None
    if kind == "call":
        if tree[1] == "log":
            return math.log(*args)
        return {"min": min, "max": max}[tree[1]](args) if tree[1] in ("min", "max") else float(_PY[tree[1]](*args))
    a, b = args
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "**": lambda: a**b}[kind]()


def calculate(text: str, known: dict[str, float] | None = None) -> dict:
    """expression, numeric, variables_used, steps and error of one expression."""
    known, steps = known or {}, [f"Original expression: {text}"]
    out = {"expression": text, "numeric": None, "variables_used": known, "steps": steps, "error": None}
    try:
        tree = parse(clean(text))
        steps += [f"Substitute {k} = {v:g}" for k, v in sorted(known.items())]
        got = value(tree, known)
        if isinstance(got, complex):
            raise ExpressionError("the result is complex")
        out["numeric"] = got
        if got is not None:
            steps.append(f"Result: {got:g}")
    except (ValueError, ArithmeticError) as e:
        out["error"] = str(e)
    return out


def solve(equation: str, unknown: str, known: dict[str, float] | None = None) -> float:
    """The unknown of one equation: linear or quadratic in it (the smaller root first), or met once and undone step by step."""
    left, _, right = clean(equation).partition("=")
    if not right:
        raise ExpressionError("no equation")
    tree, known = ("-", parse(left), parse(right)), known or {}
    free = [v for v in variables(tree) if v != unknown and v not in known]
    if free or unknown not in variables(tree):
        raise ExpressionError(f"cannot solve for {unknown}: free {free}")
    f = lambda x: value(tree, {**known, unknown: x})
    try:
        y = [f(float(x)) for x in (0, 1, 2, 3, -1)]
        a, b, c = (y[2] - 2 * y[1] + y[0]) / 2, (4 * y[1] - y[2] - 3 * y[0]) / 2, y[0]
        fits = all(abs(a * x * x + b * x + c - v) <= 1e-9 * (1 + abs(v)) for x, v in zip((0, 1, 2, 3, -1), y))
        if fits and abs(a) <= 1e-12 * (abs(b) + abs(c) + 1) and b:
            return -c / b
        if fits and a:
            root = b * b - 4 * a * c
            if root < 0:
                raise ExpressionError("no real solution")
            return min((-b - math.sqrt(root)) / (2 * a), (-b + math.sqrt(root)) / (2 * a))
    except (ArithmeticError, ValueError) as e:
        if isinstance(e, ExpressionError):
            raise
    return _undo(parse(left), parse(right), unknown, known)


def _undo(a, b, unknown: str, known: dict[str, float]) -> float:
    """Moves everything but the unknown to the other side."""
    if unknown in variables(b):
        a, b = b, a
    if unknown in variables(b):
        raise ExpressionError(f"{unknown} occurs on both sides")
    goal = value(b, known)
    while a[0] != "var":
        if a[0] == "neg":
            a, goal = a[1], -goal
        elif a[0] == "call":
            inverse = {"exp": math.log, "ln": math.exp, "log": math.exp, "sqrt": lambda x: x * x, "sin": math.asin, "cos": math.acos, "tan": math.atan}.get(a[1])
            if inverse is None or len(a[2]) != 1:
                raise ExpressionError(f"cannot undo {a[1]}")
            a, goal = a[2][0], inverse(goal)
        else:
            op, x, y = a
            if unknown in variables(x) and unknown in variables(y):
                raise ExpressionError(f"{unknown} occurs more than once")
            if unknown in variables(x):
                k = value(y, known)
                goal = {"+": lambda: goal - k, "-": lambda: goal + k, "*": lambda: goal / k, "/": lambda: goal * k, "**": lambda: goal ** (1 / k)}[op]()
                a = x
            else:
                k = value(x, known)
                goal = {"+": lambda: goal - k, "-": lambda: k - goal, "*": lambda: goal / k, "/": lambda: k / goal, "**": lambda: math.log(goal) / math.log(k)}[op]()
                a = y
    return goal


def validated(actual: Column, expected: Column, tolerance: float = 0.01) -> Column:
    """struct<is_valid, difference>: relative difference, absolute where 0 is expected."""
    diff = F.when(expected == 0, F.abs(actual)).otherwise(F.abs(actual - expected) / F.abs(expected))
    return F.struct((diff <= tolerance).alias("is_valid"), diff.alias("difference"))


def formula_function(formula: str, output: str) -> Callable[..., Column] | None:
    """A function from columns, by name, to the formula's output; missing ones count as 0.  None if it is no formula of it."""
    left, _, right = clean(formula).partition("=")
    if right.strip() == output:
        left, right = right, left
    if left.strip() != output or not right or "=" in right:
        return None
    try:
        tree = parse(right)
    except ExpressionError:
        return None
    return lambda **cols: compile_column(tree, lambda name: F.coalesce(cols[name].cast("double"), F.lit(0.0)) if name in cols else F.lit(0.0))
