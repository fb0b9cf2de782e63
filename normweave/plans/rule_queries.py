"""Queries on rules, expressions and units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr, units
from ..functions.patterns import RULE_TYPES, RULES
from ..functions.text import quantity, section_key, sentences, value_and_unit
from ..operators import calculations, rules
from ..sources.catalog import sanitized
from .spec import TEXTS, texts


def sentence_split(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


def _rules(spark, sf_dir):
    return rules.extract_rules(texts(spark, sf_dir))


def rule_extract(spark, sf_dir):
    return _rules(spark, sf_dir).select("doc_id", "rule_no", "rule_type", "source_text", "target", "expression")


def rule_stats(spark, sf_dir):
    return rules.statistics(_rules(spark, sf_dir))


def rule_conditions(spark, sf_dir):
    out = _rules(spark, sf_dir).where("rule_type = 'conditional'").select("doc_id", F.explode("conditions").alias("c"))
    return out.select("doc_id", "c.variable", "c.op", "c.num")


def _facts(spark, sf_dir):
    """A fact for each size of a part, some without a price."""
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size").distinct()
    price = F.when(F.col("p_size") % 2 == 0, F.lit("abc"))
    return sizes.select(F.col("p_size").alias("fact_id"), F.map_filter(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("price"), price), lambda k, v: v.isNotNull()).alias("vars"))


def rule_eval(spark, sf_dir):
    """Which facts fire the rules of each document, and its rules without conditions."""
    out = rules.evaluate_rules(_rules(spark, sf_dir), _facts(spark, sf_dir))
    return out.groupBy("doc_id").agg(F.count("fact_id").alias("n_fired"), F.min("fact_id").alias("first_fact"), F.count_if(F.col("fact_id").isNull()).alias("n_free"))


def rules_by_variable(spark, sf_dir):
    return rules.by_variable(_rules(spark, sf_dir), "SIZE").groupBy("rule_type").agg(F.count("*").alias("n"))


def rules_by_type(spark, sf_dir):
    return rules.by_type(_rules(spark, sf_dir), "reference").select("doc_id", "rule_no", "expression")


# --- expressions and units --------------------------------------------------------------------------------------------


def _lineitem(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def expr_eval(spark, sf_dir):
    net = expr.evaluate("price × (1 − discount)^2 + sqrt(quantity)", price=F.col("l_extendedprice"), discount=F.col("l_discount"), quantity=F.col("l_quantity"))
    return _lineitem(spark, sf_dir).groupBy("l_returnflag").agg(F.round(F.avg(net), 4).alias("mean_net"))


def expr_functions(spark, sf_dir):
    cols = {"x": F.col("l_quantity"), "y": F.col("l_discount")}
    told = {"f1": "min(x, 10) + max(y, 0.05)", "f2": "log(x, 2)", "f3": "2x + 3(y + 1)", "f4": "-x**2 / 4", "f5": "abs(sin(pi * y)) + floor(x / 3)"}
    return _lineitem(spark, sf_dir).groupBy("l_linestatus").agg(*[F.round(F.avg(expr.evaluate(t, **cols)), 6).alias(k) for k, t in told.items()])


def expr_validate(spark, sf_dir):
    got = expr.validated(expr.evaluate("q * 1.005", q=F.col("l_quantity")), F.col("l_quantity") * F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(1.02))
    return _lineitem(spark, sf_dir).groupBy(got["is_valid"].alias("is_valid")).agg(F.count("*").alias("n"))


def expr_solve(spark, sf_dir):
    cases = [("A = B*C", "C", {"A": 1800.0, "B": 6.0}), ("x**2 - 5*x + 6 = 0", "x", {}), ("sqrt(x) + 1 = 4", "x", {}), ("v = d / t", "t", {"v": 4.0, "d": 10.0})]
    return spark.createDataFrame([(i, float(expr.solve(*c))) for i, c in enumerate(cases)], "id int, root double").select("id", F.round("root", 9).alias("root"))


def formula_function(spark, sf_dir):
    revenue = expr.formula_function("revenue = price * (1 - discount) + bonus", "revenue")
    out = revenue(price=F.col("l_extendedprice"), discount=F.col("l_discount"))
    return _lineitem(spark, sf_dir).groupBy("l_linenumber").agg(F.round(F.avg(out), 4).alias("mean_revenue"))


def unit_convert(spark, sf_dir):
    size = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("v"))
    asked = {"ft": ("m", "ft"), "litres_per_second": ("m³/h", "L/s"), "fahrenheit": ("°C", "°F"), "pascal": ("psi", "Pa")}
    return size.select("p_partkey", *[F.round(units.convert_column(F.col("v"), *ab), 6).alias(k) for k, ab in asked.items()])


def unit_convert_rows(spark, sf_dir):
    """Units in columns, with unknown and incompatible ones."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    rows = part.select("p_partkey", F.col("p_size").cast("double").alias("value"), pick(["mm", "kg", "furlong", "hour"]).alias("from_unit"), pick(["m", "g"]).alias("to_unit"))
    out = units.convert_rows(rows, units.unit_table(spark, ["mm", "kg", "furlong", "hour", "m", "g"]))
    return out.select("p_partkey", F.round("converted", 6).alias("converted"), "error")


def unit_si(spark, sf_dir):
    size = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("v"))
    return size.select("p_partkey", F.round(units.to_si(F.col("v"), "km"), 6).alias("metres"), F.round(units.to_si(F.col("v"), "furlong"), 6).alias("unknown"))


def unit_categories(spark, sf_dir):
    rows = [(u, units.category(u), ",".join(units.suggestions(u))) for u in ("m", "m²", "L/s", "kg/s", "kPa", "kW", "m/s", "furlong")]
    return spark.createDataFrame(rows, "unit string, category string, suggestions string")


def unit_consistency(spark, sf_dir):
    rows = [("m,ft", units.consistent("m", "ft")), ("m,kg", units.consistent("m", "kg")), ("L/s,m³/h", units.consistent("L/s", "m³/h")), ("m", units.consistent("m")), ("m,furlong", units.consistent("m", "furlong"))]
    return spark.createDataFrame(rows, "units string, consistent boolean")


def quantity_parse(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(F.lit("rate of "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " m³/h per car").otherwise(" (mm)"))
    out = part.select("p_partkey", quantity(text).alias("q"), value_and_unit(F.concat(F.col("p_size").cast("string"), F.lit(" mm max"))).alias("u"))
    return out.select("p_partkey", "q.value", "q.unit", F.col("u.num").alias("num"), F.col("u.unit").alias("unit_run"))


def section_keys(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    number = F.concat(F.lit("A."), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 12).cast("string"))
    return part.select("p_partkey", F.array_join(F.transform(section_key(number), lambda x: x.cast("string")), ",").alias("key"))


def _part(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("size"))


def calculation_rows(spark, sf_dir):
    """The calculations that intents ask for, some of which fail."""
    rows = _part(spark, sf_dir).select(F.col("p_partkey").alias("q_id"), F.create_map(F.lit("n"), F.col("size")).alias("parameters"), F.array(F.lit("n × 300"), F.lit("n +"), F.concat(F.lit("sqrt("), F.col("size").cast("int").cast("string"), F.lit("^2) + 1")), F.lit("1 / (n - n)")).alias("required_calculations"))
    return calculations.performed(rows).select("q_id", F.col("pos").cast("int").alias("pos"), "expression", F.round("result", 6).alias("result"))


def solve_rows(spark, sf_dir):
    """Equations in columns: a product, a quotient and one without a solution."""
    k = F.col("p_partkey") % 3
    rows = _part(spark, sf_dir).select("p_partkey", F.when(k == 0, "A = B*C").when(k == 1, "v = d / C").otherwise("C + q = 1").alias("equation"), F.lit("C").alias("unknown"), F.create_map(F.lit("A"), F.col("size") * 6, F.lit("B"), F.lit(6.0), F.lit("v"), F.lit(4.0), F.lit("d"), F.col("size")).alias("known"))
    return calculations.solve_rows(rows).select("p_partkey", F.round("result.numeric", 6).alias("root"), F.col("result.error").isNotNull().alias("failed"))


def unit_calculation_rows(spark, sf_dir):
    q = lambda v, u: F.struct(v.cast("double").alias("value"), F.lit(u).alias("unit"))
    rows = _part(spark, sf_dir).select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "a + t").otherwise("a * b").alias("expression"), F.create_map(F.lit("a"), q(F.col("size"), "m"), F.lit("b"), q(F.lit(2), "km"), F.lit("t"), q(F.lit(1), "s")).alias("quantities"))
    return calculations.calculate_units_rows(rows).select("p_partkey", F.round("result.numeric", 6).alias("value"), F.col("result.error").isNotNull().alias("failed"))


def metadata_plain(spark, sf_dir):
    """Values of metadata made plain: text, list, map and null."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select("p_partkey", F.struct(F.col("p_name").alias("name"), F.array("p_size", F.col("p_partkey").cast("int")).alias("list"), F.create_map(F.lit("type"), F.col("p_type"), F.lit("no"), F.lit(None).cast("string")).alias("map"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("size")).alias("metadata"))
    return sanitized(rows).select("p_partkey", "metadata.*")


_S = TEXTS + r", s AS (SELECT doc_id, unnest(list_transform(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x, i: {'pos': i - 1, 'sentence': x})) AS k FROM texts)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _hit(k: int) -> str:
    kind, p, groups = RULES[k]
    g = lambda n: f"regexp_extract_all(k.sentence, '{p}', {n})"
    second = _strip("x[3]") if groups > 1 else "CAST(NULL AS VARCHAR)"
    zipped = f"list_zip({g(0)}, {g(1)}, {g(2)})" if groups > 1 else f"list_zip({g(0)}, {g(1)})"
    return f"SELECT doc_id, k.pos AS sentence_no, {k} AS pattern, '{kind}' AS rule_type, unnest(list_transform({zipped}, lambda x, i: {{'i': i, 'src': x[1], 'g1': {_strip('x[2]')}, 'g2': {second}}})) AS m FROM s"


_R = f"""{_S}, hit AS ({" UNION ALL ".join(_hit(k) for k in range(len(RULES)))}),
r AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sentence_no, pattern, m.i) AS INTEGER) AS rule_no, rule_type, m.src AS source_text, m.g1 AS g1, m.g2 AS g2,
 CASE rule_type WHEN 'conditional' THEN 'result' WHEN 'validation' THEN 'system' WHEN 'requirement' THEN CASE WHEN m.g2 IS NULL THEN 'system' ELSE m.g1 END WHEN 'reference' THEN coalesce(m.g2, 'information') ELSE m.g1 END AS target,
 CASE WHEN rule_type = 'reference' THEN m.g1 ELSE coalesce(m.g2, m.g1) END AS expression FROM hit),
cond AS (SELECT doc_id, rule_no, {_strip("regexp_extract(g1, '([^>]+)\\s*>\\s*([^,\\s]+)', 1)")} AS variable, '>' AS op, CAST(regexp_extract(g1, '([^>]+)\\s*>\\s*([^,\\s]+)', 2) AS DOUBLE) AS num FROM r WHERE rule_type = 'conditional')"""
_L = "FROM lineitem GROUP BY"
QUERIES = {
    "sentence_split": (sentence_split, f"WITH {_S} SELECT doc_id, CAST(k.pos AS INTEGER) AS pos, k.sentence AS sentence FROM s"),
    "rule_extract": (rule_extract, f"WITH {_R} SELECT doc_id, rule_no, rule_type, source_text, target, expression FROM r"),
    "rule_stats": (rule_stats, f"WITH {_R} SELECT count(*) AS total_rules, {', '.join(f'count(*) FILTER (rule_type = {chr(39)}{t}{chr(39)}) AS n_{t}' for t in RULE_TYPES)}, count(*) FILTER (rule_type IN ('conditional', 'constraint')) AS with_conditions, count(*) AS with_actions FROM r"),
    "rule_conditions": (rule_conditions, f"WITH {_R} SELECT doc_id, variable, op, num FROM cond"),
    "rule_eval": (rule_eval, f"WITH {_R}, facts AS (SELECT DISTINCT p_size FROM part), met AS (SELECT c.doc_id, count(*) AS n, min(p_size) AS first_fact FROM cond c JOIN facts ON c.variable = 'size' AND p_size > c.num GROUP BY 1), free AS (SELECT doc_id, count(*) AS n FROM r WHERE rule_type NOT IN ('conditional', 'constraint') GROUP BY 1) SELECT coalesce(m.doc_id, f.doc_id) AS doc_id, coalesce(m.n, 0) AS n_fired, m.first_fact, coalesce(f.n, 0) AS n_free FROM met m FULL JOIN free f ON m.doc_id = f.doc_id"),
    "rules_by_variable": (rules_by_variable, f"WITH {_R}, u AS (SELECT rule_type FROM r WHERE rule_type = 'conditional' AND regexp_matches(g1, '(?i)^size\\s*>') UNION ALL SELECT rule_type FROM r WHERE rule_type = 'constraint' AND lower(g1) = 'size' UNION ALL SELECT rule_type FROM r WHERE lower(target) = 'size') SELECT rule_type, count(*) AS n FROM u GROUP BY 1"),
    "rules_by_type": (rules_by_type, f"WITH {_R} SELECT doc_id, rule_no, expression FROM r WHERE rule_type = 'reference'"),
    "expr_eval": (expr_eval, f"SELECT l_returnflag, round(avg(l_extendedprice * (1 - l_discount) ** 2 + sqrt(l_quantity)), 4) AS mean_net {_L} 1"),
    "expr_functions": (expr_functions, f"SELECT l_linestatus, round(avg(least(l_quantity, 10) + greatest(l_discount, CAST(0.05 AS DOUBLE))), 6) AS f1, round(avg(ln(l_quantity) / ln(2)), 6) AS f2, round(avg(2 * l_quantity + 3 * (l_discount + 1)), 6) AS f3, round(avg(-(l_quantity ** 2) / 4), 6) AS f4, round(avg(abs(sin(pi() * l_discount)) + floor(l_quantity / 3)), 6) AS f5 {_L} 1"),
    "expr_validate": (expr_validate, f"SELECT l_linenumber % 2 = 0 AS is_valid, count(*) AS n {_L} 1"),
    "expr_solve": (expr_solve, "SELECT * FROM (VALUES (CAST(0 AS INTEGER), CAST(300 AS DOUBLE)), (1, 2.0), (2, 9.0), (3, 2.5)) AS t(id, root)"),
    "formula_function": (formula_function, f"SELECT l_linenumber, round(avg(l_extendedprice * (1 - l_discount)), 4) AS mean_revenue {_L} 1"),
    "unit_convert": (unit_convert, "SELECT p_partkey, round(p_size / CAST(0.3048 AS DOUBLE), 6) AS ft, round(p_size / CAST(3.6 AS DOUBLE), 6) AS litres_per_second, round(p_size * CAST(1.8 AS DOUBLE) + 32, 6) AS fahrenheit, round(p_size * CAST(4.4482216152605 AS DOUBLE) / (CAST(0.0254 AS DOUBLE) * CAST(0.0254 AS DOUBLE)), 6) AS pascal FROM part"),
    "unit_convert_rows": (unit_convert_rows, "SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN p_size / CAST(1000 AS DOUBLE) WHEN 1 THEN p_size * CAST(1000 AS DOUBLE) ELSE 0 END, 6) AS converted, CASE p_partkey % 4 WHEN 2 THEN 'Undefined unit' WHEN 3 THEN 'Incompatible units' END AS error FROM part"),
    "unit_si": (unit_si, "SELECT p_partkey, CAST(p_size * 1000 AS DOUBLE) AS metres, CAST(p_size AS DOUBLE) AS unknown FROM part"),
    "unit_categories": (unit_categories, "SELECT * FROM (VALUES ('m', 'length', 'meter,foot,inch,kilometer,mile'), ('m²', 'area', 'meter**2,foot**2'), ('L/s', 'flow_rate_volume', 'meter**3/hour,liter/second,cubic_feet/minute,gallons/minute'), ('kg/s', 'flow_rate_mass', ''), ('kPa', 'pressure', ''), ('kW', 'power', ''), ('m/s', 'velocity', ''), ('furlong', NULL, '')) AS t(unit, category, suggestions)"),
    "unit_consistency": (unit_consistency, "SELECT * FROM (VALUES ('m,ft', true), ('m,kg', false), ('L/s,m³/h', true), ('m', true), ('m,furlong', false)) AS t(units, consistent)"),
    "quantity_parse": (quantity_parse, "SELECT p_partkey, CAST(p_size AS DOUBLE) AS value, CASE WHEN p_partkey % 2 = 0 THEN 'm³/h' ELSE 'mm' END AS unit, CAST(p_size AS DOUBLE) AS num, 'mm' AS unit_run FROM part"),
    "section_keys": (section_keys, "SELECT p_partkey, concat(CAST(p_size AS VARCHAR), ',', CAST(p_partkey % 12 AS VARCHAR)) AS key FROM part"),
    "calculation_rows": (calculation_rows, "SELECT p_partkey AS q_id, 0 AS pos, 'n × 300' AS expression, CAST(p_size * 300 AS DOUBLE) AS result FROM part UNION ALL SELECT p_partkey, 2, 'sqrt(' || p_size || '^2) + 1', CAST(p_size + 1 AS DOUBLE) FROM part"),
    "solve_rows": (solve_rows, "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN round(p_size / CAST(4 AS DOUBLE), 6) END AS root, p_partkey % 3 = 2 AS failed FROM part"),
    "unit_calculation_rows": (unit_calculation_rows, "SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_size * 2000 AS DOUBLE) END AS value, p_partkey % 4 = 0 AS failed FROM part"),
    "metadata_plain": (metadata_plain, """SELECT p_partkey, p_name AS name, p_size || ', ' || p_partkey AS list, concat('{"type": "', p_type, '", "no": null}') AS map, CASE WHEN p_size > 10 THEN p_size END AS size FROM part"""),
}
