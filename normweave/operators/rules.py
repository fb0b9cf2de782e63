"""Rules in text and their evaluation over facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import CONDITIONS, RULE_TYPES, RULES
from ..functions.text import extract_all, numeric, sentences, strip, value_and_unit

_HIT = "array<struct<pattern:int,pos:int,rule_type:string,source_text:string,g1:string,g2:string>>"
_COND = "array<struct<variable:string,op:string,num:double,str:string,unit:string>>"


#: For each rule pattern words (lower case) of which every match holds one, by their order in ``RULES``.
WORDS = [
    ["then"], ["when"], ["where"],
    ["shall", "must"], ["required"], ["mandatory"],
    ["exceed"], ["maximum"], ["minimum"], ["≤", "<"], ["≥", ">"],
    ["="], ["calculate"], ["determined"],
    ["verify"], ["check"], ["ensure"],
    ["refer"], ["section"], ["accordance"],
]


def _hits(sentence: Column, low: Column, k: int) -> Column:
    """A sentence without a pattern's words costs no pattern: several go back over the sentence from each start."""
    kind, pattern, groups = RULES[k]
    some = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in WORDS[k]])
    return F.when(some, _matched(sentence, k)).otherwise(F.array().cast(_HIT))


def _matched(sentence: Column, k: int) -> Column:
    kind, pattern, groups = RULES[k]
    cols = [extract_all(sentence, pattern, g).alias(f"g{g}") for g in range(0, groups + 1)]
    null = F.lit(None).cast("string")
    return F.transform(F.arrays_zip(*cols), lambda x, i: F.struct(F.lit(k).alias("pattern"), i.alias("pos"), F.lit(kind).alias("rule_type"), x["g0"].alias("source_text"), strip(x["g1"]).alias("g1"), (strip(x["g2"]) if groups > 1 else null).alias("g2")))


def conditions(text: Column) -> Column:
    """All matches of all condition patterns, in order."""
    def one(p: str, op: str) -> Column:
        zipped = F.arrays_zip(extract_all(text, p, 1).alias("v"), extract_all(text, p, 2).alias("x"))

        def row(z):
            num = numeric(z["x"])
            return F.struct(strip(z["v"]).alias("variable"), F.lit(op).alias("op"), num.alias("num"), F.when(num.isNull(), strip(z["x"])).alias("str"), F.lit(None).cast("string").alias("unit"))

        return F.transform(zipped, row)

    return F.concat(*[one(p, op) for p, op in CONDITIONS]).cast(_COND)


def extract_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, rule_no, rule_type, source_text, conditions, action_type, target, expression, unit, tags).

    Sentences by types by patterns by matches, in that order; a sentence ends at any of . ! ?, so decimals split too.
    """
    rows = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "sentence"))
    rows = rows.withColumn("low", F.lower("sentence"))
    rows = rows.select("doc_id", "sentence_no", F.explode(F.concat(*[_hits(F.col("sentence"), F.col("low"), k) for k in range(len(RULES))])).alias("m")).select("doc_id", "sentence_no", "m.*")
    w = Window.partitionBy("doc_id").orderBy("sentence_no", "pattern", "pos")
    is_ = lambda *kinds: F.col("rule_type").isin(*kinds)
    low = F.lower("source_text")
    at_least = F.contains(low, F.lit("minimum")) & ~F.contains(low, F.lit("maximum")) & ~F.contains(low, F.lit("not exceed"))
    value = value_and_unit(F.coalesce("g2", F.lit("")))
    limit = F.array(F.struct(F.col("g1").alias("variable"), F.when(at_least, ">=").otherwise("<=").alias("op"), value["num"].alias("num"), value["str"].alias("str"), value["unit"].alias("unit"))).cast(_COND)
    none = F.array().cast(_COND)
    return rows.select(
        "doc_id",
        F.row_number().over(w).alias("rule_no"),
        "rule_type",
        "source_text",
        F.when(is_("conditional"), conditions(F.col("g1"))).when(is_("constraint"), limit).otherwise(none).alias("conditions"),
        F.when(is_("conditional"), "assign").when(is_("calculation"), "calculate").when(is_("reference"), "reference").otherwise("validate").alias("action_type"),
        F.when(is_("conditional"), F.lit("result"))
        .when(is_("validation"), F.lit("system"))
        .when(is_("requirement"), F.when(F.col("g2").isNull(), F.lit("system")).otherwise(F.col("g1")))
        .when(is_("reference"), F.coalesce("g2", F.lit("information")))
        .otherwise(F.col("g1"))
        .alias("target"),
        F.when(is_("reference"), F.col("g1")).otherwise(F.coalesce("g2", "g1")).alias("expression"),
        F.when(is_("constraint"), value["unit"]).alias("unit"),
        F.when(is_("requirement"), F.array(F.lit("mandatory"))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )


def holds(condition: Column, facts: Column) -> Column:
    """A condition over a map<string,string> of facts.  Missing variables and failed casts are false; == compares numbers
    as numbers and otherwise strings; AND, OR and NOT as operators are false."""
    raw, op = F.element_at(facts, condition["variable"]), condition["op"]
    x, y = numeric(raw), condition["num"]
    text = F.coalesce(condition["str"], y.cast("string"))
    same = F.when(y.isNotNull(), F.coalesce(x == y, F.lit(False))).otherwise(raw == condition["str"])
    test = (
        F.when(op == "==", same)
        .when(op == "!=", ~same)
        .when(op == ">", x > y)
        .when(op == ">=", x >= y)
        .when(op == "<", x < y)
        .when(op == "<=", x <= y)
        .when(op == "CONTAINS", F.contains(F.lower(raw), F.lower(text)))
        .when(op == "IN", F.array_contains(F.transform(F.split(condition["str"], ","), strip), raw))
    )
    return F.coalesce(raw.isNotNull() & test, F.lit(False))


def evaluate_rules(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact_id, doc_id, rule_no, action_type, target, expression): the rules that fire for each row of facts.

    Rules without conditions fire for every row; they come once, with a null fact_id.  Others meet the facts that hold their first variable by an equi-join.
    """
    act = ["fact_id", "doc_id", "rule_no", "action_type", "target", "expression"]
    some = rules.where(F.size("conditions") > 0).withColumn("key", F.col("conditions")[0]["variable"])
    keyed = facts.select("fact_id", "vars", F.explode(F.map_keys("vars")).alias("key"))
    met = some.join(keyed, "key").where(F.forall("conditions", lambda c: holds(c, F.col("vars"))))
    free = rules.where(F.size("conditions") == 0).withColumn("fact_id", F.lit(None).cast(facts.schema["fact_id"].dataType))
    return met.select(*act).unionByName(free.select(*act))


def statistics(rules: DataFrame) -> DataFrame:
    """One row: total, the count of each type (zeros kept), rules with conditions and with actions."""
    return rules.agg(F.count("*").alias("total_rules"), *[F.count_if(F.col("rule_type") == t).alias(f"n_{t}") for t in RULE_TYPES], F.count_if(F.size("conditions") > 0).alias("with_conditions"), F.count_if(F.col("action_type").isNotNull()).alias("with_actions"))


def by_type(rules: DataFrame, kind: str) -> DataFrame:
    return rules.where(F.col("rule_type") == kind)


def by_variable(rules: DataFrame, name: str) -> DataFrame:
    """Rules with the variable in a condition and rules that act on it; one that does both comes twice."""
    name = name.lower()
    return rules.where(F.exists("conditions", lambda c: F.lower(c["variable"]) == name)).unionAll(rules.where(F.lower("target") == name))
