"""Questions: intent, plan, confidence, citations and the written answer.  Language models are outside; a keyword parser stands in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import CITATION
from ..functions.text import extract_all

QUERY_TYPES = ["lookup", "calculation", "comparison", "explanation", "validation", "multi_step"]
#: Words that tell a type of question, first match wins.
KEYWORDS = [("calculation", r"calculat|comput|how much|how many"), ("comparison", r"compar|differ|versus|better"), ("validation", r"valid|verif|check|comply|allowed"), ("explanation", r"explain|why|describe")]
INTENT = "query_type string, entities map<string,string>, parameters map<string,double>, required_sections array<string>, required_calculations array<string>, constraints array<string>"


def keyword_type(question: Column) -> Column:
    low = F.lower(question)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(t)) for t, p in KEYWORDS], F.lit("lookup"))


def parse_intent(json: Column) -> Column:
    """The intent that a JSON text holds; bad JSON and unknown types give an empty lookup."""
    got = F.from_json(json, INTENT)
    texts, none = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    good = F.coalesce(got["query_type"].isin(QUERY_TYPES), F.lit(False))
    pick = lambda name, empty: F.when(good, F.coalesce(got[name], empty)).otherwise(empty).alias(name)
    return F.struct(F.when(good, got["query_type"]).otherwise("lookup").alias("query_type"), pick("entities", none), pick("parameters", F.create_map().cast("map<string,double>")), pick("required_sections", texts), pick("required_calculations", texts), pick("constraints", texts))


def plan_steps(query_type: Column, sections: Column, entities: Column, calculations: Column) -> Column:
    """The steps that answer a question, as text."""
    one = lambda when, *steps: F.when(when, F.array(*[F.lit(s) for s in steps])).otherwise(F.array().cast("array<string>"))
    wanted = F.concat(F.lit("Search for sections: "), F.array_join(sections, ", "))
    calc = query_type == "calculation"
    return F.concat(
        F.when(F.size(sections) > 0, F.array(wanted)).otherwise(F.array().cast("array<string>")),
        one(entities.rlike("table|rate|value"), "Search for relevant tables"),
        one(calc, "Extract calculation formulas"),
        F.when(calc, F.transform(calculations, lambda c: F.concat(F.lit("Perform calculation: "), c))).otherwise(F.array().cast("array<string>")),
        one(query_type == "validation", "Retrieve validation criteria", "Check against requirements"),
        one(query_type == "comparison", "Retrieve items to compare", "Extract comparison criteria"),
    )


def confidence(query_type: Column, n_context: Column, n_calculations: Column) -> Column:
    up = F.least(F.lit(0.3), n_context * F.lit(0.1)) + F.when((query_type == "calculation") & (n_calculations > 0), 0.2).otherwise(0.0)
    down = F.when(query_type == "multi_step", 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + up - down))


def citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """(answer_id, pos, section_number, section_title): each mention of a section, with the first context row of that number."""
    first = context.groupBy("section_number").agg(F.min_by("section_title", "rank").alias("section_title"))
    asked = answers.select("answer_id", F.posexplode(extract_all(F.col("answer"), CITATION, 1)).alias("pos", "section_number"))
    return asked.join(first, "section_number").select("answer_id", "pos", "section_number", "section_title")


def context_text(items: Column, most: int = 5, size: int = 500) -> Column:
    """items: array<struct<section_number,title,content>> in order."""
    lines = F.transform(F.slice(items, 1, most), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] Section "), F.coalesce(x["section_number"], F.lit("N/A")), F.lit(": "), F.coalesce(x["title"], F.lit("Untitled")), F.lit("\n"), F.substring(x["content"], 1, size)))
    return F.when(F.size(items) > 0, F.array_join(lines, "\n\n")).otherwise("No relevant context found.")


def calculations_text(items: Column) -> Column:
    """items: array<struct<expression,result,units>>."""
    lines = F.transform(items, lambda x: F.concat(x["expression"], F.lit(" = "), x["result"], F.coalesce(F.concat(F.lit(" "), x["units"]), F.lit(""))))
    return F.when(F.size(items) > 0, F.array_join(lines, "\n")).otherwise("No calculations performed.")


def markdown(answer: Column, calculations: Column, sources: Column, steps: Column, sure: Column) -> Column:
    """An answer as Markdown.  calculations: array<struct<expression,result,units>>; sources: array<struct<section,title,page>>; steps: array<string>."""
    told = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    sum_ = lambda x: F.concat(F.lit("- `"), told(x["expression"]), F.lit(" = "), told(x["result"]), F.when(told(x["units"]) != "", F.concat(F.lit(" "), x["units"])).otherwise(""), F.lit("`\n"))
    source = lambda x: F.concat(F.lit("- Section "), told(x["section"]), F.lit(": "), told(x["title"]), F.when(F.coalesce(x["page"], F.lit(0)) != 0, F.concat(F.lit(" (Page "), x["page"].cast("string"), F.lit(")"))).otherwise(""), F.lit("\n"))
    part = lambda name, items, line: F.when(F.size(items) > 0, F.concat(F.lit(f"### {name}\n\n"), F.array_join(F.transform(items, line), ""), F.lit("\n"))).otherwise("")
    step = lambda x: F.concat(F.lit("1. "), x, F.lit("\n"))
    return F.concat(F.lit("## Answer\n\n"), answer, F.lit("\n\n"), part("Calculations", calculations, sum_), part("Sources", sources, source), part("Reasoning Steps", steps, step), F.lit("*Confidence: "), F.bround(sure * 100, 0).cast("int").cast("string"), F.lit("%*\n"))


def answer_questions(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(q_id, answer, confidence, steps): a template answer from the context rows (q_id, rank, id, score) of each question."""
    w = Window.partitionBy("q_id").orderBy("rank")
    top = hits.withColumn("rn", F.row_number().over(w)).where("rn <= 15").groupBy("q_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rn", "id"))).alias("items"))
    kind, none = keyword_type(F.col("question")), F.array().cast("array<string>")
    out = questions.join(top, "q_id", "left")
    steps = plan_steps(kind, none, F.lower("question"), none)
    evidence = F.array_join(F.transform(F.slice("items", 1, 3), lambda x: x["id"].cast("string")), ", ")
    return out.select("q_id", kind.alias("query_type"), F.coalesce(F.concat(F.lit("See "), evidence), F.lit("No relevant context found.")).alias("answer"), confidence(kind, F.coalesce("n", F.lit(0)), F.lit(0)).alias("confidence"), steps.alias("steps"))
