"""Structure extraction: pages to lines, sections, a hierarchy and cross-references.

pages: (doc_id, page_no, text).  sections: (doc_id, seq, number, title, level, content, page_number, parent_seq, is_root).
Every window is within one document.  All sections are returned; ``is_root`` marks those without a parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import HEADERS, REFERENCES
from ..functions.text import extract_all, section_key, strip
from .graph import checkpoint

def raw_text(pages: DataFrame) -> DataFrame:
    """(doc_id, raw_text, total_pages): pages joined in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"])
    return pages.groupBy("doc_id").agg(F.array_join(texts, "\n").alias("raw_text"), F.max("page_no").alias("total_pages"))


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, line): stripped, blank lines left out."""
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("line", strip("line")).where(F.col("line") != "")


def _header(line):
    return F.coalesce(*[F.when(line.rlike(p), F.struct(F.regexp_extract(line, p, 1).alias("number"), F.regexp_extract(line, p, 2).alias("title"))) for p in HEADERS])


def level(number):
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    inner = F.regexp_extract(number, r"\d+(?:\.\d+)*", 0)
    return F.when(number.startswith("Chapter"), 1).when(number.startswith("Section"), F.when(inner == "", 2).otherwise(dots + 2)).otherwise(dots + 1).cast("int")


def sections(pages: DataFrame) -> DataFrame:
    """Lines before the first header of a page belong to its first section; a page without a header gives none."""
    lines = page_lines(pages).withColumn("header", _header(F.col("line")))
    page = Window.partitionBy("doc_id", "page_no")
    lines = lines.withColumn("h", F.count("header").over(page.orderBy("line_no"))).withColumn("of", F.count("header").over(page)).where("of > 0")
    group = lines.withColumn("h", F.greatest("h", F.lit(1))).groupBy("doc_id", "page_no", "h")
    body = F.filter(F.array_sort(F.collect_list(F.struct("line_no", F.col("header").isNull().alias("text"), "line"))), lambda x: x["text"])
    out = group.agg(F.min_by("header", F.when(F.col("header").isNotNull(), F.col("line_no"))).alias("header"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("content"))
    out = out.select("doc_id", F.col("page_no").alias("page_number"), "h", "header.number", "header.title", "content").withColumn("level", level(F.col("number")))
    seq = Window.partitionBy("doc_id").orderBy("page_number", "h")
    return with_parents(out.withColumn("seq", F.row_number().over(seq)).drop("h"))


def with_parents(found: DataFrame) -> DataFrame:
    """The parent is the nearest earlier section of a smaller level: of a stack of open sections, those of smaller levels stay."""
    rows = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "level"))).alias("rows"))

    def step(acc, x):
        still = F.filter(acc["open"], lambda s: s["level"] < x["level"])
        parent = F.get(still, F.size(still) - 1)["seq"]
        return F.struct(F.concat(still, F.array(x)).alias("open"), F.concat(acc["out"], F.array(F.struct(x["seq"].alias("seq"), parent.alias("parent_seq")))).alias("out"))

    first = F.struct(F.array().cast("array<struct<seq:int,level:int>>").alias("open"), F.array().cast("array<struct<seq:int,parent_seq:int>>").alias("out"))
    parents = rows.select("doc_id", F.inline(F.aggregate("rows", first, step, lambda acc: acc["out"])))
    return found.join(parents, ["doc_id", "seq"]).withColumn("is_root", F.col("parent_seq").isNull())


def lookup(found: DataFrame) -> DataFrame:
    """One section for each number of a document, the last one."""
    return found.groupBy("doc_id", "number").agg(F.max_by(F.struct("seq", "title", "level", "page_number"), "seq").alias("s")).select("doc_id", "number", "s.*")


def tree_order(found: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(section_key(F.col("number")), "seq")
    return found.withColumn("tree_pos", F.row_number().over(w))


def hierarchy(found: DataFrame) -> DataFrame:
    """(doc_id, number, title, level, parent_number): the parent is the longest dotted prefix that is a section."""
    known = lookup(found)
    parts = F.split("number", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    asked = known.where(F.size(parts) > 1).select("doc_id", "number", F.explode(prefixes).alias("prefix"))
    hit = asked.join(known.select("doc_id", F.col("number").alias("prefix")), ["doc_id", "prefix"])
    parent = hit.groupBy("doc_id", "number").agg(F.max_by("prefix", F.length("prefix")).alias("parent_number"))
    return known.join(parent, ["doc_id", "number"], "left")


def ancestors(known: DataFrame) -> DataFrame:
    """(doc_id, number, ancestor, label, depth): each dotted prefix that is a section, the section itself included."""
    parts = F.split("number", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), ".").alias("ancestor")))
    asked = known.select("doc_id", "number", F.explode(prefixes).alias("p")).select("doc_id", "number", "p.*")
    return asked.join(known.select("doc_id", F.col("number").alias("ancestor"), F.concat_ws(" ", "number", "title").alias("label")), ["doc_id", "ancestor"])


def full_paths(tree: DataFrame) -> DataFrame:
    """(doc_id, number, path): ``number title > number title`` from the root, of any depth: parents are shorter prefixes."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("depth", "label"))), lambda x: x["label"])
    return ancestors(tree).groupBy("doc_id", "number").agg(F.array_join(line, " > ").alias("path"))


def find_node(tree: DataFrame, number: str) -> DataFrame:
    """The rows of the section with a number, one for each document that has it."""
    return tree.where(F.col("number") == number)


def hierarchy_issues(tree: DataFrame) -> DataFrame:
    """(doc_id, number): sections whose chain of parents never ends, because it runs into itself.

    Chains double their length in each round, so the rounds grow with the logarithm of the depth.
    """
    up = tree.select("doc_id", "number", F.col("parent_number").alias("up"))
    now, rounds = up, 1
    while not (far := now.where("up IS NOT NULL")).isEmpty():
        if 2**rounds > tree.count():
            return far.select("doc_id", "number")
        step = now.select("doc_id", F.col("number").alias("up"), F.col("up").alias("beyond"))
        now = checkpoint(now.join(step, ["doc_id", "up"], "left").select("doc_id", "number", F.col("beyond").alias("up")))
        rounds += 1
    return far.select("doc_id", "number")


def node_context(tree: DataFrame) -> DataFrame:
    """(doc_id, number, parent_number, ancestors from the root, siblings, children)."""
    kids = tree.where("parent_number IS NOT NULL").groupBy("doc_id", F.col("parent_number").alias("number")).agg(F.array_sort(F.collect_list(F.col("number"))).alias("children"))
    family = kids.select("doc_id", F.col("number").alias("parent_number"), F.col("children").alias("family"))
    over = ancestors(tree).where("ancestor <> number").groupBy("doc_id", "number").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x["ancestor"]).alias("ancestors"))
    out = tree.join(kids, ["doc_id", "number"], "left").join(family, ["doc_id", "parent_number"], "left").join(over, ["doc_id", "number"], "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "number", "parent_number", F.coalesce("ancestors", none).alias("ancestors"), F.coalesce(F.array_except("family", F.array("number")), none).alias("siblings"), F.coalesce("children", none).alias("children"))


def cross_references(found: DataFrame, resolved: bool = True) -> DataFrame:
    """(doc_id, source, target, ref_type); with ``resolved`` only references to sections of the same document."""
    hits = F.concat(*[F.transform(extract_all(F.col("content"), p, 1), _typed(kind)) for p, kind in REFERENCES])
    out = found.select("doc_id", F.col("number").alias("source"), F.explode(hits).alias("r")).select("doc_id", "source", "r.target", "r.ref_type")
    if not resolved:
        return out
    return out.where("ref_type = 'section'").join(lookup(found).select("doc_id", F.col("number").alias("target")), ["doc_id", "target"]).select("doc_id", "source", "target", "ref_type")


def _typed(kind: str):
    return lambda t: F.struct(t.alias("target"), F.lit(kind).alias("ref_type"))


#: What may stand before a section's number where another section mentions it.  Fixed values.
MENTIONS = ["section", "clause", "see", "refer"]


def mentions(found: DataFrame) -> DataFrame:
    """(doc_id, source, target): sections whose lower-cased text holds a phrase of ``MENTIONS``, a space and another's number.

    The number counts as it is written and as a substring, so only numbers without capitals are ever met, and ``see 5.12``
    holds ``see 5.1``.  Each phrase with the digits after it is found, overlapping ones too, and meets the numbers of its
    document that begin with the same digit.
    """
    token = F.explode(extract_all(F.lower("content"), rf"(?=(?:{'|'.join(MENTIONS)}) (\d[\d.]*))", 1))
    asked = found.select("doc_id", F.col("number").alias("source"), token.alias("token")).withColumn("digit", F.substring("token", 1, 1)).distinct()
    known = found.select("doc_id", F.col("number").alias("target"), F.substring("number", 1, 1).alias("digit")).distinct()
    met = asked.join(known, ["doc_id", "digit"]).where(F.col("token").startswith(F.col("target")) & (F.col("source") != F.col("target")))
    return met.select("doc_id", "source", "target").distinct()


def table_sections(tables: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, table_id, number): the first section on the table's page."""
    first = found.groupBy("doc_id", "page_number").agg(F.min_by("number", "seq").alias("number"))
    return tables.join(first, ["doc_id", "page_number"]).select("doc_id", "table_id", "number")


def export(tree: DataFrame, refs: DataFrame) -> DataFrame:
    """Edges of the hierarchy and of the references, as one table."""
    up = tree.where("parent_number IS NOT NULL").select("doc_id", F.col("parent_number").alias("source"), F.col("number").alias("target"), F.lit("hierarchy").alias("edge_type"))
    return up.unionByName(refs.select("doc_id", "source", "target", F.lit("reference").alias("edge_type")))
