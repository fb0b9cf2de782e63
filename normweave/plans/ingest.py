"""Ingestion: pages in, all derived tables out, as one set of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title
from ..operators import chunks, formulas, graph, rules, sections, tables


@dataclass
class Document:
    documents: DataFrame
    sections: DataFrame
    formulas: DataFrame
    rules: DataFrame
    xrefs: DataFrame
    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame
    tables: DataFrame | None = None


def ingest(pages: DataFrame, cells: DataFrame | None = None) -> Document:
    """pages (doc_id, page_no, text); cells (doc_id, page_number, table_id, flavor, r, c, text), table ids being unique.

    Sections, formulas and tables, which most of the others are made of, are computed and written once; the others are lazy.
    """
    found = graph.stored(sections.sections(pages))
    raw = sections.raw_text(pages)
    # formulas come from each section, numbered within the document in its order
    texts = found.select(F.struct("doc_id", "seq", "number").alias("doc_id"), F.col("content").alias("text"))
    forms = formulas.formulas(texts)
    place = F.struct(F.col("doc_id.seq"), F.col("formula_no"))
    order = forms.withColumn("at", place).withColumn("number", F.col("doc_id.number")).withColumn("seq", F.col("doc_id.seq")).withColumn("doc_id", F.col("doc_id.doc_id"))
    forms = graph.stored(order.withColumn("formula_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))).drop("at"))
    docs = raw.withColumn("title", title(F.col("raw_text")))
    counts = found.groupBy("doc_id").agg(F.count_if("is_root").alias("n_sections"))
    n_formulas = forms.groupBy("doc_id").agg(F.count("*").alias("n_formulas"))
    parts = [chunks.section_chunks(found), chunks.formula_chunks(forms)]
    own = of = ideas = None
    n_tables = raw.select("doc_id").limit(0).withColumn("n_tables", F.lit(0).cast("long"))
    if cells is not None:
        place = cells.groupBy("table_id").agg(F.min("doc_id").alias("doc_id"), F.min("page_number").alias("page_number"))
        first = graph.stored(tables.distinct_tables(cells.select("table_id", "flavor", "r", "c", "text")))
        kept, below = tables.process(first)
        own = graph.stored(kept.join(place, "table_id").withColumn("title", F.lit(None).cast("string")))
        of = sections.table_sections(own, found)
        ideas = tables.concepts(tables.clean_cells(first)).join(own.select("table_id", "doc_id"), "table_id")
        parts.append(chunks.table_chunks(own, tables.markdown(kept, below)))
        n_tables = own.groupBy("doc_id").agg(F.count("*").alias("n_tables"))
    docs = docs.join(counts, "doc_id", "left").join(n_formulas, "doc_id", "left").join(n_tables, "doc_id", "left").na.fill(0, ["n_sections", "n_formulas", "n_tables"])
    nodes, edges = graph.build(docs, found, forms, sections.mentions(found), formulas.shared_variables(forms), own, of, ideas)
    return Document(docs, found, forms, rules.extract_rules(docs.select("doc_id", F.col("raw_text").alias("text"))), sections.cross_references(found), chunks.all_chunks(*parts), nodes, edges, own)
