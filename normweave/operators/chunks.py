"""Overlapping chunks of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ")
SCHEMA = "doc_id long, chunk_index int, chunk_start long, chunk_end long, content string"


def windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Each next window begins ``overlap`` before the end of the last; the end is the last separator in its second half."""
    start, n = 0, len(text)
    while start < n:
        end = start + size
        if end < n:
            for sep in SEPARATORS:
                at = text.rfind(sep, start, end)
                if at > start + size // 2:
                    end = at + len(sep)
                    break
        yield start, end
        start = end - overlap if end < n else end


def create_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_index, chunk_start, chunk_end, content); blank chunks are not counted, the last end may pass the text's.

    The next window depends on the last one, which no built-in function iterates fast: Arrow batches in, chunks out, no shuffle.
    """
    if overlap * 2 >= size:
        raise ValueError("overlap must be under half the size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k = 0
                for start, end in windows(text or "", size, overlap):
                    content = text[start:end].strip()
                    if content:
                        for col, v in zip(out, (doc, k, start, end, content)):
                            col.append(v)
                        k += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "chunk_index", "chunk_start", "chunk_end", "content"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def neighbours(chunks: DataFrame, around: int = 1) -> DataFrame:
    """(doc_id, chunk_index, near): chunks of the document at a distance of at most ``around``, by an equi-join."""
    asked = chunks.select("doc_id", "chunk_index", F.explode(F.array(*[F.lit(d) for d in range(-around, around + 1) if d])).alias("d")).select("doc_id", "chunk_index", (F.col("chunk_index") + F.col("d")).alias("near"))
    return asked.join(chunks.select("doc_id", F.col("chunk_index").alias("near"), F.col("content").alias("near_content")), ["doc_id", "near"])


def with_context(hits: DataFrame, chunks: DataFrame, around: int = 1) -> DataFrame:
    """Hits (doc_id, chunk_index) with ``content``: the hit's chunk and those beside it, in order, with blank lines between."""
    asked = hits.select("doc_id", "chunk_index", F.explode(F.sequence(F.col("chunk_index") - around, F.col("chunk_index") + around)).alias("near"))
    met = asked.join(chunks.select("doc_id", F.col("chunk_index").alias("near"), "content"), ["doc_id", "near"])
    text = F.transform(F.array_sort(F.collect_list(F.struct("near", "content"))), lambda x: x["content"])
    return met.groupBy("doc_id", "chunk_index").agg(F.array_join(text, "\n\n").alias("content"))


def section_chunks(sections: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(chunk_id, doc_id, type, section_number, content) from sections (doc_id, seq, number, content)."""
    keyed = sections.select(F.xxhash64("doc_id", "seq").alias("key"), "doc_id", "number", "content")
    cut = create_chunks(keyed.select(F.col("key").alias("doc_id"), F.col("content").alias("text")), size, overlap).withColumnRenamed("doc_id", "key")
    out = cut.join(keyed.select("key", F.col("doc_id"), "number"), "key")
    return out.select(F.format_string("%s_sec_%s_chunk_%d", F.col("doc_id").cast("string"), "number", "chunk_index").alias("chunk_id"), "doc_id", F.lit("section").alias("type"), F.col("number").alias("section_number"), "content")


def table_chunks(tables: DataFrame, markdown: DataFrame) -> DataFrame:
    out = tables.join(markdown, "table_id")
    return out.select(F.format_string("%s_table_%s", F.col("doc_id").cast("string"), "table_id").alias("chunk_id"), "doc_id", F.lit("table").alias("type"), F.lit(None).cast("string").alias("section_number"), F.concat(F.lit("Table on page "), F.col("page_number").cast("string"), F.lit(":\n"), F.col("markdown")).alias("content"))


def formula_chunks(formulas: DataFrame) -> DataFrame:
    content = F.concat(F.lit("Formula: "), "raw_text", F.lit("\nVariables: "), F.array_join("variables", ", "), F.when(F.col("context") != "", F.concat(F.lit("\nContext: "), "context")).otherwise(""))
    return formulas.select(F.format_string("%s_formula_%d", F.col("doc_id").cast("string"), "formula_no").alias("chunk_id"), "doc_id", F.lit("formula").alias("type"), F.lit(None).cast("string").alias("section_number"), content.alias("content"))


def all_chunks(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
