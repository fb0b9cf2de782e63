"""Specification text derived from the part table, by the same expressions in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of one part, as SQL that Spark and DuckDB read alike but for the newline.
_TEXT = """concat(CAST(1 + p_partkey % 9 AS STRING), '.', CAST(1 + p_size % 5 AS STRING), ' ', p_name, NL,
 'Maximum size shall not exceed ', CAST(p_size AS STRING), ' mm.', NL,
 'If size > ', CAST(p_size AS STRING), ', then use ', p_type, '.', NL,
 'Q = n × ', CAST(p_size AS STRING), NL, 'where n is the number of cars, let Q be the flow', NL, 'T = Q × 2', NL, '6 × ', CAST(p_size AS STRING), ' = ', CAST(6 * p_size AS STRING), NL,
 'See Section ', CAST(1 + (p_partkey + 1) % 9 AS STRING), '.', CAST(1 + p_size % 5 AS STRING), ' for details.')"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text), one document for each part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("doc_id"), F.expr(_TEXT.replace("NL", "char(10)")).alias("text"))


#: DuckDB's relation of the same rows, to stand in a WITH clause.
TEXTS = f"texts AS (SELECT p_partkey AS doc_id, {_TEXT.replace('NL', 'chr(10)').replace('STRING', 'VARCHAR')} AS text FROM part)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, text): twenty parts make a document of four pages, with a chapter at the head of each page."""
    one = texts(spark, sf_dir).withColumn("k", F.col("doc_id")).select((F.floor(F.col("k") / 20)).cast("long").alias("doc_id"), (1 + F.floor((F.col("k") % 20) / 5)).cast("int").alias("page_no"), "k", "text")
    head = F.when(F.col("k") % 5 == 0, F.concat((1 + F.col("k") % 9).cast("string"), F.lit(" General part\n"))).otherwise("")
    text = F.concat(head, F.col("text"))
    return one.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


PAGES = f"""{TEXTS}, pages_ AS (
 SELECT CAST(doc_id // 20 AS BIGINT) AS doc_id, CAST(1 + (doc_id % 20) // 5 AS INTEGER) AS page_no,
        string_agg(CASE WHEN doc_id % 5 = 0 THEN concat(CAST(1 + doc_id % 9 AS VARCHAR), ' General part', chr(10)) ELSE '' END || text, chr(10) ORDER BY doc_id) AS text
 FROM texts GROUP BY ALL)"""

#: Lines and sections in SQL.  Headers are numbered lines here: the other forms do not occur in the derived text.
SECTIONS = (
    PAGES
    + r""", raw_lines AS (SELECT doc_id, page_no, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'line': trim(x)})) AS l FROM pages_),
lines AS (SELECT doc_id, page_no, l.i AS i, l.line AS line, regexp_matches(l.line, '^(\d+(?:\.\d+)*)\s+(.+?)$') OR regexp_matches(l.line, '^([A-Z](?:\.\d+)*)\s+(.+?)$') AS is_h FROM raw_lines WHERE l.line <> ''),
grouped AS (SELECT *, greatest(count(*) FILTER (is_h) OVER (PARTITION BY doc_id, page_no ORDER BY i), 1) AS h FROM lines),
sec0 AS (SELECT doc_id, page_no, h, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT is_h), '') AS content, min(line) FILTER (is_h) AS header FROM grouped GROUP BY ALL HAVING count(*) FILTER (is_h) > 0),
sec1 AS (SELECT doc_id, page_no AS page_number, content, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, h) AS INTEGER) AS seq,
  CASE WHEN regexp_matches(header, '^\d') THEN regexp_extract(header, '^(\d+(?:\.\d+)*)\s+(.+?)$', 1) ELSE regexp_extract(header, '^([A-Z](?:\.\d+)*)\s+(.+?)$', 1) END AS number,
  CASE WHEN regexp_matches(header, '^\d') THEN regexp_extract(header, '^(\d+(?:\.\d+)*)\s+(.+?)$', 2) ELSE regexp_extract(header, '^([A-Z](?:\.\d+)*)\s+(.+?)$', 2) END AS title FROM sec0),
sections_ AS (SELECT *, CAST(length(number) - length(replace(number, '.', '')) + 1 AS INTEGER) AS level FROM sec1),
known AS (SELECT doc_id, number, max_by(title, seq) AS title, CAST(max_by(level, seq) AS INTEGER) AS level FROM sections_ GROUP BY ALL)"""
)
