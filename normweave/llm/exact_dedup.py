"""Exact dedup by a tree merge of sorted digest runs (native).

Each row becomes (SHA-256 of the text without white space, its length, code points of the text, id); texts are not moved
again.  The rows are dealt into ``2**rounds`` runs by id, so that a hot group is spread over all of them.  A run is
sorted by digest and holds one row for each digest: the best identifier and the number of rows.  In round r the runs
whose numbers differ in bit r meet; they are merged by digest and the best identifier of each digest is retained.  After
the last round one run is left, dealt over the cluster by digest, never in one task.  A merge only joins entries whose
256-bit digest and normalised length are both equal.

Defined cases: null text is the empty text; null ids lose against any other among texts of equal length; of rows with
equal digest, code points and id (repeated rows) exactly one is kept; an empty table gives an empty result; a column named
``exact_dedup`` in the input is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read, text_or_empty, without_white


def _merge(runs: DataFrame, *by: str) -> DataFrame:
    return runs.groupBy(*by, "digest", "size").agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rounds: int = 3) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row.

    Of texts that are equal without white space the row with the most code points stays, then the one with the smallest
    id.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    norm = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    norm = norm.select("id", F.char_length("text").alias("points"), without_white(F.col("text")).alias("norm"))
    rows = scratch.keep(norm.select("id", "points", F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").alias("size")))
    # ~id falls as the id rises and, unlike -id, cannot overflow; a null is the least value of a struct
    runs = rows.select("digest", "size", F.struct("points", F.bitwise_not("id").alias("not_id")).alias("best"), F.lit(1).cast("long").alias("n"), F.pmod(F.xxhash64("id"), F.lit(1 << rounds)).alias("run"))
    runs = _merge(runs, "run")
    for _ in range(rounds):
        runs = _merge(runs.withColumn("run", F.shiftright("run", 1)), "run")
    final = runs.select("digest", "size", F.bitwise_not("best.not_id").alias("keep_id"), F.col("best.points").alias("keep_points"), F.col("n").alias("group_size"))
    final = scratch.keep(final)
    out = rows.join(final, ["digest", "size"])
    best = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    # repeated rows: one stays; the numbers run within (digest, id), so a hot group does not gather
    w = Window.partitionBy("digest", "id", "points").orderBy("size")
    kept = best & (F.row_number().over(w) == 1)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op4_exact_dedup(spark, sf_dir):
    return dedup_exact(read(spark, sf_dir, "documents"))


ORACLE = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(translate(coalesce(text, ''), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
