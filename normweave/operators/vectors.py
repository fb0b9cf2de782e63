"""Exact vector search by cosine similarity, and its expansion over a graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import related


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def search(vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
    """The k rows of (id, embedding, ...) most like the query: the filter reaches the scan, the sort keeps k rows a task."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    length = sum(float(x) ** 2 for x in query) ** 0.5
    scored = rows.withColumn("score", F.when(norm("embedding") * length > 0, dot("embedding", q) / (norm("embedding") * F.lit(length))))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 10, *, most: int = 4096) -> DataFrame:
    """(query_id, id, score, rank) for a stated table of at most ``most`` queries (query_id, q); more are an error.

    The queries go to every task as one matrix; each block of vectors meets it in one product and keeps k rows a query.
    """
    asked = queries.select("query_id", F.transform("q", lambda x: x.cast("double")).alias("q")).limit(most + 1).collect()
    if len(asked) > most:
        raise ValueError(f"more than {most} queries")
    schema = "query_id long, id long, score double"
    if not asked:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    matrix, names = np.array([r["q"] for r in asked]), np.array([r["query_id"] for r in asked], np.int64)
    lengths = np.sqrt((matrix**2).sum(1))
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                v = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(len(ids), -1)
                size = lengths[:, None] * np.sqrt((v**2).sum(1))
                score = np.divide(shared.value @ v.T, size, out=np.full(size.shape, -np.inf), where=size > 0)
                if score.shape[1] > k:  # all that tie with the k-th score stay
                    row, at = np.nonzero(score >= np.partition(score, -k, axis=1)[:, -k, None])
                else:
                    row, at = np.nonzero(np.ones(score.shape, bool))
                got = score[row, at]
                yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(ids[at]), pa.array(got, mask=np.isinf(got))], ["query_id", "id", "score"])

    scored = vectors.select(F.col("id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("v")).mapInArrow(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Scores of what the graph adds, by type of node; other types add nothing.  Fixed values.
EXPANSION = {"section": 0.7, "formula": 0.8, "table": 0.6}
#: Edges that are followed.
FOLLOWED = ["contains", "shares_variable", "references"]


def expand(hits: DataFrame, nodes: DataFrame, edges: DataFrame, per_hit: int = 3) -> DataFrame:
    """Context items from the neighbours of hits (rank, id): the first ``per_hit`` of each, out-edges before in-edges.

    nodes: (node_id, node_type, label, properties).  A node that an earlier hit added is left out.
    (rank, rn, id, type, score, content, section_number, section_title, page_number, item_id, formula_type, variables, reason)
    """
    near = related(edges, hits.select(F.col("id").alias("node_id")).distinct(), FOLLOWED, per_hit)
    rows = hits.select("rank", F.col("id").alias("node_id")).join(near, "node_id").select("rank", "rn", F.col("related").alias("node_id")).join(nodes, "node_id").where(F.col("node_type").isin(list(EXPANSION)))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("node_id").orderBy("rank", "rn"))).where("nth = 1")
    kind, prop = F.col("node_type"), lambda name: F.col("properties")[name]
    score = F.element_at(F.create_map(*[F.lit(x) for kv in EXPANSION.items() for x in kv]), kind)
    content = (
        F.when(kind == "section", F.coalesce(prop("content_preview"), F.lit("")))
        .when(kind == "formula", F.concat(F.lit("Formula: "), "label", F.lit("\nVariables: "), F.coalesce(prop("variables"), F.lit(""))))
        .otherwise(F.concat(F.lit("Table: "), "label", F.lit(" on page "), F.coalesce(prop("page_number"), F.lit("Unknown"))))
    )
    section = lambda c: F.when(kind == "section", c)
    return rows.select(
        "rank", "rn", F.col("node_id").alias("id"), kind.alias("type"), score.alias("score"), content.alias("content"),
        section(prop("section_number")).alias("section_number"), section(F.col("label")).alias("section_title"), F.when(kind != "formula", prop("page_number")).alias("page_number"),
        F.when(kind != "section", F.element_at(F.split("node_id", "_"), -1)).alias("item_id"),
        F.when(kind == "formula", prop("formula_type")).alias("formula_type"), F.when(kind == "formula", prop("variables")).alias("variables"), F.concat(F.lit("related_"), kind).alias("reason"),
    )


def context(hits: DataFrame, added: DataFrame, wanted: list[str] | None = None, most: int = 15) -> DataFrame:
    """Hits in order, then what the graph added in the order of its hit; those whose title holds a wanted section come first; at most ``most`` rows.

    hits: (rank, id, score) and, for wanted sections, section_title.
    """
    title = F.col("section_title") if "section_title" in hits.columns else F.lit(None).cast("string")
    a = hits.select(F.lit(0).alias("part"), "rank", F.lit(0).alias("rn"), "id", "score", F.lit("hit").alias("origin"), title.alias("section_title"))
    b = added.select(F.lit(1).alias("part"), "rank", "rn", "id", "score", F.lit("graph").alias("origin"), "section_title")
    asked = F.array(*[F.lit(w.lower()) for w in wanted or []]).cast("array<string>")
    first = F.coalesce(F.exists(asked, lambda w: F.contains(F.lower(F.coalesce("section_title", F.lit(""))), w)), F.lit(False))
    return a.unionByName(b).withColumn("first", first).orderBy(F.desc("first"), "part", "rank", "rn").limit(most)
