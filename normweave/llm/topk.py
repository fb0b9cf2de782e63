"""Exact top-k by inner product: a Voronoi kNN join.

About sqrt(n) vectors are pivots, which divide the vectors into cells.  A cell's summary is its size, the distance of its farthest
vector from the pivot, the range of its vectors along the pivot's direction, their largest distance from that axis, and
their largest norm: one row for each pivot.  With q the query, b the pivot, u its direction and q' the rest of q across u,
no score in the cell exceeds the least of q.b + |q| far, max(q.u lo, q.u hi) + |q'| off, and |q| norm.  A query first meets
its own cell (and the next best ones until they hold k vectors), which gives it a k-th best score; it is then sent only to
the groups of cells whose bound reaches that.  Neighbouring cells form groups of at most ``chunk`` vectors and a larger cell
is dealt in parts, so a cell that holds a third of the rows is many tasks and small cells are no more messages than need be.
Queries move, vectors do not, unless a group is asked by more than ``ask`` queries: then each block of queries gets a copy.
A group is solved by one matrix product; the scores are integers below 2**53 and so exact in double precision.

Where vectors lie evenly in many dimensions no bound can exclude a cell, and every group is asked; clustered vectors are pruned.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; a shorter vector counts as filled
up with zeros; a repeated id is one candidate for each of its rows; with another vector it is another query with its own
ranking, rows that repeat both are one query (the query's own id is never its candidate); ties go to the smaller id; other columns may have
any names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read

SCALE = 256


def _valid(vec: str) -> Column:
    x = F.col(f"`{vec}`")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & fine, F.lit(False))


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): whole numbers, floor(256 x).  Of floats they are floats again, without loss."""
    kind = "float" if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else "double"
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: F.floor(x.cast("double") * SCALE).cast(kind) if kind == "double" else F.floor(x.cast("double") * SCALE).cast("double").cast("float"))
    return vectors.where(_valid(vec_col)).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull())


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows, filled up with zeros."""
    flat, ends = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64), np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))
    if len(flat) == len(col) * width:
        return flat.reshape(-1, width)
    out = np.zeros((len(col), width))
    for i, (lo, hi) in enumerate(zip([0, *ends], ends)):
        out[i, : hi - lo] = flat[lo:hi]
    return out


@dataclass
class Cells:
    """Pivots and, once ``told`` of them, the cells' summaries and groups."""

    pivots: np.ndarray

    def __post_init__(self):
        self.norms = np.sqrt((self.pivots**2).sum(1))
        self.axes = self.pivots / np.maximum(self.norms, 1e-300)[:, None]

    def nearest(self, v: np.ndarray) -> np.ndarray:
        return (self.norms**2 - 2 * v @ self.pivots.T).argmin(1)

    def told(self, rows: list, chunk: int) -> None:
        m = len(self.pivots)
        self.size = np.zeros(m, np.int64)
        self.far, self.lo, self.hi, self.off, self.norm = (np.zeros(m) for _ in range(5))
        for r in rows:
            c = r["cell"]
            self.size[c], self.far[c], self.lo[c], self.hi[c], self.off[c], self.norm[c] = r["n"], r["far"], r["lo"], r["hi"], r["off"], r["norm"]
        # neighbours: cells by the nearest of a few pivots; consecutive ones make a group
        few = Cells(self.pivots[:: max(1, int(m**0.5))])
        self.group, self.parts, held = np.zeros(m, np.int32), [], 0
        for c in np.lexsort((np.arange(m), few.nearest(self.pivots))):
            if not self.parts or held + self.size[c] > chunk:
                self.parts.append(1)
                held = 0
            held += int(self.size[c])
            self.group[c] = len(self.parts) - 1
            self.parts[-1] = max(1, -(-held // chunk))
        self.n_groups = len(self.parts)

    def best(self, q: np.ndarray) -> np.ndarray:
        """No score of query i in cell c exceeds [i, c]."""
        length = np.sqrt((q * q).sum(1))[:, None]
        along = q @ self.axes.T
        across = np.sqrt(np.maximum(length**2 - along**2, 0))
        ball = q @ self.pivots.T + length * self.far
        tube = np.maximum(along * self.lo, along * self.hi) + across * self.off
        out = np.minimum(np.minimum(ball, tube), length * self.norm) * (1 + np.sign(ball) * 1e-9) + length * 1e-6 + 1e-3
        return np.where(self.size > 0, out, -np.inf)

    def home(self, q: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """[i, g]: groups that hold the query's cell and, by falling bound, cells until there are over k vectors."""
        bound = self.best(q)
        bound[np.arange(len(q)), own] = np.inf
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        row, place = np.nonzero(before <= k)
        out = np.zeros((len(q), self.n_groups), bool)
        out[row, self.group[order[row, place]]] = True
        return out

    def asked(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """[i, g]: groups with a cell whose bound reaches least."""
        row, cell = np.nonzero((self.best(q) >= least[:, None]) & (self.size > 0))
        out = np.zeros((len(q), self.n_groups), bool)
        out[row, self.group[cell]] = True
        return out


def _solver(k: int, width: int):
    def solve(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            c = c.sort_values("id", kind="stable")
            ids, C = c["id"].to_numpy(), _matrix(pa.array(c["v"].tolist(), pa.list_(pa.float64())), width)
            for lo in range(0, len(q), 512):
                block = q.iloc[lo : lo + 512]
                qid, key = block["id"].to_numpy(), block["key"].to_numpy()
                S = _matrix(pa.array(block["v"].tolist(), pa.list_(pa.float64())), width) @ C.T
                S[qid[:, None] == ids[None, :]] = -np.inf
                S[S < block["least"].to_numpy()[:, None]] = -np.inf
                if S.shape[1] > k:  # all that tie with the k-th score stay in play
                    kth = np.partition(S, S.shape[1] - k, axis=1)[:, S.shape[1] - k, None]
                    S[S < kth] = -np.inf
                r, j = np.nonzero(S > -np.inf)
                got = pd.DataFrame({"query_id": qid[r], "key": key[r], "id": ids[j], "score": S[r, j].astype(np.int64)})
                out.append(got.sort_values(["query_id", "key", "score", "id"], ascending=[True, True, False, True]).groupby(["query_id", "key"]).head(k))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "key": [], "id": [], "score": []}).astype("int64")

    return solve


def _ranked(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, id_col: str, vec_col: str, *, k: int = 5, every: int = 50, pivots: int | None = None, chunk: int = 8192, ask: int = 65536) -> DataFrame:
    """(query_id, rank, id, score): the k best of each query, the rows whose id is divisible by ``every``.

    ``pivots`` vectors (the square root of their number) with the least hash of the id are the pivots; they and the cells'
    summaries are all that the driver sees.
    """
    return routed(vectors, id_col, vec_col, k=k, every=every, pivots=pivots, chunk=chunk, ask=ask)[0]


def routed(vectors: DataFrame, id_col: str, vec_col: str, *, k: int, every: int, pivots: int | None, chunk: int, ask: int) -> tuple[DataFrame, dict[str, int]]:
    """What ``top_k`` returns, and counts: queries, groups, and how often a query was sent to a group."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = quantised(vectors, id_col, vec_col)
    told = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not told["n"]:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long"), {"queries": 0, "groups": 0, "sent": 0}
    width, most = told["width"], pivots or max(16, int(np.ceil(told["n"] ** 0.5)))
    picked = rows.select("id", "v", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(most).collect()
    cells = Cells(_matrix(pa.array([r["v"] for r in picked], pa.list_(pa.float64())), width))
    shared = spark.sparkContext.broadcast(cells.pivots)  # sqrt(n) vectors
    v_type = rows.schema["v"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cells(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                V = _matrix(part.column(1), width)
                cell = own.nearest(V)
                far = np.sqrt(((V - own.pivots[cell]) ** 2).sum(1))
                along = (V * own.axes[cell]).sum(1)
                off = np.sqrt(((V - along[:, None] * own.axes[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far), pa.array(along), pa.array(off), pa.array(np.sqrt((V * V).sum(1)))], ["id", "v", "cell", "far", "along", "off", "norm"])

    rows = scratch.keep(rows.mapInArrow(assign, f"id long, v {v_type}, cell int, far double, along double, off double, norm double"))
    cells.told(rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.min("along").alias("lo"), F.max("along").alias("hi"), F.max("off").alias("off"), F.max("norm").alias("norm")).collect(), chunk)
    known = spark.sparkContext.broadcast(cells)
    # a row for each pivot
    place = spark.createDataFrame([(int(c), int(g), int(cells.parts[g])) for c, g in enumerate(cells.group)], "cell int, g int, parts int")
    placed = rows.select("id", "v", "cell").join(F.broadcast(place), "cell").select("id", "v", "g", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    queries = scratch.keep(rows.where(F.col("id") % every == 0).select("id", F.xxhash64("v").alias("key"), "v", "cell").dropDuplicates(["id", "key"]))

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = known.value
            for b in batches:
                for lo in range(0, b.num_rows, 512):
                    some = b.slice(lo, 512)
                    Q, cell, least = _matrix(some.column(2), width), some.column(3).to_numpy(zero_copy_only=False), some.column(4).to_numpy(zero_copy_only=False)
                    home = own.home(Q, cell, k)
                    row, g = np.nonzero(home if first else own.asked(Q, least) & ~home)
                    reps = np.array(own.parts)[g]
                    at = np.repeat(np.arange(len(row)), reps)
                    part = np.arange(len(at)) - np.repeat(np.cumsum(reps) - reps, reps)
                    whose = pa.array(row[at])
                    yield pa.RecordBatch.from_arrays([*(some.column(i).take(whose) for i in range(3)), some.column(4).take(whose), pa.array(g[at].astype(np.int32)), pa.array(part.astype(np.int32))], ["id", "key", "v", "least", "g", "part"])

        return run

    sent = 0

    def solved(asked: DataFrame, first: bool) -> DataFrame:
        nonlocal sent
        out = asked.mapInArrow(route(first), f"id long, key long, v {v_type}, least double, g int, part int")
        counts = {r["g"]: r["n"] for r in out.where("part = 0").groupBy("g").agg(F.count("*").alias("n")).collect()}  # a row for each group
        sent += sum(counts.values())
        blocks = spark.createDataFrame([(int(g), -(-n // ask)) for g, n in counts.items()], "g int, asks int")
        out = out.join(F.broadcast(blocks), "g").withColumn("ask", F.pmod(F.xxhash64("id", "key"), F.col("asks")).cast("int")).drop("asks")
        cands = placed.join(F.broadcast(blocks), "g").select("id", "v", "g", "part", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"))
        keys = ["g", "part", "ask"]
        return out.groupBy(*keys).cogroup(cands.groupBy(*keys)).applyInPandas(_solver(k, width), "query_id long, key long, id long, score long")

    near = scratch.keep(_ranked(solved(queries.withColumn("least", F.lit(float("-inf"))), True), k).drop("rank"))
    reached = near.groupBy(F.col("query_id").alias("id"), "key").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least"))
    asked = queries.join(reached, ["id", "key"], "left").select("id", "key", "v", "cell", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    far = solved(asked, False)
    counts = {"queries": queries.count(), "groups": cells.n_groups, "sent": sent}
    return _ranked(near.unionByName(far), k).select("query_id", "rank", "id", "score"), counts


def op5_exact_topk(spark, sf_dir):
    return top_k(read(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
