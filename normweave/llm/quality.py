"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text: shares of kinds of characters, word and line statistics.  The
chance that one document is better than another is the logistic function of the difference of strengths, so the
weights come from logistic loss on feature differences of preference pairs: a document labelled 1 is preferred to one
labelled 0.  All labelled rows and all their pairs count, in sums over rows only (``_Pairs``).  The threshold is an exact
quantile of the strengths of all training documents, at the share of label 0; the score is the logistic function shifted so
that this quantile scores exactly ``cut``.

Defined cases: null text is empty and gets the score of all-zero features; without labels of both kinds every score is
0.5; rows of labels that repeat or contradict each other all count; ids only choose training rows; repeated rows each get
a result; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read, text_or_empty
from .langid import held_out

_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b".", b",;:", b"!?", b"#*$%&@^~", b"|<>{}[]\\/=_", b"\"'()-+`"]
_CLASS = np.full(256, len(_KINDS) + 1, np.uint8)
for _i, _k in enumerate(_KINDS):
    _CLASS[list(_k)] = _i
_CLASS[0x80:0xC0] = len(_KINDS)  # all but the first byte of a character
FEATURES = len(_KINDS) + 2 + 9


def features(text: str) -> np.ndarray:
    raw = text.encode()
    out = np.zeros(FEATURES)
    if not raw:
        return out
    n = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=len(_KINDS) + 2)
    out[: len(n)] = np.sqrt(n / len(raw))
    words = raw.split()
    lines = raw.split(b"\n")
    if words:
        distinct = len(set(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out[len(n) :] = [
            np.log1p(len(words)) / 5,
            sizes.mean() / 10,
            sizes.std() / 10,
            distinct / len(words),
            np.log1p(distinct) / np.log1p(len(words)),
            len(set(lines)) / len(lines),
            np.log1p(len(words) / len(lines)) / 5,
            raw.count(b". ") * 10 / len(words),
            len({w for w in words if w[-1:] in b"!|%$#*&"}) / distinct,
        ]
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    cut: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        # a sum for each row, so that a score does not depend on the rows beside it
        return ((x - self.mean) / self.scale * self.weights).sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        z = self.strengths(x) - self.threshold + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


#: Distance of the grid's nodes, and how many of them a strength is spread over: the logistic function between them is then good to 1e-9.
_STEP, _NEAR = 0.125, np.arange(-3, 5)


class Rows:
    """The training rows (y, features), never collected: ``each`` gives what a function makes of every partition, in their order."""

    def __init__(self, table: DataFrame, most: int = 64):
        self.table = table.coalesce(most)  # bounds what comes back

    def each(self, part: Callable[[np.ndarray, np.ndarray], object]) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [(b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, FEATURES)) for b in batches if b.num_rows]
            if got:
                y, x = (np.concatenate(c) for c in zip(*got))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part(x, y))], pa.binary())], ["part"])

        return [pickle.loads(r["part"]) for r in self.table.mapInArrow(run, "part binary").collect()]


def _spread(strength: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes near each strength and their Lagrange weights: f(strength) is the weighted sum of f at the nodes."""
    at = np.floor(strength / _STEP)
    u = strength / _STEP - at
    weights = np.stack([np.prod([(u - m) / (k - m) for m in _NEAR if m != k], axis=0) for k in _NEAR], 1)
    return at.astype(np.int64)[:, None] + _NEAR, weights


def _rounded(x: np.ndarray) -> np.ndarray:
    """Nine digits, so that the order of a sum does not show."""
    return np.array([float(f"{v:.9g}") for v in x])


def _moments(rows: Rows) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Rows, rows labelled 1, mean and deviation."""
    n = good = 0
    mean, square = np.zeros(FEATURES), np.zeros(FEATURES)
    for k, g, m, q in rows.each(lambda x, y: (len(y), int((y == 1).sum()), x.mean(0), ((x - x.mean(0)) ** 2).sum(0))):
        square += q + (m - mean) ** 2 * (n * k / (n + k))
        mean += (m - mean) * (k / (n + k))
        n, good = n + k, good + g
    return n, good, mean, np.sqrt(square / max(n, 1))


class _Pairs:
    """Loss, gradient and curvature over all pairs of a row labelled 1 and a row labelled 0, at weights w.

    A pair counts by the difference of its strengths, so sums over all pairs are convolutions of sums over rows: each row
    is spread over the nodes of a grid near its strength, by interpolation, and node meets node instead of row meeting row.
    """

    def __init__(self, rows: Rows, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, ridge: float):
        self.rows, self.mean, self.scale, self.w = rows, mean, scale, w

        def part(x, y):
            z = (x - mean) / scale
            nodes, weights = _spread((z * w).sum(1))
            low = int(nodes.min())
            out = np.zeros((2, int(nodes.max()) - low + 1, FEATURES + 1))
            for side in (0, 1):
                of = y == side
                flat = (nodes[of] - low).ravel()
                for c in range(FEATURES + 1):
                    v = weights[of] * (z[of, c - 1 : c] if c else 1)
                    out[side, :, c] = np.bincount(flat, v.ravel(), out.shape[1])
            used = np.unique(nodes) - low
            return used + low, out[:, used]

        parts = rows.each(part)
        self.low = int(min(at[0] for at, _ in parts))
        size = int(max(at[-1] for at, _ in parts)) - self.low + 1
        self.bad, self.good = total = np.zeros((2, size, FEATURES + 1))
        for at, sums in parts:
            total[:, at - self.low] += sums
        self.pairs = self.good[:, 0].sum() * self.bad[:, 0].sum()
        d = np.clip(np.arange(1 - size, size) * _STEP, -500, 500)
        miss = 1 / (1 + np.exp(d))  # the chance that the worse one is preferred
        self.slope = miss * (1 - miss)
        self.loss = self.good[:, 0] @ self._met(np.logaddexp(0, -d), self.bad[:, :1])[:, 0] / self.pairs + ridge / 2 * (w @ w)
        up = self.good[:, 1:].T @ self._met(miss, self.bad[:, :1])[:, 0]
        down = self.bad[:, 1:].T @ self._met(miss[::-1], self.good[:, :1])[:, 0]
        self.gradient = (up - down) / self.pairs - ridge * w
        self.ridge = ridge

    @staticmethod
    def _met(kernel: np.ndarray, other: np.ndarray) -> np.ndarray:
        """At each node the sum over the others' nodes of kernel(node - other)."""
        size = len(other)
        n = 1 << int(3 * size).bit_length()
        return np.fft.irfft(np.fft.rfft(kernel, n)[:, None] * np.fft.rfft(other, n, axis=0), n, axis=0)[size - 1 : 2 * size - 1]

    def curvature(self) -> np.ndarray:
        low, mean, scale, w = self.low, self.mean, self.scale, self.w
        heavy = np.stack([self._met(self.slope, side[:, :1])[:, 0] for side in (self.good, self.bad)])  # by y: what a row meets

        def part(x, y):
            z = (x - mean) / scale
            nodes, weights = _spread((z * w).sum(1))
            return (z * (heavy[(y == 1).astype(int)[:, None], nodes - low] * weights).sum(1)[:, None]).T @ z

        cross = self.good[:, 1:].T @ self._met(self.slope, self.bad[:, 1:])
        return (sum(self.rows.each(part)) - cross - cross.T) / self.pairs + self.ridge * np.eye(FEATURES)


def _quantile(rows: Rows, strength: Callable[[np.ndarray], np.ndarray], n: int, share: float) -> float:
    """The exact quantile, between two neighbours in order in proportion: their bits are found 16 at a time, from the first."""
    place = (n - 1) * share
    first = int(place)
    found = []
    ranks = {k: (0, k) for k in (first, min(first + 1, n - 1))}  # bits so far, rank among the rows that have them
    for shift in (48, 32, 16, 0):
        asked = {bits for bits, _ in ranks.values()}

        def part(x, y, shift=shift, asked=asked):
            bits = (strength(x) + 0.0).view(np.uint64)
            sign = np.uint64(1 << 63)
            keys = np.where(bits & sign, ~bits, bits | sign)  # in the order of the numbers
            above = keys >> np.uint64(shift + 16) if shift < 48 else np.zeros_like(keys)
            return {a: np.unique((keys[above == np.uint64(a)] >> np.uint64(shift)) & np.uint64(0xFFFF), return_counts=True) for a in asked}

        counts = {a: np.zeros(1 << 16, np.int64) for a in asked}
        for got in rows.each(part):
            for a, (which, many) in got.items():
                counts[a][which.astype(np.int64)] += many
        for k, (bits, rank) in ranks.items():
            upto = np.cumsum(counts[bits])
            hit = int(np.searchsorted(upto, rank, "right"))
            ranks[k] = bits << 16 | hit, rank - int(upto[hit] - counts[bits][hit])
    for bits, _ in ranks.values():
        found.append(float(np.array([bits ^ (1 << 63) if bits >> 63 else bits ^ (1 << 64) - 1], np.uint64).view(np.float64)[0]))
    return found[0] + (place - first) * (found[-1] - found[0])


def bradley_terry(rows: Rows, *, cut: float = 0.3, rounds: int = 50, ridge: float = 1e-3) -> Model:
    """Fits the weights by damped Newton steps on all preference pairs of all rows."""
    n, good, mean, scale = _moments(rows)
    if not 0 < good < n:
        return Model(np.zeros(0), np.ones(0), np.zeros(0), 0.0, cut)
    mean, scale = _rounded(mean), _rounded(scale + 1e-6)
    now = _Pairs(rows, mean, scale, np.zeros(FEATURES), ridge)
    for _ in range(rounds):
        move = np.linalg.solve(now.curvature(), now.gradient)
        new = _Pairs(rows, mean, scale, now.w + move, ridge)
        while new.loss > now.loss + 1e-9 and np.abs(move).max() >= 1e-8:
            move = move / 2
            new = _Pairs(rows, mean, scale, now.w + move, ridge)
        now = new
        if np.abs(move).max() < 1e-6:  # the error after a Newton step goes with the square of it
            break
    model = Model(mean, scale, _rounded(now.w), 0.0, cut)
    model.threshold = _quantile(rows, model.strengths, n, (n - good) / n)
    return model


def with_features(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns of keep plus ``features``."""
    asked = docs.select(*keep, text_or_empty(text_col).alias("__text"))
    schema = asked.drop("__text").withColumn("features", F.array().cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([features(t.as_py()) for t in b.column(b.num_columns - 1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], got], [*b.schema.names[:-1], "features"])

    return asked.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, cut: float = 0.3) -> Model:
    """Fits on every labelled row."""
    scratch = Scratch(docs.sparkSession, "quality")
    model = fit_features(with_features(docs, text_col, [id_col]), labels, id_col, label_col, cut=cut, scratch=scratch)
    scratch.clear()
    return model


def fit_features(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", *, cut: float = 0.3, scratch: Scratch) -> Model:
    """``fit`` on a result of ``with_features``."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    rows = found.join(known, found[id_col] == known["__id"]).sortWithinPartitions("__id", "__y")
    table = scratch.keep(rows.select("__y", "features"))
    model = bradley_terry(Rows(table), cut=cut)
    scratch.drop(table)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's rows and columns without the text, plus ``score``, which replaces a column with that name."""
    keep = [c for c in docs.columns if c not in (text_col, "score")]
    asked = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text_col).alias("__text"))
    asked = asked.toDF(*[f"c{i}" for i in range(len(keep))], "__text")  # names with a dot are no names for mapInArrow
    schema = asked.drop("__text").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(b.num_columns - 1)]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.scores(x))], [*b.schema.names[:-1], "score"])

    return asked.mapInArrow(run, schema).toDF(*keep, "score")


def score_features(found: DataFrame, model: Model) -> DataFrame:
    """``score`` on a result of ``with_features``."""
    schema = found.drop("features").withColumn("score", F.lit(0.0)).schema
    asked = found.select(*schema.names[:-1], "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.num_columns - 1).flatten().to_numpy().reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.scores(x))], [*b.schema.names[:-1], "score"])

    return asked.mapInArrow(run, schema)


def op10_quality_classifier(spark, sf_dir):
    scratch = Scratch(spark, "quality")
    found = scratch.keep(with_features(read(spark, sf_dir, "documents"), "text", ["doc_id"]))  # a text is read once
    model = fit_features(found, read(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)), scratch=scratch)
    out = score_features(found, model)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= model.cut).cast("int").alias("predicted"))
