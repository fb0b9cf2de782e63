"""Language identification of mixed text.

Fitting counts, for each language, the script of its letters and the hashed character n-grams (1 to 3, with word edges) of
its words, over a bounded number of whole labelled texts of each language.  Prediction splits a text into words.  A word's script narrows the
candidates to languages that were seen to use it; each candidate's score is the mean log-probability of the word's
n-grams times a weight for its length.  Viterbi over the words, with a penalty for each switch, labels spans of one
language.  The text gets the language whose spans hold the most letters, and their share as its score.

Words are scored once for each worker; Viterbi advances all texts of a batch together, longest first.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a script that no language was seen to use
leaves all candidates; without any labelled row everything is ``und``; ids are not used; repeated rows each get a result;
equal scores go to the language that comes first in order; texts of any length are read whole; other columns may have any
names, ``lang_pred`` and ``lang_score`` are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, resident

#: Starts of Unicode ranges by script; a letter belongs to the last start at or before it.
SCRIPTS = [(0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Asian"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x31A0, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"), (0x20000, "Han")]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
#: Letters, and numbers that are no digits (such as 2 raised), which count as no letters below.
WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 15


def script(word: str) -> str:
    return SCRIPTS[int(np.searchsorted(_STARTS, ord(word[0]), "right")) - 1][1]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams (1 to 3) of all words at once, and the number of the word that each belongs to."""
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    h, out, whose = np.zeros(len(code), np.uint64), [], []
    for n in (1, 2, 3):
        tail = code[n - 1 :]
        h = (h[: len(tail)] * np.uint64(1_000_003) + tail + np.uint64(n)) * np.uint64(0x9E3779B1)
        whole = owner[: len(tail)] == owner[n - 1 :]
        out.append(((h[whole] >> np.uint64(13)) % np.uint64(BUCKETS)).astype(np.int64))
        whose.append(owner[: len(tail)][whole])
    return np.concatenate(out), np.concatenate(whose)


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # BUCKETS x languages, log-probabilities
    allowed: dict[str, np.ndarray]  # script -> which languages

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of the words: a row for each, a column for each language."""
        lower = [w.lower() for w in words]
        gram, owner = _grams(lower)
        n = np.bincount(owner, minlength=len(words))
        score = np.stack([np.bincount(owner, self.grams[gram, k], len(words)) for k in range(len(self.langs))], 1)
        score *= (np.minimum([len(w) for w in words], 12) ** 0.5 / n)[:, None]
        none = np.ones(len(self.langs), bool)
        fine = np.array([self.allowed.get(script(w), none) for w in words])
        return np.where(fine, score, score.min(1, keepdims=True) - 50.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, l) to (lang, script, at, n): how often each bucket (script null) and how many letters of each script occur."""
    words: dict[str, dict[str, int]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, own in words.items():
            gram, owner = _grams([w.lower() for w in own])
            counts = np.bincount(gram, np.array(list(own.values()), float)[owner], BUCKETS)
            at = np.flatnonzero(counts)
            letters: dict[str, float] = {}
            for w, n in own.items():
                letters[script(w)] = letters.get(script(w), 0.0) + n * len(w)
            rows = len(at) + len(letters)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * rows, pa.string()), pa.array([None] * len(at) + list(letters), pa.string()), pa.array([*at.tolist(), *[-1] * len(letters)], pa.int32()), pa.array([*counts[at].tolist(), *letters.values()], pa.float64())],
                ["lang", "script", "at", "n"],
            )
        words.clear()

    for b in batches:
        for text, lang in zip(b.column(0), b.column(1)):
            own = words.setdefault(lang.as_py(), {})
            for w in WORD.findall(text.as_py()):
                own[w] = own.get(w, 0) + 1
            if len(own) > 200_000:
                yield from told()
    yield from (r for r in told() if r.num_rows)


def fit(labelled: DataFrame, text_col: str, lang_col: str, *, rows: int = 1500) -> Model:
    """Fits on ``rows`` whole texts of each language, those with the least hashes, equal texts once.

    Hashes alone choose them; executors count their n-grams, and BUCKETS numbers of each language reach the driver.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).withColumn("h", F.xxhash64("t"))
    least = known.select("l", "h").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("rn") <= rows)
    bounds = {r["l"]: r["h"] for r in least.groupBy("l").agg(F.max("h").alias("h")).collect()}
    langs = sorted(bounds)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), {})
    bound = F.create_map(*[F.lit(x) for kv in bounds.items() for x in kv])
    few = known.where(F.col("h") <= bound[F.col("l")]).groupBy("h").agg(F.min(F.struct("l", "t")).alias("x")).select("x.t", "x.l")
    got = few.mapInArrow(_counted, "lang string, script string, at int, n double").groupBy("lang", "script", "at").agg(F.sum("n").alias("n")).collect()
    counts, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(_NAMES), len(langs)))
    for r in got:
        if r["script"] is None:
            counts[r["at"], langs.index(r["lang"])] = r["n"]
        else:
            scripts[_NAMES.index(r["script"]), langs.index(r["lang"])] = r["n"]
    probs = (counts + 0.05) / (counts.sum(0) + 0.05 * BUCKETS)
    share = scripts / np.maximum(scripts.sum(0), 1)
    allowed = {n: share[i] >= 0.01 for i, n in enumerate(_NAMES) if (share[i] >= 0.01).any()}
    return Model(langs, np.log(probs), allowed)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best path of each text's (words x languages) scores; each switch costs penalty."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    paths: list[np.ndarray] = [np.zeros(0, np.int16)] * len(scores)
    if not len(sizes) or not sizes[0]:
        return paths
    live = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # texts with a word at each place
    starts = np.concatenate([[0], np.cumsum(live)])
    flat = np.empty((starts[-1], scores[0].shape[1]), np.float32)
    for row, i in enumerate(order):
        flat[starts[: sizes[row]] + row] = scores[i]
    back = np.empty(flat.shape, np.int16)
    value = flat[: live[0]].copy()
    every = np.arange(flat.shape[1], dtype=np.int16)
    last = np.zeros(len(order), np.int64)
    last[: live[0]] = value.argmax(1)
    for t in range(1, len(live)):
        n = live[t]
        v = value[:n]
        best = v.argmax(1)
        top = np.take_along_axis(v, best[:, None], 1) - penalty
        stay = v >= top
        back[starts[t] : starts[t + 1]] = np.where(stay, every, best[:, None])
        value[:n] = np.where(stay, v, top) + flat[starts[t] : starts[t + 1]]
        last[:n] = value[:n].argmax(1)
    for row, i in enumerate(order):
        paths[i] = np.zeros(sizes[row], np.int16)
    state = last
    walk = np.empty(starts[-1], np.int16)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        walk[starts[t] : starts[t + 1]] = state[:n]
        if t:
            state[:n] = back[starts[t] : starts[t + 1]][np.arange(n), state[:n]]
    for row, i in enumerate(order):
        paths[i] = walk[starts[: sizes[row]] + row]
    return paths


class Tagger(dict):
    """Row of the score table for each word.  Bounded; grown in each worker process."""

    LIMIT = 400_000

    def __init__(self, model: Model):
        self.model = model
        self.table = np.zeros((1 << 16, len(model.langs)), np.float32)
        self.letters = np.zeros(1 << 16, np.int32)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def _learn(self) -> None:
        """Scores the words that are new, all at once."""
        if self.new and self.model.langs:
            while len(self) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            at = slice(len(self) - len(self.new), len(self))
            self.table[at] = self.model.words(self.new)
            self.letters[at] = [sum(map(str.isalpha, w)) for w in self.new]
        self.new.clear()

    def tag(self, texts: list[str | None], penalty: float) -> list[tuple[str, float, list[str], np.ndarray]]:
        """(language, score, words, language of each word) of each text."""
        if len(self) > self.LIMIT:
            self.clear()
        words = [WORD.findall(t) if t else [] for t in texts]
        ids = [np.fromiter(map(self.__getitem__, w), np.int64, len(w)) for w in words]
        self._learn()
        paths = viterbi([self.table[i] for i in ids], penalty) if self.model.langs else ids
        out = []
        for w, i, p in zip(words, ids, paths):
            if not self.letters[i].any() or not self.model.langs:
                out.append(("und", 0.0, w, p))
                continue
            held = np.bincount(p, self.letters[i], len(self.model.langs))
            out.append((self.model.langs[int(held.argmax())], float(held.max() / held.sum()), w, p))
        return out


def identify(docs: DataFrame, model: Model, text_col: str = "text", *, penalty: float = 6.0) -> DataFrame:
    """The input's rows and columns plus ``lang_pred`` and ``lang_score``, which replace columns with those names."""
    docs = docs.drop("lang_pred", "lang_score")
    shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    at, names = docs.columns.index(text_col), docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names with a dot are no names for mapInArrow
    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("lang_score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(shared)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                got = tagger.tag(part.column(at).to_pylist(), penalty)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*part.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, schema).toDF(*names, "lang_pred", "lang_score")


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, penalty: float = 6.0) -> DataFrame:
    """(id, lang, start, end) for each stretch of words of one language; places are code points."""
    shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(shared)
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            texts = b.column(1).to_pylist()
            for doc, text, (_, _, _, path) in zip(b.column(0).to_pylist(), texts, tagger.tag(texts, penalty)):
                places = [m.span() for m in WORD.finditer(text or "")]
                cuts = [0, *(np.flatnonzero(np.diff(path)) + 1), len(path)] if len(path) else [0]
                for lo, hi in zip(cuts, cuts[1:]):
                    for c, v in zip(cols, (doc, tagger.model.langs[path[lo]], places[lo][0], places[hi - 1][1])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32()))], ["id", "lang", "start", "end"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "id long, lang string, start int, end int").withColumnRenamed("id", id_col)


def _tagger(shared: tuple) -> Tagger:
    """One tagger for each model and worker process, so that its words last from task to task."""
    name, model = shared
    return resident(("tagger", name), lambda: Tagger(model.value))


def held_out(id_col: str, parts: int, part: int):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % parts == part, F.lit(False))


def fitted(docs: DataFrame) -> Model:
    """The model of the query and the pipeline: labelled rows that are not held out."""
    return fit(docs.where(~held_out("doc_id", 3, 1)), "text", "lang")


def op7_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fitted(docs))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
