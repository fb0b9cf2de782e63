"""Packing into sequences: Martello-Toth dominance reduction, then best fit.

A document longer than a sequence is cut into full pieces and one shorter first piece, so only one piece of each document
is open to packing.  Sizes are whole numbers up to the capacity, so an instance is a histogram of at most ``capacity``
counts, whatever the number of documents; the packing is computed on it as patterns (sizes of one sequence, how often).

Reduction: take the largest size w.  If no other piece fits beside it, it is alone.  If a piece fills it exactly, or only
one more piece fits, the largest piece that fits dominates every other choice; if two fit, it still does when it is at
least as long as the best pair.  Such sequences are fixed for good, as many at once as the counts allow.  What is left is
packed by best fit in falling order of size.

Pieces get their places by number within their size.  Numbers are dealt in parts of a size, so that a size that very
many documents share is not counted in one task.

Defined cases: null text is the empty text (its one id ends the document); repeated rows each get a piece; null ids are
packed like others; an empty table gives an empty result; input columns other than id and text are not read.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read, resident, text_or_empty

CAPACITY, END = 1024, 2


class Fenwick:
    """Which sizes still have pieces: next lower and higher present size."""

    def __init__(self, counts: dict[int, int]):
        self.n = dict(counts)
        self.sizes = sorted(s for s, c in counts.items() if c)

    def take(self, size: int, times: int) -> None:
        self.n[size] -= times
        if not self.n[size]:
            del self.sizes[bisect_right(self.sizes, size) - 1]

    def at_most(self, limit: int) -> int | None:
        """The largest present size of at most limit."""
        i = bisect_right(self.sizes, limit)
        return self.sizes[i - 1] if i else None


def _best_pair(left: Fenwick, room: int) -> int:
    """The largest sum of two pieces that fits."""
    best, i, j = 0, 0, len(left.sizes) - 1
    while i <= j:
        a, b = left.sizes[i], left.sizes[j]
        if a + b > room:
            j -= 1
        elif i == j:
            return max(best, 2 * a) if left.n[a] > 1 else best
        else:
            best = max(best, a + b, 2 * a if left.n[a] > 1 else 0)
            i += 1
    return best


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Patterns that are optimal to fix, and the counts that remain."""
    left, fixed, kept = Fenwick(counts), [], {}
    while left.sizes:
        w = left.sizes[-1]
        m, room = left.n[w], capacity - w
        left.take(w, m)
        least = left.sizes[0] if left.sizes else None
        if 2 * w <= capacity and (least is None or w < least):
            least = w
        if least is None or least > room:
            fixed.append(((w,), m))
            continue
        if 2 * w <= capacity:  # pieces of one size may meet: left to best fit
            kept[w] = m
            continue
        done = 0
        while done < m and (fit := left.at_most(room)) is not None:
            smallest = left.sizes[0]
            second = smallest if left.n[smallest] > 1 else (left.sizes[1] if len(left.sizes) > 1 else capacity)
            third = sorted([s for s in left.sizes[:3] for _ in range(min(3, left.n[s]))])[:3]
            alone = smallest + second > room
            pair_only = len(third) < 3 or sum(third) > room
            if not (fit == room or alone or (pair_only and fit >= _best_pair(left, room))):
                break
            times = min(m - done, left.n[fit])
            fixed.append(((w, fit), times))
            left.take(fit, times)
            done += times
        if done < m:
            if left.at_most(room) is None:
                fixed.append(((w,), m - done))
            else:
                kept[w] = m - done
    return fixed, kept


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in falling order of size over groups of equal sequences."""
    open_: dict[int, Counter] = {}
    rooms: list[int] = []  # sorted

    def put(pattern: tuple[int, ...], n: int, room: int) -> None:
        if room not in open_:
            open_[room] = Counter()
            rooms.insert(bisect_right(rooms, room), room)
        open_[room][pattern] += n

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            i = bisect_right(rooms, size - 1)
            if i == len(rooms):
                each = capacity // size
                if n >= each:
                    put((size,) * each, n // each, capacity - each * size)
                    n %= each
                else:
                    put((size,) * n, 1, capacity - n * size)
                    n = 0
                continue
            room = rooms[i]
            pattern, have = next(iter(open_[room].items()))
            times = min(n, have)
            open_[room][pattern] -= times
            if not open_[room][pattern]:
                del open_[room][pattern]
            if not open_[room]:
                del open_[room], rooms[i]
            put((*pattern, size), times, room - size)
            n -= times
    return [(p, n) for room in rooms for p, n in open_[room].items()]


def packing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    fixed, left = reduce_dominated({s: n for s, n in counts.items() if n}, capacity)
    return fixed + best_fit(left, capacity)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's second bound on the number of sequences."""
    best, sizes = 0, sorted(s for s, n in counts.items() if n)
    for k in [0, *[s for s in sizes if 2 * s <= capacity]]:
        large = sum(n for s, n in counts.items() if s > capacity - k)
        mid = sum(n for s, n in counts.items() if capacity - k >= s > capacity / 2)
        free = mid * capacity - sum(n * s for s, n in counts.items() if capacity - k >= s > capacity / 2)
        small = sum(n * s for s, n in counts.items() if capacity / 2 >= s >= k)
        best = max(best, large + mid + max(0, -(-(small - free) // capacity)))
    return best


# --- token ids -------------------------------------------------------------------------------------------------------


class Words(dict):
    """Ids (32-bit little-endian bytes) of a word with what stands before it.  Bounded; grown in each worker process."""

    LIMIT = 600_000

    def __init__(self, encode, before: str):
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        out = np.array(self.encode(self.before + word), "<u4").tobytes()
        if len(word) < 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = out
        return out


def _encoder(path: str):
    """text -> ids as little-endian 32-bit bytes, for a byte-level BPE tokenizers file.

    The whole library runs on texts that hold a special token or two white-space characters in a row.  Elsewhere a
    pre-token always begins at a space and at a line's end and start, so the ids of a text are those of its words in turn; each word is encoded
    once, by the same vocabulary and merges.
    """
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    specials = [x["content"] for x in told.get("added_tokens", [])]
    # the file writes bytes as printable characters: the printable Latin-1 ones stand for themselves, the others for 256 on
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(byte[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in specials}
    encode = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    words, starts = Words(encode, " "), Words(encode, "")
    newline = starts["\n"]
    odd = re.compile("|".join([r"\s\s", "[\x1c-\x1f\x85]", *map(re.escape, specials)]))

    def ids(text: str) -> bytes:
        if odd.search(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(starts[first])
            out += map(words.__getitem__, rest)
            out.append(newline)
        return b"".join(out[:-1])

    return ids


def encoder(path: str):
    """One encoder for each file and worker process, so that its words last from task to task."""
    return resident(("encoder", path), lambda: _encoder(path))


def pieces(docs: DataFrame, id_col: str, text_col: str, *, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) for each piece."""
    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = encode(text.as_py()) + last
                n = len(raw) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    part = raw[4 * lo : 4 * hi]
                    for c, v in zip(cols, (doc, i, lo, hi - lo, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None)):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


class Places:
    """Where the n-th piece of a size goes.  patterns: packing(); one slot for each size's place in a pattern."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        slots: dict[int, list] = {}
        first = 0
        for sizes, n in patterns:
            at = 0
            for size in sizes:
                own = slots.setdefault(size, [[], [], [], 0])
                own[0].append(own[3])
                own[1].append(first)
                own[2].append(at)
                own[3] += n
                at += size
            first += n
        self.slots = {s: tuple(np.array(x, np.int64) for x in own[:3]) for s, own in slots.items()}

    def find(self, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, at = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size):
            rows = size == s
            begin, first, offset = self.slots[int(s)]
            slot = np.searchsorted(begin, number[rows], "right") - 1
            seq[rows], at[rows] = first[slot] + number[rows] - begin[slot], offset[slot]
        return seq, at


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, part: int = 2048) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for each piece.

    The driver sees the histogram of lengths and its patterns, which the capacity bounds.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = pieces(docs, id_col, text_col, tokenizer=tokenizer, capacity=capacity, end=end, with_ids=with_ids)
    cut = scratch.keep(cut)
    told = cut.groupBy("length").count().collect()
    counts = {r["length"]: r["count"] for r in told}
    places = Places(packing(counts, capacity))
    # parts of a size: as many as its pieces ask for, so no window holds much more than ``part`` rows
    shares = F.create_map(*[F.lit(x) for s, n in counts.items() for x in (s, -(-n // part))]) if counts else F.create_map(F.lit(0), F.lit(1))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("id", "piece"), shares[F.col("length").cast("long")]).cast("int"))
    before = cut.groupBy("length", "part").count()
    before = before.select("length", "part", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    w = Window.partitionBy("length", "part").orderBy("id", "piece")
    numbered = cut.withColumn("number", F.row_number().over(w)).join(before, ["length", "part"]).withColumn("number", F.col("before") + F.col("number") - 1)
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, at = places.find(b.column("length").to_numpy(), b.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(seq), pa.array(at)], [*names, "sequence_id", "offset"])

    return numbered.select(*names, "number").mapInArrow(place, types + ", sequence_id long, offset long").withColumnRenamed("id", id_col)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_best_fit_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"), tokenizer=default_tokenizer())
