"""Byte-level BPE: encoding and decoding.

``merge`` is the encoder of one pre-token.  Pairs wait in a queue of merge ranks: a bitmap of two levels (256 ranks to a
word, one bit of the root for each word) says which ranks have entries, find-first-set walks down it to the least
rank, and that rank's bucket holds the linked-list positions of its pairs.  A merge unlinks one node and queues
at most two new pairs; entries whose pair has changed meanwhile are stale and skipped.  A pre-token of n bytes takes O(n)
queue steps of a fixed number of word operations (a bucket keeps its positions in a heap, for the leftmost first), where a
scan for each merge would take O(n^2): it suits very long pre-tokens.

Texts are split at single spaces and line ends, where a pre-token always begins unless white space meets white space; each
distinct word is split by the pattern and encoded once for each worker.  Other texts are split by the pattern as a whole.

Defined cases: null text is empty (no ids, the digests of the empty string); repeated rows each get a result; ids are not
used; an empty table gives an empty result; input columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, resident, text_or_empty


class Codec:
    """A rank file and the pattern that splits texts.  Caches are bounded."""

    #: Words in each of two generations: when the young one is full it replaces the old one, so frequent words stay.
    LIMIT = 450_000

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {r: b for b, r in self.ranks.items()}
        self.size = max(self.bytes) + 1
        self.bitmap = [0] * ((self.size >> 8) + 1)  # all 0 between calls
        self.pattern = regex.compile(pattern)
        self.odd = re.compile(r"\s\s|[\x1c-\x1f\x85]")
        self.words: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.  The queue is written out in line: it is the hot path."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        get, n = ranks.get, len(piece)
        after = list(range(1, n + 2))  # the node that follows; a node is the place where it starts
        before = list(range(-1, n))
        pair = [-1] * (n + 1)  # the rank under which a node and its follower wait
        buckets: dict[int, list[int]] = {}
        words, top = self.bitmap, 0  # bit r & 255 of words[r >> 8]: rank r waits; bit w of top: words[w] is not 0
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                if r in buckets:
                    buckets[r].append(i)  # places rise, so the bucket is a heap
                else:
                    buckets[r] = [i]
                    words[r >> 8] |= 1 << (r & 255)
                    top |= 1 << (r >> 8)
        while top:
            w = (top & -top).bit_length() - 1  # find first set, on both levels
            word = words[w]
            low = word & -word
            rank = (w << 8) + low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) == 1:
                i = bucket[0]
                del buckets[rank]
                words[w] = word = word ^ low
                if not word:
                    top ^= 1 << w
            else:
                i = heappop(bucket)
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            k = after[j]
            after[i] = k
            before[k] = i
            pair[i] = pair[j] = -1
            h = before[i]
            for at, r in ((i, get(piece[i : after[k]]) if k < n else None), (h, get(piece[h:k]) if h >= 0 else None)):
                if at >= 0 and pair[at] != (-1 if r is None else r):
                    if r is None:
                        pair[at] = -1
                        continue
                    pair[at] = r
                    if r in buckets:
                        heappush(buckets[r], at)
                    else:
                        buckets[r] = [at]
                        words[r >> 8] |= 1 << (r & 255)
                        top |= 1 << (r >> 8)
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(ranks[piece[i:j]])
            i = j
        return out

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pattern.findall(text) for i in self.merge(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def _word(self, word: str) -> tuple[str, bytes]:
        """Of a stretch that begins and ends between pre-tokens; each of its pre-tokens is kept, if short."""
        pieces, got = self.pattern.findall(word), []
        for piece in pieces:
            own = self.words.get(piece) or self.old.get(piece)
            if own is None:
                ids = self.merge(piece.encode())
                own = ",".join(map(str, ids)), self.decode(ids)
                if len(piece) < 64:
                    self.words[piece] = own
            got.append(own)
        return got[0] if len(got) == 1 else (",".join(x[0] for x in got), b"".join(x[1] for x in got))

    def coded(self, text: str) -> tuple[str, bytes]:
        """Decimal ids joined by commas, and the bytes that they decode to."""
        if self.odd.search(text):
            pieces = self.pattern.findall(text)
        else:
            pieces = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                if first:
                    pieces.append(first)
                pieces += map(" ".__add__, rest)
                pieces.append("\n")
            pieces.pop()
        if len(self.words) > self.LIMIT:
            self.old, self.words = self.words, {}
        words, older = self.words, self.old
        ids, back = [], []
        for piece in pieces:
            got = words.get(piece)
            if got is None:
                got = older.get(piece) or self._word(piece)
                if len(piece) < 64:
                    words[piece] = got
            ids.append(got[0])
            back.append(got[1])
        return ",".join(ids), b"".join(back)


def codec(path: str, pattern: str) -> Codec:
    """One codec for each file, pattern and worker process, so that its words last from task to task."""
    return resident(("codec", path, pattern), lambda: Codec(path, pattern))


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks: str, pattern: str) -> DataFrame:
    """(id, ids array<int>): for use downstream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for b in batches:
            got = [[int(x) for x in s.split(",")] if (s := c.coded(t.as_py())[0]) else [] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], ["id", "ids"])

    return _asked(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks: str, pattern: str) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for b in batches:
            n, ids, back = [], [], []
            for t in b.column(1):
                s, raw = c.coded(t.as_py())
                n.append(s.count(",") + 1 if s else 0)
                ids.append(hashlib.sha256(s.encode()).hexdigest())
                back.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _asked(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def _asked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text"))


def default_ranks() -> dict[str, str]:
    import public_tokenizers

    return {"ranks": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op8_byte_bpe(spark, sf_dir):
    return round_trip(read(spark, sf_dir, "documents"), **default_ranks())
