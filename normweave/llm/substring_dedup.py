"""Substring dedup by content-defined chunking.

A gear rolling hash runs over the bytes of a text: h = (h << 1) + gear[byte] in 16 bits, so it depends on the last 16
bytes.  A chunk may end where a word ends, and does if the hash there is the least of any 11 consecutive word ends (the last
of equals).  So a chunk has 11 words at most, 6 in the mean, whatever the content, and two documents that share a passage have
the same cuts in it from the first to the last window of 11 word ends whose hashes lie in the passage: at most 11 words, and
the words of the first 16 bytes, are lost at its edges.  A passage of 51 words gives a run of 20 or more.  Chunks are compared by a 64-bit digest; the smallest
row of a digest keeps it.  A document loses each run of consecutive chunks that other documents keep, if the
run has ``min_words`` words or more: one stray equal chunk, or a collision of digests, is no run.

Only (digest, id, key, place) is shuffled, first into counts that combine before the shuffle, then in a join that Spark
can split for a hot digest.

Defined cases: null text has no chunks; rows are told apart by id and text, so a repeated id with another text is another
document; rows that repeat both are one document (never copies of each other, each gets the result); null ids are smaller than all
others; of equal chunks the smallest (id, key of the text) keeps its own, at all its places; stretches without white
space are cut every 30,000 code points; texts may be of any length, their runs grow in blocks; an empty table gives an empty result; other
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound, fold, read, row_key, spliced, text_or_empty

#: The gear: a 16-bit value for each byte.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], np.uint16)
#: Word ends of a window; each window has a cut.
WINDOW = 11
LONGEST = 30_000
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of the last 16 gear values, each shifted by its distance, by doubling."""
    h = GEAR[raw]
    for k in (1, 2, 4, 8):
        add = h[:-k] << np.uint16(k)
        h = h.copy()
        h[k:] += add
    return h


def cuts(h: np.ndarray) -> np.ndarray:
    """Places of the least value, of equals the last, of every WINDOW consecutive values; minima by doubling."""
    key = h.astype(np.int64) << 32 | np.arange(len(h), 0, -1)
    if len(key) < WINDOW:
        return np.zeros(0, np.int64)
    span = 1
    while span < WINDOW:
        by = min(span, WINDOW - span)
        key = np.minimum(key[:-by], key[by:])
        span += by
    return np.unique(len(h) - (key & 0xFFFFFFFF))


def chunks(text: str) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The chunks of a text: bytes, first code point, number of code points, number of words."""
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    none = np.zeros(0, np.int64)
    if not len(raw):
        return [], none, none, none
    white = _WHITE[raw]
    first = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))  # where words start
    if not len(first):
        return [], none, none, none
    ends = np.flatnonzero(white[1:] & ~white[:-1])  # last byte of words that white space follows
    ends = ends[cuts(gear_hash(raw)[ends])]
    point = np.cumsum((raw & 0xC0) != 0x80)  # code points up to and with each byte
    # a chunk runs from its first word to the byte before the first word of the next
    at = np.unique(np.concatenate([[first[0]], first[np.minimum(np.searchsorted(first, ends, "right"), len(first) - 1)]]))
    stop = np.concatenate([at[1:], [len(raw)]])
    if (point[stop - 1] - point[at] >= LONGEST).any():
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        more = [lead[np.arange(point[a] - 1 + LONGEST, point[b - 1], LONGEST)] for a, b in zip(at, stop) if point[b - 1] - point[a] >= LONGEST]
        at = np.unique(np.concatenate([at, *more]))
        stop = np.concatenate([at[1:], [len(raw)]])
    start = point[at] - 1
    size = point[stop - 1] - start
    words = np.searchsorted(first, stop) - np.searchsorted(first, at)
    return [data[a:b].strip(b" \t\n\x0b\x0c\r") for a, b in zip(at.tolist(), stop.tolist())], start, size, np.maximum(words, 1)


def chunk_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, id, key, at): key tells rows of an id apart, at holds first code point, number of code points (15 bits) and of words (15 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                digest, ids, at = [], [], []
                for k, text in enumerate(part.column(2)):
                    pieces, start, size, words = chunks(text.as_py())
                    digest.append(np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces)))
                    ids.append(np.full(len(pieces), k))
                    at.append(start.astype(np.int64) << 30 | size << 15 | np.minimum(words, 32767))
                if digest:
                    whose = pa.array(np.concatenate(ids).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(digest).view(np.int64)), part.column(0).take(whose), part.column(1).take(whose), pa.array(np.concatenate(at))], ["digest", "id", "key", "at"])

    asked = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), row_key(F.col(f"`{text_col}`")).alias("key"), text_or_empty(text_col).alias("text"))
    return asked.mapInArrow(run, "digest long, id long, key long, at long")


_RUN = "struct<start:bigint,end:bigint,words:int,first:int,chunks:int>"


def _runs(gone: Column, min_words: int) -> Column:
    """The runs of neighbouring chunks of min_words words or more; first and chunks say which elements of gone they are."""
    start = lambda x: F.shiftright(x["at"], 30)
    end = lambda x: start(x) + F.shiftright(x["at"], 15).bitwiseAND(32767)
    words = lambda x: x["at"].bitwiseAND(32767).cast("int")
    none = F.lit(-1).cast("long")
    empty = F.struct(none.alias("start"), none.alias("end"), F.lit(0).alias("words"), F.lit(0).alias("first"), F.lit(0).alias("chunks"))

    def step(run, x):
        one = F.struct(start(x).alias("start"), end(x).alias("end"), words(x).alias("words"), (run["first"] + run["chunks"]).alias("first"), F.lit(1).alias("chunks"))
        grown = F.struct(run["start"].alias("start"), end(x).alias("end"), (run["words"] + words(x)).alias("words"), run["first"].alias("first"), (run["chunks"] + 1).alias("chunks"))
        joins = run["end"] == start(x)
        done = F.when(~joins & (run["words"] >= min_words), F.array(run)).otherwise(F.array().cast(f"array<{_RUN}>"))
        return F.when(joins, grown).otherwise(one), done

    # a last chunk that joins nothing closes the last run
    last = F.array(F.struct(F.lit(1 << 62).alias("at"), F.lit(None).cast("long").alias("keeper")))
    return fold(F.concat(gone, last), empty, _RUN, step)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 20) -> DataFrame:
    """(id, row_key, n_chunks, n_dropped, spans array<struct<start,end>>, first_ids array<long>) for each row.

    spans: stretches (code points, end exclusive) of at least ``min_words`` words that other, smaller rows keep; n_dropped:
    their chunks; first_ids: the ids of those rows.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    rows = scratch.keep(chunk_rows(docs, id_col, text_col))
    who = F.struct("id", "key")
    first = rows.groupBy("digest").agg(F.min(who).alias("first"), F.max(who).alias("last"))
    first = scratch.keep(first.where(F.col("first") != F.col("last")).select("digest", F.col("first.id").alias("keeper"), F.col("first.key").alias("keeper_key")))
    # written first, so that both sides are plain scans and a hot digest can be split; a merge join at every size
    gone = rows.join(first.hint("merge"), "digest").where(~(F.col("id").eqNullSafe(F.col("keeper")) & (F.col("key") == F.col("keeper_key"))))
    own = gone.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("at", "keeper"))).alias("gone"))
    ids = lambda runs: F.flatten(F.transform(runs, lambda r: F.transform(F.slice("gone", r["first"] + 1, r["chunks"]), lambda x: x["keeper"])))
    told = lambda runs: F.struct(
        F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans"),
        F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["chunks"]).alias("n_dropped"),
        F.array_sort(F.array_distinct(ids(runs))).alias("first_ids"),
    )
    own = own.select(F.col("id").alias("__id"), F.col("key").alias("__key"), bound(_runs(F.col("gone"), min_words), told).alias("told"))
    every = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), row_key(F.col(f"`{text_col}`")).alias("key"))
    # rows that repeat id and text have the same chunks
    times = every.groupBy("id", "key").count().select(F.col("id").alias("__t"), F.col("key").alias("__tk"), F.col("count").alias("times"))
    sizes = rows.groupBy("id", "key").count().select(F.col("id").alias("__own"), F.col("key").alias("__ok"), F.col("count").alias("n"))
    sizes = sizes.join(times, F.col("__own").eqNullSafe(F.col("__t")) & (F.col("__ok") == F.col("__tk"))).select("__own", "__ok", (F.col("n") / F.col("times")).cast("long").alias("n_chunks"))
    out = every.join(sizes, F.col("id").eqNullSafe(F.col("__own")) & (F.col("key") == F.col("__ok")), "left").join(own, F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("key").alias("row_key"),
        F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"),
        F.coalesce("told.n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.coalesce("told.spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.coalesce("told.first_ids", F.array().cast("array<bigint>")).alias("first_ids"),
    )


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 20) -> DataFrame:
    """The input's rows and columns, the text without its repeated stretches."""
    found = repeats(docs, id_col, text_col, min_words=min_words).where(F.size("spans") > 0).select(F.col(f"`{id_col}`").alias("__cut_id"), F.col("row_key").alias("__cut_key"), F.col("spans").alias("__cut"))
    text = F.col(f"`{text_col}`")
    since = lambda spans, i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(spans, i - 1)["end"])
    pieces = F.transform("__cut", lambda s, i: F.struct(since(F.col("__cut"), i).alias("since"), s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("by")))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__cut_id")) & (row_key(text) == F.col("__cut_key"))
    out = docs.join(found.dropDuplicates(["__cut_id", "__cut_key"]), same, "left")
    return out.withColumn(text_col, F.when(F.col("__cut").isNotNull(), spliced(text, pieces)).otherwise(text)).drop("__cut_id", "__cut_key", "__cut")


def op9_substring_dedup(spark, sf_dir):
    out = repeats(read(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "n_chunks", "n_dropped", spans.alias("spans"), F.array_join(F.transform("first_ids", lambda x: x.cast("string")), ",").alias("first_ids"))
