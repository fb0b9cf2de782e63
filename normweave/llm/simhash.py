"""SimHash near-dedup with pigeonring filtering.

Fingerprints are 64-bit SimHashes of word shingles.  A fingerprint is a ring of m = 4 segments of 16 bits.  If two differ
in at most t = 3 bits then, by the pigeonring principle, some segment starts a chain in which the first l segments
together differ in at most floor(l*t/m) bits, for each l: 0, 1, 2 and 3 bits.  So each distinct fingerprint is indexed
under its four segments (the first segment of the chain must be equal) and a pair is dropped as soon as its chain breaks
a budget, before the full Hamming check.

Only distinct fingerprints meet.  A bucket emits the edges of a spanning forest, never its pairs: a breadth-first search
compares each fingerprint with those not reached yet.  Buckets of more than ``bucket`` fingerprints are dealt anew by
the next segment of the chain with one bit left out (segments that differ in at most one bit agree on one such key).
What is still too large is solved without comparing pairs: each fingerprint is put under itself, under the 64 at distance
1 and the 2016 at distance 2; two are linked if and only if one's centre at distance at most 1 is the other's at distance
at most 2, so all of a centre's rows link to the smallest row at distance at most 1.  All three ways are exact and work
for any size.

``near_copies`` is the form for corpora: links are pairs of texts with Jaccard similarity of word shingles of 0.8 or more.
The fingerprints of such pairs differ in 4 to 15 of 64 bits, far above any budget with a usable index, so SimHash alone
loses most of them.  There, candidates come from min-wise bands of the same shingle hashes; SimHash with pigeonring chains,
over a ring of four words of 64 bits, prunes them before the full Hamming check, and what passes is verified on the whole
shingle sets.

Defined cases: null and blank texts have fingerprint 0 and are linked to each other like any others (``near_copies``
leaves them single unless asked); equal ids are one document for components (repeated rows each get a result); null ids keep a null
component unless linked; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read, resident, row_key, text_or_empty
from .components import components

SEGMENTS, WIDTH, BITS = 4, 16, 3
BUDGETS = tuple(length * BITS // SEGMENTS for length in range(1, SEGMENTS + 1))


def shingles(text: str | None, words: int) -> list[bytes]:
    """Shingles of the words of a text, A-Z lower-cased, repeats included.  bytes.split and bytes.lower know ASCII only, as the contract does."""
    w = (text or "").encode().lower().split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return [b" ".join(x) for x in zip(*(islice(w, k, None) for k in range(words)))]


def hashes(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, items, repeat(42)), np.uint64, len(items))


def fingerprint(h: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of h.  Eight counters of 8 bits are added at once, 255 rows at most."""
    n, lanes, one = len(h), np.zeros((8, 8), np.int64), np.uint64(0x0101010101010101)
    for k in range(8):
        bits = (h >> np.uint64(k)) & one
        sums = np.add.reduceat(bits, np.arange(0, n, 255)) if n else np.zeros(0, np.uint64)
        lanes[k] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    out = 0
    for k in range(8):
        for byte in range(8):
            if 2 * lanes[k, byte] > n:
                out |= 1 << (8 * byte + k)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, fp)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(None)  # no model of an earlier stage stays
        for b in batches:
            fps = [_signed(fingerprint(hashes(shingles(t.as_py(), words)))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def in_chain(x: np.ndarray, start: int) -> np.ndarray:
    """Which differences x (xor of two fingerprints) keep the budgets of the chain that begins at segment start."""
    total, ok = np.zeros(x.shape, np.uint8), np.ones(x.shape, bool)
    for length, budget in enumerate(BUDGETS):
        at = (start + length) % SEGMENTS
        total = total + np.bitwise_count((x >> np.uint64(at * WIDTH)) & np.uint64(0xFFFF))
        ok &= total <= budget
    return ok


def forest(fp: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the links in one bucket whose chain begins at segment start."""
    out, left = [], np.arange(len(fp))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = in_chain(fp[left] ^ fp[at], start)
            if hit.any():
                near = left[hit]
                out.extend((int(at), int(x)) for x in near)
                queue.extend(near)
                left = left[~hit]
    return out


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, start, fp) sorted by key; solves each key's rows.  Holds one bucket and one batch at a time."""
    rest: list[np.ndarray] = []

    def solve(key, start, fp):
        cuts = np.flatnonzero(np.diff(key)) + 1
        a, b = [], []
        for lo, hi in zip([0, *cuts], [*cuts, len(key)]):
            if hi - lo == 2:  # most buckets with links
                if in_chain(fp[lo : lo + 1] ^ fp[lo + 1 : hi], int(start[lo]))[0]:
                    a.append(fp[lo])
                    b.append(fp[lo + 1])
            elif hi - lo > 2:
                part = fp[lo:hi]
                for x, y in forest(part, int(start[lo])):
                    a.append(part[x])
                    b.append(part[y])
        return pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], ["a", "b"])

    for batch in batches:
        now = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)]
        if rest:
            now = [np.concatenate(x) for x in zip(rest, now)]
        if not len(now[0]):
            continue
        whole = int(np.searchsorted(now[0], now[0][-1]))
        rest = [x[whole:] for x in now]
        if whole:
            yield solve(*(x[:whole] for x in now))
    if rest:
        yield solve(*rest)


def _segment(start: int) -> Column:
    return F.shiftrightunsigned("fp", start * WIDTH).bitwiseAND(0xFFFF)


def _by_size(keyed: DataFrame, bucket: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Splits rows (key, ...) into those of buckets of at most bucket rows, and the rest (None if there are none)."""
    large = scratch.keep(keyed.groupBy("key").count().where(F.col("count") > bucket).select("key"))
    if large.isEmpty():
        return keyed, None
    return keyed.join(large, "key", "left_anti"), keyed.join(large, "key", "left_semi")


def _solve(keyed: DataFrame) -> DataFrame:
    return keyed.select("key", "start", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_in_buckets, "a long, b long")


def links(fps: DataFrame, scratch: Scratch, bucket: int = 1024) -> DataFrame:
    """(a, b): fingerprints that span the components of all pairs of distinct fingerprints with at most 3 differing bits."""
    ring = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("start"), _segment(i).alias("s0"), _segment((i + 1) % SEGMENTS).alias("s1")) for i in range(SEGMENTS)])).alias("k"))
    keyed = scratch.keep(ring.select((F.col("k.s0") * SEGMENTS + F.col("k.start")).alias("key"), F.col("k.start").alias("start"), "fp", F.col("k.s1").alias("s1")))
    small, large = _by_size(keyed, bucket, scratch)
    out = _solve(small)
    if large is None:
        return out
    masked = lambda b: F.struct(F.lit(b).alias("bit"), F.col("s1").bitwiseAND(0xFFFF ^ (1 << b)).alias("s1"))
    finer = large.select("key", "start", "fp", F.explode(F.array(*[masked(b) for b in range(WIDTH)])).alias("m"))
    finer = scratch.keep(finer.select(((F.col("key") * WIDTH + F.col("m.bit")) * (1 << WIDTH) + F.col("m.s1")).alias("key"), "start", "fp"))
    small, large = _by_size(finer, bucket, scratch)
    out = out.unionByName(_solve(small))
    if large is None:
        return out
    return out.unionByName(_by_centres(large.select("fp").distinct(), scratch))


def _by_centres(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Links without comparing pairs; 2081 rows for each fingerprint."""
    flips = [1 << i for i in range(64)]
    one = [0, *flips]
    two = [a | b for i, a in enumerate(flips) for b in flips[:i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip = np.array(one + two, np.uint64)
        near = np.arange(len(flip)) < len(one)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part in np.array_split(fp, len(fp) // 256 + 1):
                centre = (part[:, None] ^ flip[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(centre.view(np.int64)), pa.array(np.repeat(part, len(flip)).view(np.int64)), pa.array(np.tile(near, len(part)))], ["centre", "fp", "near"])

    around = scratch.keep(fps.mapInArrow(run, "centre long, fp long, near boolean"))
    least = around.where("near").groupBy("centre").agg(F.min("fp").alias("a"))
    return around.join(least, "centre").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b")).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3, bucket: int = 1024) -> DataFrame:
    """(id, fp, component_id) for each row: components of fingerprints linked at 3 or fewer differing bits."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, id_col, text_col, words))
    first = scratch.keep(rows.groupBy("fp").agg(F.min("id").alias("first")))
    found = scratch.keep(links(first.select("fp"), scratch, bucket).distinct())
    root = components(found, scratch)
    # the smallest id of a component; few fingerprints are linked at all
    linked = root.join(first, root.node == first.fp).select("root", "node", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select(F.col("node").alias("fp"), "least")
    label = scratch.keep(first.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return rows.join(label, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


# --- near copies: Jaccard similarity of shingle sets ---------------------------------------------------------------------

BANDS, ROWS = 21, 6
#: Odd multipliers of the min-wise hash functions, and of the mixture of a band's minima.
_MULTIPLIERS = np.fromiter((xxhash.xxh64_intdigest(str(i), 11) | 1 for i in range(BANDS * ROWS)), np.uint64)
#: Words of the long fingerprint, which are the segments of its ring, and the bits in which it may differ.  At a similarity
#: of 0.8 two differ in 31 to 39 of the 256 bits in the mean, with a deviation of 5.2 to 5.8 (sets of more than ``FEW`` shingles).
LONG, FAR, FEW = 4, 72, 16
_SALTS = np.fromiter((xxhash.xxh64_intdigest(str(i), 13) for i in range(LONG)), np.uint64)
_WORDS = [f"f{k}" for k in range(LONG)]
#: Words of the wide fingerprint of what is left after a first turn, and the bits in which it may differ: at a similarity of
#: 0.8 the mean is 554 to 634 of 4096 bits and the deviation 19 to 27, so the budget is four deviations above it or more.
WIDE, WIDE_FAR = 64, 735
_WIDE_SALTS = np.fromiter((xxhash.xxh64_intdigest(str(i), 17) for i in range(WIDE)), np.uint64)


def long_fingerprint(h: np.ndarray) -> np.ndarray:
    """A SimHash of 64 LONG bits: each word comes from its own mixture of the shingle hashes."""
    counts = np.zeros(64 * LONG, np.int64)
    for lo in range(0, len(h), 4096):
        x = h[lo : lo + 4096, None] + _SALTS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        counts += np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(h)).view(np.uint64)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """A SimHash of 64 WIDE bits of distinct hashes, counted as in ``fingerprint``: eight counters at once, 255 rows at most."""
    lanes, one = np.zeros((8, WIDE, 8), np.int64), np.uint64(0x0101010101010101)
    for lo in range(0, len(h), 4080):
        x = h[lo : lo + 4080, None] + _WIDE_SALTS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        for k in range(8):
            sums = np.add.reduceat((x >> np.uint64(k)) & one, np.arange(0, len(x), 255), axis=0)
            lanes[k] += sums.view(np.uint8).reshape(len(sums), WIDE, 8).sum(0, dtype=np.int64)
    return np.packbits(2 * lanes > len(h), axis=0, bitorder="little").ravel().view(np.uint64)


def sketch(text: str | None, words: int) -> tuple[np.ndarray, int, int, np.ndarray]:
    """(long fingerprint, number of distinct shingles, digest of their set, a key for each band)."""
    h = np.unique(hashes(shingles(text, words)))
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(h), 512):
        least = np.minimum(least, (h[lo : lo + 512, None] * _MULTIPLIERS).min(0))
    keys = ((least ^ (least >> np.uint64(29))) * _MULTIPLIERS[::-1]).reshape(BANDS, ROWS).sum(1) * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)
    return long_fingerprint(h), len(h), int(h.sum()) if len(h) else 0, keys


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """(id, key, text) to (id, key, size, digest, f0.., bands)."""
    schema = f"id long, key long, size long, digest long, {', '.join(f'{w} long' for w in _WORDS)}, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(None)  # no model of an earlier stage stays
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                got = [sketch(t.as_py(), words) for t in part.column(2)]
                bands = np.concatenate([g[3] for g in got]).view(np.int64)
                fps = np.stack([g[0] for g in got]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([g[1] for g in got], pa.int64()), pa.array([_signed(g[2]) for g in got], pa.int64()), *[pa.array(np.ascontiguousarray(fps[:, k])) for k in range(LONG)], pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, BANDS), pa.int32()), pa.array(bands))],
                    ["id", "key", "size", "digest", *_WORDS, "bands"],
                )

    return docs.mapInArrow(run, schema)


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(v, text) to (v, h): the sorted 64-bit hashes of the distinct shingles, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(None)  # no model of an earlier stage stays
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.unique(hashes(shingles(t.as_py(), words))).tobytes() for t in part.column(1)], pa.binary())], ["v", "h"])

    return texts.mapInArrow(run, "v long, h binary")


def _wide(sets: DataFrame) -> DataFrame:
    """(v, h) to (v, wide): the wide fingerprint of each set, as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                got = np.concatenate([wide_fingerprint(np.frombuffer(h.as_py(), np.uint64)) for h in part.column(1)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(got) + 1, WIDE), pa.int32()), pa.array(got))], ["v", "wide"])

    return sets.mapInArrow(run, "v long, wide array<long>")


def in_ring(differences: list[Column], budget: int) -> Column:
    """Whether some segment starts a chain each of whose beginnings keeps its share of the budget; the last share is the whole."""
    m, chains = len(differences), []
    for start in range(m):
        total, fine = None, None
        for length in range(1, m + 1):
            d = differences[(start + length - 1) % m]
            total = d if total is None else total + d
            now = total <= length * budget // m
            fine = now if fine is None else fine & now
        chains.append(fine)
    return reduce(lambda a, b: a | b, chains)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar.  Each set of a comes to the set of its anchor b once for each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(None)  # no model of an earlier stage stays
        for batch in batches:
            a, b = [], []
            for x, y, s, t in zip(*(batch.column(i) for i in range(4))):
                p, q = (np.frombuffer(z.as_py(), np.uint64) for z in (s, t))
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both >= similarity * (len(p) + len(q) - both):
                    a.append(x.as_py())
                    b.append(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    one = pairs.join(sets.select(F.col("v").alias("a"), F.col("h").alias("ha")).hint("merge"), "a")
    both = one.join(sets.select(F.col("v").alias("b"), F.col("h").alias("hb")).hint("merge"), "b")
    return both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, similarity: float = 0.8, blanks: bool = False, block: int = 1024) -> DataFrame:
    """(id, row_key, component_id, stays) for each row: components of texts linked by similar shingle sets; with ``blanks`` also those without a shingle.

    Rows are told apart by id and ``row_key`` (of the text), so a repeated id never speaks for another text.  ``component_id``
    is the smallest id of the component; ``stays`` marks the row with that id (of several texts with it, the one with the
    least key) and every row with a null id.  Fully repeated rows all carry the same mark.

    Equal sets are one vertex.  Candidates are the pairs of a min-wise bucket whose sizes can give the similarity and whose
    long fingerprints pass the pigeonring chains (sets of ``FEW`` shingles or less go without); all that is settled inside
    the join of the bucket, before anything is sent.  Each candidate's whole sets are then compared.  A bucket is worked in
    turns: the smallest vertex, the one that shares most buckets (the original of many copies) and, from the second turn on,
    a growing share of those outside that one's component are compared with all members of other components, and leave.  A
    bucket is done when one component holds what is left, so every pair of it was connected or compared.  What is left after
    the first turn are large groups that are not all alike: there a pair also has to keep the budget of a wide fingerprint,
    and is a candidate only in the least bucket that both still share.  Buckets of more than ``block`` members are dealt in
    parts, each of which meets a copy of the anchors.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    asked = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text")).select("id", row_key(F.col("text")).alias("key"), "text")
    rows = scratch.keep(_sketches(asked, words))
    # a vertex is a set; blanks that stay single are one for each id
    vertex_of = F.xxhash64("digest", "size", "f0", *([] if blanks else [F.when(F.col("size") == 0, F.col("id"))]))
    first = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "key")).alias("first")
    vertex = scratch.keep(rows.groupBy(vertex_of.alias("v")).agg(first))
    sketched = ["v", "size", *_WORDS]
    one = rows.where("size > 0").withColumn("v", vertex_of).join(vertex.hint("merge"), "v").where(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key")))
    one = scratch.keep(one.groupBy(*sketched).agg(F.first("bands").alias("bands")))
    bands = one.select("v", F.explode("bands").alias("key"))
    shared = scratch.keep(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = scratch.keep(bands.join(shared.hint("merge"), "key").select("key", "v", "n"))
    met = scratch.keep(members.groupBy("v").agg(F.sum("n").alias("degree")))
    known = scratch.keep(one.join(met.hint("merge"), "v").select(*sketched, "degree"))
    left = scratch.keep(members.join(known.hint("merge"), "v").select("key", *sketched, "degree", F.col("v").alias("root")))
    source = vertex.join(met.hint("merge"), "v", "left_semi").select("v", F.col("first.id").alias("id"), F.col("first.key").alias("key"))
    # the only time that texts move; ids that are null are few texts of many rows, so their key decides alone
    ident = lambda x: F.coalesce(x, F.lit(-(2**63)))
    texts = asked.withColumn("at", ident(F.col("id"))).join(source.select("v", ident(F.col("id")).alias("at"), "key").hint("merge"), ["at", "key"])
    sets = scratch.keep(_shingle_sets(texts.select("v", "text"), words).dropDuplicates(["v"]))
    scratch.drop(one, shared, members, met, known)
    compared: list[DataFrame] = []

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct()
        for old in compared:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        compared.append(scratch.keep(pairs))
        return scratch.keep(_verified(compared[-1], sets, similarity))

    root, turn, late = None, 0, []
    while True:
        told = F.struct("degree", *sketched, "root")
        buckets = left.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(*sketched, "root")).alias("one"), F.max(told).alias("hub"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        buckets = scratch.keep(buckets.where("lo <> hi").select("key", "n", "one", "hub", F.ceil(F.col("n") / block).cast("int").alias("parts")))
        if buckets.isEmpty():
            break
        if turn == 1:
            still = left.join(buckets.select("key").hint("merge"), "key").groupBy("v").agg(F.collect_set("key").alias("keys"))
            still = scratch.keep(still.join(_wide(sets.join(still.select("v").hint("merge"), "v", "left_semi")).hint("merge"), "v"))
            before, left, late = left, left.join(still.hint("merge"), "v"), ["keys", "wide"]
        # the hub's component is the large one of a bucket: its members are met by the others and need not meet them
        drawn = (F.col("root") != F.col("most")) & (F.pmod(F.xxhash64("v", "key"), F.lit(1 << 30)) * F.col("n") < F.lit(float((64**turn - 1) << 30)))
        marked = left.join(buckets.select("key", "n", "parts", F.col("one.v").alias("one"), F.col("hub.v").alias("hub"), F.col("hub.root").alias("most")).hint("merge"), "key")
        marked = scratch.keep(marked.select("key", *sketched, *late, "degree", "root", "parts", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), ((F.col("v") == F.col("one")) | (F.col("v") == F.col("hub")) | drawn).alias("anchor")))
        scratch.drop(left, buckets, *([before, still] if turn == 1 else []))
        anchors = marked.where("anchor").select("key", *[F.col(c).alias(f"b_{c}") for c in (*sketched, *late, "root")], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        both = marked.join(anchors.hint("merge"), ["key", "part"])
        far = in_ring([F.bit_count(F.col(w).bitwiseXOR(F.col(f"b_{w}"))) for w in _WORDS], FAR)
        fine = (F.col("root") != F.col("b_root")) & (F.least("size", "b_size") >= similarity * F.greatest("size", "b_size")) & ((F.least("size", "b_size") <= FEW) | far)
        if late:
            wide = F.aggregate(F.zip_with("wide", "b_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, d: total + d)
            fine = fine & ((F.least("size", "b_size") <= FEW) | (wide <= WIDE_FAR)) & (F.array_min(F.array_intersect("keys", "b_keys")) == F.col("key"))
        new = checked(both.where(fine).select(F.greatest("v", "b_v").alias("a"), F.least("v", "b_v").alias("b")))
        now = marked.where("not anchor")
        if not new.isEmpty():
            if root is not None:
                new = new.unionByName(root.select(F.col("node").alias("a"), F.col("root").alias("b")))
            root = scratch.keep(components(new, scratch))
        if root is not None:
            now = now.join(root.select(F.col("node").alias("v"), F.col("root").alias("now")).hint("merge"), "v", "left").withColumn("root", F.coalesce("now", "root"))
        left = scratch.keep(now.select("key", *sketched, *late, "degree", "root"))
        scratch.drop(marked)
        turn += 1
    scratch.drop(left, buckets, sets, *compared)
    out = rows.select("id", "key", vertex_of.alias("v"))
    if root is not None:
        linked = root.select(F.col("node").alias("v"), "root").join(vertex.hint("merge"), "v")
        least = linked.groupBy("root").agg(F.min("first").alias("least"))
        vertex = vertex.join(linked.select("v", "root").join(least, "root").select("v", "least"), "v", "left").select("v", F.coalesce("least", "first").alias("first"))
    label = scratch.keep(out.join(vertex.hint("merge"), "v").select("id", "key", F.coalesce("first.id", "id").alias("component_id"), (F.col("id").isNull() | (F.col("id") == F.col("first.id")) & (F.col("key") == F.col("first.key"))).alias("stays")))
    scratch.drop(rows)
    return label.select(F.col("id").alias(id_col), F.col("key").alias("row_key"), "component_id", "stays")


def op2_simhash_near_dedup(spark, sf_dir):
    out = near_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
