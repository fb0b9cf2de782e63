"""Line dedup over levelled sorted runs of line digests (native).

Documents come in batches, here ranges of descending id, so that a line's keeper (the largest id) is in the batch in
which its key first appears.  The index is a set of immutable runs, sorted by digest in buckets, at levels like those of
a log-structured merge tree.  A batch is shuffled and sorted once.  It merge-anti-joins the runs: only keys without a
match enter its run, with their keeper, so each key is in one run and has one keeper; keys with a match add to the
counts of documents beside the runs.  When a level holds ``fanout`` runs they are merged into one of the next level, so
a key is rewritten log(batches) times.  Runs share their buckets, so none of these joins shuffles a run again.

Only 16-byte digests are shuffled; the text is read twice and moved once, to meet its document's dropped digests.  Digests that hold
over a thousandth of all lines are less than a thousand: they reach the lines by broadcast, so none is gathered in a task.

Defined cases: null text is one empty line; equal ids are one document for counting (repeated rows each get a result);
null ids count as one document that is smaller than every other; an empty table gives an empty result; lines shorter than
``min_chars`` always stay; a text may have any number of lines (those of long texts look their digests up by a part of
the digest); other columns may have any names, and one named ``line_dedup`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Scratch, ascii_lower, digest16, read, text_or_empty


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _lines(text: str) -> Column:
    return F.split(text_or_empty(text), "\n")


class LineIndex:
    """Runs (h, keeper, n) whose keys are disjoint, and beside each the counts (h, n) that its batches added to older runs' keys."""

    def __init__(self, scratch: Scratch, buckets: int, fanout: int):
        self.scratch, self.buckets, self.fanout = scratch, buckets, fanout
        self.levels: list[list[tuple[DataFrame, DataFrame]]] = []

    def _keep(self, df: DataFrame, dealt: bool = True) -> DataFrame:
        return self.scratch.keep_sorted(df, "h", self.buckets, dealt=dealt)

    def add(self, batch: DataFrame) -> None:
        """batch: (h, keeper, n), one row for each key."""
        batch = self._keep(batch, dealt=False)
        fresh = batch
        for run, _ in (r for level in self.levels for r in level):
            fresh = self.fresh(fresh, run)
        fresh = self._keep(fresh)
        seen = self._keep(batch.join(fresh.select("h").hint("merge"), "h", "left_anti").select("h", "n"))
        self.scratch.drop(batch)
        self._put(0, (fresh, seen))

    @staticmethod
    def fresh(batch: DataFrame, run: DataFrame) -> DataFrame:
        """The batch's keys that the run doesn't hold."""
        return batch.join(run.select("h").hint("merge"), "h", "left_anti")

    def _put(self, level: int, run: tuple[DataFrame, DataFrame]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merged(old))

    def _merged(self, old: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
        keys, counts = old[0]
        for more, others in old[1:]:
            more = more.select("h", F.col("keeper").alias("k"), F.col("n").alias("m"))
            keys = keys.join(more.hint("merge"), "h", "full_outer").select("h", F.coalesce("keeper", "k").alias("keeper"), F.coalesce("n", "m").alias("n"))
            others = others.withColumnRenamed("n", "m")
            counts = counts.join(others.hint("merge"), "h", "full_outer").select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        out = self._keep(keys), self._keep(counts)
        self.scratch.drop(*(t for run in old for t in run))
        return out

    def common(self, least: int) -> DataFrame:
        """(h, keeper, n) of the keys that ``least`` documents or more hold; the index is gone afterwards."""
        keys, counts = self._merged([run for level in self.levels for run in level])
        n = F.col("n") + F.coalesce("m", F.lit(0))
        found = keys.join(counts.withColumnRenamed("n", "m").hint("merge"), "h", "left").select("h", "keeper", n.alias("n")).where(F.col("n") >= least)
        found = self.scratch.keep(found)
        self.scratch.drop(keys, counts)
        return found


#: A digest that more than one line in so many has is hot; there are fewer of them than this number.
HOT = 1000
#: Dropped digests of one text that are looked up one by one; more are parted first.
FEW = 256


def _is_gone(digest: Column) -> Column:
    return F.when(F.size("__ld_gone") <= FEW, F.array_contains("__ld_gone", digest)).otherwise(F.array_contains(F.get("__ld_parts", (F.crc32(digest) % FEW).cast("int")), digest))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2, bucket: int = 2_000_000) -> DataFrame:
    """The input's rows and columns, plus ``line_dedup`` struct<text, n_lines, n_dropped>.

    A line's key is the line without white space at its ends and with A-Z lower-cased.  Keys of ``min_chars`` code points
    or more that ``min_docs`` documents or more hold lose all their lines, except in the largest id that holds them.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    ident = F.col(f"`{id_col}`")
    bounds = docs.select(ident.cast("long").alias("id")).na.drop().stat.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    batch = F.lit(0)
    for cut in sorted(set(bounds)):
        batch = batch + (F.coalesce(F.col("id"), F.lit(-(2**63))) <= F.lit(int(cut))).cast("int")
    lines = (
        docs.select(ident.cast("long").alias("id"), F.explode(_lines(text_col)).alias("line"))
        .select("id", F.btrim("line", F.lit(WHITE)).alias("line"))
        .where(F.char_length("line") >= min_chars)
        .select("id", digest16(ascii_lower(F.col("line"))).alias("h"))
        .distinct()
        .select("id", "h", batch.alias("batch"))
    )
    lines = scratch.keep(lines, by=["batch"])
    total = lines.count()
    index = LineIndex(scratch, max(8, -(-total // bucket)), fanout)
    for b in range(len(set(bounds)) + 1):
        index.add(lines.where(F.col("batch") == b).groupBy("h").agg(F.max("id").alias("keeper"), F.count("*").alias("n")))
    common = index.common(min_docs)
    is_hot = F.col("n") * HOT > total
    tagged = lines.select("id", "h").join(F.broadcast(common.where(is_hot).select("h", F.col("keeper").alias("hot"), F.lit(True).alias("is_hot"))), "h", "left")
    hot = tagged.where(F.col("is_hot") & ~F.col("id").eqNullSafe(F.col("hot"))).select("id", "h")
    cold = tagged.where(F.col("is_hot").isNull()).select("id", "h").join(common.where(~is_hot).hint("merge"), "h").where(~F.col("id").eqNullSafe(F.col("keeper"))).select("id", "h")
    doomed = hot.unionByName(cold).groupBy(F.col("id").alias("__ld_id")).agg(F.collect_list("h").alias("__ld_gone"))
    gone = F.col("__ld_gone")
    parts = F.when(F.size(gone) > FEW, F.transform(F.sequence(F.lit(0), F.lit(FEW - 1)), lambda k: F.filter(gone, lambda h: F.crc32(h) % FEW == k)))
    doomed = scratch.keep(doomed.withColumn("__ld_parts", parts))  # written, so that no line computes the parts anew
    scratch.drop(lines, common)
    all_lines = _lines(text_col)
    stays = lambda x: ~((F.char_length(F.btrim(x, F.lit(WHITE))) >= min_chars) & _is_gone(digest16(_key(x))))
    kept = F.when(gone.isNull(), all_lines).otherwise(F.filter(all_lines, stays))
    # a merge join at every size: the table of digests to drop grows with the input
    out = docs.drop("line_dedup").join(doomed.hint("merge"), ident.cast("long").eqNullSafe(F.col("__ld_id")), "left")
    out = out.withColumn("__ld_kept", kept)
    return out.withColumn(
        "line_dedup",
        F.struct(
            F.array_join("__ld_kept", "\n").alias("text"),
            F.size(all_lines).cast("long").alias("n_lines"),
            (F.size(all_lines) - F.size("__ld_kept")).cast("long").alias("n_dropped"),
        ),
    ).drop("__ld_id", "__ld_gone", "__ld_parts", "__ld_kept")


def op1_line_dedup(spark, sf_dir):
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("line_dedup.text", 256).alias("kept_sha256"))


#: DuckDB's trim takes the characters to strip; translate lower-cases A-Z alone.
ORACLE = """
WITH l AS (
  SELECT doc_id, k.pos, k.line,
         translate(trim(k.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'line': x, 'pos': i})) AS k FROM documents)),
c AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT l.*, c.key IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM l LEFT JOIN c USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
