"""What the operators share: tables in the shared folder, text normalisation, name-safe columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the operators' contracts mean.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.  One of our own only for a local master (tests), where no folder is another machine's."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="normweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Tables of one operator call, written to the shared folder.

    A written table cuts the lineage and survives lost executors.  ``drop`` removes a table as soon as a later one
    replaces it; the ones that the returned DataFrame reads stay until ``clear`` or, where nobody calls that, the end of
    the application.
    """

    #: Those not cleared yet, oldest first.
    opened: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, tuple[str, DataFrame]] = {}
        self.names: dict[str, str] = {}
        at, files = self._at(self.root)
        files.mkdirs(at)
        files.deleteOnExit(at)
        self.opened.append(self)

    def keep(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/t{self.n}"
        self.n += 1
        writer = df.write.mode("error")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return self.known(path, df.schema)

    def keep_sorted(self, df: DataFrame, key: str, buckets: int, *, dealt: bool = False) -> DataFrame:
        """A table in ``buckets`` files by key, each sorted by it: joins of two such tables merge without a shuffle.

        ``dealt`` says that df is the join of such tables and needs no dealing either.
        """
        name = f"run_{uuid.uuid4().hex}"
        path = f"{self.root}/t{self.n}"
        self.n += 1
        rows = df if dealt else df.repartition(buckets, key)
        rows.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        self.paths[id(out)] = path, out
        self.names[path] = name
        return out

    def known(self, path: str, schema) -> DataFrame:
        """The written table at path, which ``drop`` knows from now on."""
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = path, out  # the table itself, so that its id is not given to another one
        return out

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        if name := self.names.pop(path, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        at, files = self._at(path)
        files.delete(at, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                self._delete(path[0])

    def clear(self) -> None:
        for path in list(self.names):
            self._delete(path)
        self._delete(self.root)
        self.paths.clear()
        if self in self.opened:
            self.opened.remove(self)

    @classmethod
    def clear_since(cls, mark: int) -> None:
        """Clears those opened after the first ``mark``: for callers that have written an operator's result."""
        for scratch in cls.opened[mark:]:
            scratch.clear()


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else.  ``lower`` has a fast path for ASCII; other strings go through ``translate``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def without_white(c: Column) -> Column:
    """The string without any of ``WHITE``: byte searches, which are several times as fast as a regex."""
    for x in WHITE:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def digest16(c: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(c, 256)), 1, 16)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Elements of a block: a list that grows in a fold is copied at each step, so it grows within a block, and then by blocks.
BLOCK = 128


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value being computed once: a lambda that holds an expression would compute it for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def in_blocks(items: Column) -> Column:
    """array<array<T>>: the items in blocks, none for none."""

    def cut(xs):
        starts = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))

    return bound(items, cut)


def fold(items: Column, state: Column, element: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """array<element>: step gives the next state and an array of elements for each item in order."""
    none = F.array().cast(f"array<{element}>")

    def one(acc, x):
        now, out = step(acc["state"], x)
        return F.struct(now.alias("state"), F.concat(acc["out"], out).alias("out"))

    def block(acc, xs):
        inner = F.aggregate(xs, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return F.struct(inner["state"].alias("state"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    first = F.struct(state.alias("state"), F.array().cast(f"array<array<{element}>>").alias("out"))
    return F.flatten(F.aggregate(in_blocks(items), first, block, lambda acc: acc["out"]))


def spliced(text: Column, pieces: Column) -> Column:
    """The text with each piece (struct<since,start,end,by>: end of the piece before, its places, what replaces it) replaced, in order.

    The text of a block of pieces is taken once, and their gaps from it: a place far on costs a walk from the start.
    """

    def own(xs):
        return F.struct(xs.alias("xs"), xs[0]["since"].alias("lo"), F.substr(text, (xs[0]["since"] + 1).cast("int"), (F.element_at(xs, -1)["end"] - xs[0]["since"]).cast("int")).alias("t"))

    def part(b):
        return F.array_join(F.transform(b["xs"], lambda s: F.concat(F.substr(b["t"], (s["since"] - b["lo"] + 1).cast("int"), (s["start"] - s["since"]).cast("int")), s["by"])), "")

    def whole(kept):
        body = F.array_join(F.transform(F.transform(in_blocks(kept), own), part), "")
        return F.when(F.size(kept) > 0, F.concat(body, F.substr(text, (F.element_at(kept, -1)["end"] + 1).cast("int"), F.char_length(text)))).otherwise(text)

    return bound(pieces, whole)


def row_key(text: Column) -> Column:
    """Tells rows with the same id apart: 64 bits of the text (null as empty)."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


_resident: dict[tuple, object] = {}


def resident(key: tuple | None, build: Callable[[], object] = lambda: None) -> object:
    """What ``build`` makes, kept in a worker process from task to task, one object at a time.

    Workers outlive a stage, so a model with its words would stay beside the next stage's: that of another key goes first.
    A stage without a model asks for None.
    """
    if key not in _resident:
        _resident.clear()
        pa.default_memory_pool().release_unused()
        _resident[key] = build()
    return _resident[key]
