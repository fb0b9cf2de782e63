"""The store of chunks and the registry of documents, as Parquet tables under one folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Catalog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def add(self, name: str, rows: DataFrame, by: list[str] | None = None) -> int:
        """Appends rows and tells how many; observed while they are written, not counted again."""
        from pyspark.sql import Observation

        seen = Observation()
        out = rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append")
        (out.partitionBy(*by) if by else out).parquet(self._path(name))
        return seen.get["n"]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    def by_ids(self, name: str, ids: list[str], column: str = "chunk_id") -> DataFrame:
        """Rows with the given ids; missing ones are absent."""
        return self.table(name).where(F.col(column).isin(ids))

    def statistics(self, name: str) -> dict:
        n = self.table(name).count() if self._exists(name) else 0
        return {"name": name, "count": n, "folder": self.folder}

    def delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        for name in ("chunks", "documents", "nodes", "edges"):
            self.delete(name)


def _json(value, kind):
    """A value as JSON text with a space after each comma and colon."""
    if isinstance(kind, T.ArrayType):
        inner = F.array_join(F.transform(value, lambda x: _json(x, kind.elementType)), ", ")
        return F.coalesce(F.concat(F.lit("["), inner, F.lit("]")), F.lit("null"))
    if isinstance(kind, T.MapType):
        pair = lambda e: F.concat(_json(e["key"].cast("string"), T.StringType()), F.lit(": "), _json(e["value"], kind.valueType))
        return F.coalesce(F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(value), pair), ", "), F.lit("}")), F.lit("null"))
    if isinstance(kind, T.StructType):
        pairs = [F.concat(F.lit(json.dumps(f.name) + ": "), _json(value[f.name], f.dataType)) for f in kind]
        return F.when(value.isNull(), "null").otherwise(F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}")))
    # one value as an array, without the brackets
    text = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.coalesce(F.substring(text, 2, 2**31 - 1).substr(F.lit(1), F.length(text) - 2), F.lit("null"))


def sanitized(rows: DataFrame, column: str = "metadata") -> DataFrame:
    """The rows with each field of a struct as a plain value: text, numbers, truth values and nulls stay, arrays become
    their elements joined by a comma and a space, maps and structs JSON, anything else its text."""
    fields = []
    for f in rows.schema[column].dataType:
        value, kind = F.col(column)[f.name], f.dataType
        if isinstance(kind, T.ArrayType):
            value = F.when(value.isNotNull(), F.array_join(value.cast("array<string>"), ", ", "None"))
        elif isinstance(kind, (T.MapType, T.StructType)):
            value = F.when(value.isNotNull(), _json(value, kind))
        elif not isinstance(kind, (T.StringType, T.NumericType, T.BooleanType, T.NullType)):
            value = value.cast("string")
        fields.append(value.alias(f.name))
    return rows.withColumn(column, F.struct(*fields))
