"""Sources of pages (doc_id, page_no, text).  Decoding of PDF and images is a boundary: a function that the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST = 100 * 1024 * 1024
PAGES = "path string, page_no int, text string"


def files(spark: SparkSession, path: str, pattern: str = "*", *, too_large: str = "raise") -> DataFrame:
    """Binary files of at most 100 MB.  A larger one is an error when it is read, or with ``too_large="skip"`` left out by the scan's own filter."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    if too_large == "skip":
        return found.where(F.col("length") <= LARGEST)
    if too_large != "raise":
        raise ValueError(f"no such way: {too_large}")
    told = F.concat(F.lit("file too large: "), "path")
    return found.withColumn("path", F.when(F.col("length") > LARGEST, F.raise_error(told)).otherwise(F.col("path")))


def decoded(found: DataFrame, *decoders: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page_no, text) by the first decoder that neither fails nor gives blank text for a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                for decode in decoders:
                    try:
                        pages = decode(bytes(content))
                    except Exception:  # noqa: BLE001  the next decoder is tried
                        continue
                    if pages and "".join(p or "" for p in pages).strip():
                        rows += [(path, i + 1, t or "") for i, t in enumerate(pages)]
                        break
            yield pd.DataFrame(rows, columns=["path", "page_no", "text"])

    return found.select("path", "content").mapInPandas(run, PAGES)


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Text files, pages parted by form feeds."""
    rows = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\f")).alias("i", "text"))
    return rows.select("path", (F.col("i") + 1).alias("page_no"), "text")


def html_structure(pages: DataFrame) -> DataFrame:
    """(page_id, heading, links) of raw HTML (page_id, html)."""
    heading = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return pages.select("page_id", heading.alias("heading"), F.regexp_extract_all("html", F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1)).alias("links"))


def empty_tables(spark: SparkSession) -> DataFrame:
    """What a table reader that is not installed gives."""
    return spark.createDataFrame([], "table_id string, flavor string, r int, c int, text string")
