"""From raw documents to packed training sequences: five stages, each on all rows that the one before kept.

Defined cases: a null or empty text has no language and goes in the first stage; alone, the other stages take null as empty
(line dedup and personal data return it as the empty text); rows that repeat doc_id and text are one document for near copies and two
for the other stages; a null doc_id is kept; texts may be of any length; an empty table gives an empty result. All stages but the last return the columns
of their input, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normweave.llm import langid, line_dedup, packing, pii, simhash
from normweave.llm.common import Scratch, read, row_key

#: Documents whose best language holds less of their letters than this are rejected, as are those without letters.
LEAST_LANGUAGE_SHARE = 0.34


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language; fills in missing values of lang."""
    own, back = _aside(docs, "lang_pred", "lang_score")
    out = langid.identify(own, langid.fitted(own))
    out = out.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANGUAGE_SHARE))
    return _back(out.withColumn("lang", F.coalesce("lang", "lang_pred")), docs, back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that five or more documents share, but for one of them."""
    own, back = _aside(docs, "line_dedup")
    return _with_text(line_dedup.dedup_lines(own), docs, F.col("line_dedup.text"), back)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, blank texts being one group: that with the smallest doc_id.

    Rows are told apart by doc_id and text: a repeated doc_id with another text is another document, rows that repeat both are
    one and any of them stays.  Rows with a null doc_id stay, repeated ones once.
    """
    mark = {"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__null": F.col("doc_id").isNull(), "__key": row_key(F.col("text"))}
    stay = simhash.near_copies(docs, blanks=True).where("stays")
    stay = stay.select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__null"), F.col("row_key").alias("__key"))
    # repeated rows are combined before texts move, so none of them makes a hot key; the join needs no other shuffle of texts
    once = docs.withColumns(mark).dropDuplicates(list(mark))
    return once.join(stay.hint("merge"), list(mark), "left_semi").drop(*mark)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets."""
    own, back = _aside(docs, "pii", "pii_spans")
    return _with_text(pii.detect(own), docs, pii.masked(F.coalesce("text", F.lit("")), F.col("pii_spans")), back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence."""
    return packing.pack(docs, tokenizer=packing.default_tokenizer())


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns that an operator would replace under other names, and the way back."""
    back = {f"__own_{c}": c for c in names if c in docs.columns}
    return docs.withColumnsRenamed({v: k for k, v in back.items()}), back


def _back(out: DataFrame, docs: DataFrame, back: dict[str, str]) -> DataFrame:
    """The columns of docs."""
    return out.drop(*back.values()).withColumnsRenamed(back).select(*[F.col(f"`{c}`") for c in docs.columns])


def _with_text(out: DataFrame, docs: DataFrame, text, back: dict[str, str]) -> DataFrame:
    """The columns of docs with the new text and its length."""
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return _back(out, docs, back)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("pii", personal_data), ("best_fit_packing", pack)]

#: No SQL: Viterbi over learned scores, similarity of shingle sets and a packing are outside it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, mark = read(spark, sf_dir, "documents"), len(Scratch.opened)
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(before)
        Scratch.clear_since(mark)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
