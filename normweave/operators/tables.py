"""Tables as cells: (table_id, flavor, r, c, text), rows and columns from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean_cells(cells: DataFrame) -> DataFrame:
    """Rows and then columns without any value are left out; null becomes ''.  Empty strings are values."""
    some = cells.withColumn("row", F.count("text").over(Window.partitionBy("table_id", "r"))).where("row > 0").drop("row")
    some = some.withColumn("col", F.count("text").over(Window.partitionBy("table_id", "c"))).where("col > 0").drop("col")
    return some.withColumn("text", F.coalesce("text", F.lit("")))


def _all_digits(text):
    return F.replace(F.replace(F.trim(text), F.lit("."), F.lit("")), F.lit(","), F.lit("")).rlike(r"^\d+$")


def headers(cells: DataFrame) -> DataFrame:
    """(table_id, headers, has_header): row 0, unless one of its cells is all digits; then Column_0 and so on."""
    first = cells.where("r = 0").groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("c", "text"))).alias("row"), F.bool_or(_all_digits(F.col("text"))).alias("numeric"))
    named = F.transform("row", lambda x: F.trim(x["text"]))
    generic = F.transform("row", lambda x, i: F.concat(F.lit("Column_"), i.cast("string")))
    return first.select("table_id", F.when(F.col("numeric"), generic).otherwise(named).alias("headers"), (~F.col("numeric")).alias("has_header"))


def body(cells: DataFrame) -> DataFrame:
    """The cells below the header, rows renumbered from 0."""
    out = cells.join(headers(cells).select("table_id", "has_header"), "table_id")
    return out.where((F.col("r") > 0) | ~F.col("has_header")).withColumn("r", F.col("r") - F.col("has_header").cast("int")).drop("has_header")


def table_types(cells: DataFrame) -> DataFrame:
    """(table_id, table_type) by shape and share of long cells."""
    t = cells.groupBy("table_id").agg(F.countDistinct("c").alias("n"), F.avg((F.length("text") > 20).cast("int")).alias("long"))
    return t.select("table_id", F.when(F.col("n") == 0, "unknown").when(F.col("n") == 2, "lookup").when(F.col("long") > 0.5, "reference").otherwise("data").alias("table_type"))


def fill_merged(cells: DataFrame) -> DataFrame:
    """Columns with some, but under half, empty cells are filled forward."""
    column = Window.partitionBy("table_id", "c")
    empty = F.trim("text") == ""
    share = F.avg(empty.cast("int")).over(column)
    filled = F.coalesce(F.last(F.when(~empty, F.col("text")), True).over(column.orderBy("r")), F.lit(""))
    return cells.withColumn("text", F.when((share > 0) & (share < 0.5), filled).otherwise(F.col("text")))


def valid_tables(cells: DataFrame) -> DataFrame:
    """(table_id) with a row, two columns and a fifth of the cells not blank."""
    t = cells.groupBy("table_id").agg(F.countDistinct("r").alias("rows"), F.countDistinct("c").alias("cols"), F.avg((F.trim("text") != "").cast("int")).alias("full"))
    return t.where("rows >= 1 AND cols >= 2 AND full >= 0.2").select("table_id")


def distinct_tables(cells: DataFrame) -> DataFrame:
    """The cells of the first of equal tables: lattice before stream, then by id."""
    rows = cells.groupBy("table_id", "flavor").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("r", "c", "text")))), 256).alias("csv"))
    w = Window.partitionBy("csv").orderBy("flavor", "table_id")
    first = rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("table_id", "flavor")
    return cells.join(first, ["table_id", "flavor"], "left_semi")


def process(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables, cells): cleaned, with header and type, merged cells filled (after the type is settled), valid ones only."""
    clean = clean_cells(cells)
    below = body(clean)
    filled = fill_merged(below)
    tables = headers(clean).join(table_types(below), "table_id").join(valid_tables(filled), "table_id", "left_semi")
    size = filled.groupBy("table_id").agg((F.max("r") + 1).alias("n_rows"), (F.max("c") + 1).alias("n_cols"))
    return tables.join(size, "table_id"), filled.join(tables, "table_id", "left_semi")


def lookup_value(cells: DataFrame, key: str) -> DataFrame:
    """(table_id, value): column 1 of the first row whose column 0 matches the key, a pattern without regard to case."""
    rows = cells.where("c IN (0, 1)").groupBy("table_id", "r").agg(F.max(F.when(F.col("c") == 0, F.col("text"))).alias("k"), F.max(F.when(F.col("c") == 1, F.col("text"))).alias("v"))
    return rows.where(F.col("k").rlike(f"(?iu){key}")).groupBy("table_id").agg(F.min_by("v", "r").alias("value"))


def search(cells: DataFrame, text: str) -> DataFrame:
    return cells.where(F.contains(F.lower("text"), F.lit(text.lower()))).select("table_id").distinct()


def markdown(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_id, markdown) of tables (table_id, headers and, where there are such columns, title and caption) and their cells.

    A header, a rule and a line for each row, padded to the widest cell (a header counts two more); columns of whole numbers
    only stand at the right.
    """
    text = lambda name: F.col(name) if name in tables.columns else F.lit(None).cast("string")
    heads = tables.select("table_id", F.posexplode("headers").alias("c", "text")).select("table_id", F.lit(-1).alias("r"), "c", "text")
    every = heads.unionByName(cells.select("table_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.coalesce("text", F.lit("")).alias("text")))
    column = Window.partitionBy("table_id", "c")
    number = F.min(F.when(F.col("r") >= 0, F.col("text").rlike(r"^\s*[+-]?\d+\s*$"))).over(column)
    every = every.withColumn("width", F.max(F.char_length("text") + F.when(F.col("r") < 0, 2).otherwise(0)).over(column)).withColumn("right", F.coalesce(number, F.lit(False)))
    rule = every.where("r < 0").withColumn("padded", F.when(F.col("right"), F.concat(F.repeat(F.lit("-"), F.col("width") + 1), F.lit(":"))).otherwise(F.concat(F.lit(":"), F.repeat(F.lit("-"), F.col("width") + 1))))
    space = F.repeat(F.lit(" "), F.col("width") - F.char_length("text"))
    every = every.withColumn("padded", F.concat(F.lit(" "), F.when(F.col("right"), F.concat(space, "text")).otherwise(F.concat("text", space)), F.lit(" ")))
    # line 0 is the header, 1 the rule
    every = every.select("table_id", F.when(F.col("r") >= 0, F.col("r") + 2).otherwise(0).alias("line"), "c", "padded").unionByName(rule.select("table_id", F.lit(1).alias("line"), "c", "padded"))
    in_order = lambda key, value, between: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), between)
    lines = every.groupBy("table_id", "line").agg(F.concat(F.lit("|"), in_order("c", "padded", "|"), F.lit("|")).alias("row"))
    body_ = lines.groupBy("table_id").agg(in_order("line", "row", "\n").alias("body"))
    above = F.concat(F.when(F.coalesce(text("title"), F.lit("")) != "", F.concat(F.lit("### "), text("title"), F.lit("\n\n"))).otherwise(""), F.when(F.coalesce(text("caption"), F.lit("")) != "", F.concat(F.lit("*"), text("caption"), F.lit("*\n\n"))).otherwise(""))
    return tables.select("table_id", above.alias("above")).join(body_, "table_id").select("table_id", F.concat("above", "body").alias("markdown"))


def to_records(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Each table's columns plus ``data``, an array of its rows as maps from header to text."""
    named = cells.join(tables.select("table_id", "headers"), "table_id").withColumn("header", F.get("headers", F.col("c").cast("int")))
    rows = named.groupBy("table_id", "r").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("c", "header", "text"))), lambda x: F.struct(x["header"], x["text"]))).alias("row"))
    data = rows.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.map_entries("row").alias("row")))), lambda x: F.map_from_entries(x["row"])).alias("data"))
    return tables.join(data, "table_id", "left")


def concepts(cells: DataFrame, most: int = 5) -> DataFrame:
    """(table_id, concept): headers, then first cells of ten rows, at most ``most``, in that order."""
    heads = headers(cells).select("table_id", F.posexplode("headers").alias("pos", "label")).where(F.length("label") > 2).where(~F.lower("label").isin("id", "no", "ref")).select("table_id", F.lit(0).alias("part"), "pos", "label")
    firsts = body(cells).where("c = 0 AND r < 10").select("table_id", F.lit(1).alias("part"), F.col("r").alias("pos"), F.col("text").alias("label")).where(F.length("label") > 3)
    every = heads.unionByName(firsts).groupBy("table_id", "label").agg(F.min(F.struct("part", "pos")).alias("at"))
    w = Window.partitionBy("table_id").orderBy("at", "label")
    return every.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("table_id", "rn", F.col("label").alias("concept"))
