"""Property graph: nodes (node_id, node_type, label, properties) and edges (edge_seq, src, dst, edge_type).

A directed multigraph: parallel edges stay, ``edge_seq`` gives their order.  Loops write each round to the checkpoint folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug


def _folder(spark) -> str:
    """The session's checkpoint folder, set where it is not yet; one of our own only where the session names none."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="normweave-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder, for tables that many plans read: each would hold the
    whole plan of df otherwise, and compute it.  The files go with the application."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/stored-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each node_id of (node_seq, node_id, ...): the last one."""
    cols = [c for c in nodes.columns if c not in ("node_id", "node_seq")]
    return nodes.groupBy("node_id").agg(F.max_by(F.struct(*cols), "node_seq").alias("n")).select("node_id", "n.*")


def full_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes and the endpoints that no node row names, as type unknown."""
    ends = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id"))).distinct()
    new = ends.join(nodes, "node_id", "left_anti").select("node_id", F.lit("unknown").alias("node_type"), F.col("node_id").alias("label"))
    return nodes.unionByName(new, allowMissingColumns=True)


def search_nodes(nodes: DataFrame, text: str, node_type: str | None = None) -> DataFrame:
    """Nodes whose label, type or a property holds the text.  An unknown type asks all nodes."""
    found = nodes.where(F.contains(F.lower("label"), F.lit(text.lower())) | F.contains(F.lower("node_type"), F.lit(text.lower())) | F.coalesce(F.exists(F.map_values("properties"), lambda v: F.contains(F.lower(v), F.lit(text.lower()))), F.lit(False)))
    if node_type and not nodes.where(F.col("node_type") == node_type).isEmpty():
        found = found.where(F.col("node_type") == node_type)
    return found


def related(edges: DataFrame, starts: DataFrame, types: list[str] | None = None, most: int = 10) -> DataFrame:
    """(node_id, related, direction, rn): out-edges first, repeats kept; then in-edges to nodes not listed yet."""
    if types:
        edges = edges.where(F.col("edge_type").isin(types))
    out = edges.join(starts, edges.src == starts.node_id).select("node_id", F.col("dst").alias("related"), F.lit("out").alias("direction"), "edge_seq")
    into = edges.join(starts, edges.dst == starts.node_id).select("node_id", F.col("src").alias("related"), F.lit("in").alias("direction"), "edge_seq")
    into = into.groupBy("node_id", "related", "direction").agg(F.min("edge_seq").alias("edge_seq")).join(out.select("node_id", "related").distinct(), ["node_id", "related"], "left_anti")
    first = Window.partitionBy("node_id", "direction", "related")
    both = out.unionByName(into).withColumn("first", F.min("edge_seq").over(first))
    w = Window.partitionBy("node_id").orderBy(F.desc("direction"), "first", "edge_seq")
    return both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("node_id", "related", "direction", "rn")


def reachable(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, node_id, distance): breadth-first over out-edges, 1 to depth, without the start."""
    hop = edges.select("src", "dst").distinct()
    seen = starts.select(F.col("node_id").alias("start"), "node_id", F.lit(0).alias("distance"))
    front = seen
    for d in range(1, depth + 1):
        new = front.join(hop, front.node_id == hop.src).select("start", F.col("dst").alias("node_id")).distinct()
        front = checkpoint(new.join(seen, ["start", "node_id"], "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(front)
    return seen.where("distance > 0")


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """One row (path) or none: the shortest directed path; of equals the least in order of its nodes."""
    hop = edges.select("src", "dst").distinct()
    front = edges.sparkSession.createDataFrame([(source, [source])], "node_id string, path array<string>")
    seen = front.select("node_id")
    while True:
        hit = front.where(F.col("node_id") == target)
        if not hit.isEmpty():
            return hit.select("path")
        step = front.join(hop, front.node_id == hop.src).select(F.col("dst").alias("node_id"), F.concat("path", F.array("dst")).alias("path"))
        front = checkpoint(step.groupBy("node_id").agg(F.min("path").alias("path")).join(seen, "node_id", "left_anti"))
        if front.isEmpty():
            return front.select("path")
        seen = checkpoint(seen.unionByName(front.select("node_id")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component): the least node of the weakly connected component.

    Labels move to neighbours and then jump along to their own label, so the rounds grow with the logarithm of the diameter.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").distinct()
    both = checkpoint(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpoint(nodes.select("node_id", F.col("node_id").alias("component")).distinct())
    while True:
        near = both.join(label, both.b == label.node_id).groupBy("a").agg(F.min("component").alias("least"))
        new = label.join(near, label.node_id == near.a, "left").select("node_id", F.least("component", "least").alias("component"))
        jump = new.select(F.col("node_id").alias("at"), F.col("component").alias("beyond"))
        new = checkpoint(new.join(jump, new.component == jump.at, "left").select("node_id", F.least("component", "beyond").alias("component")))
        moved = new.join(label.withColumnRenamed("component", "old"), "node_id").where("component <> old")
        if moved.isEmpty():
            return new
        label = new


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id"))).groupBy("node_id").agg(F.count("*").alias("degree"))
    n = nodes.count()
    return nodes.select("node_id").join(ends, "node_id", "left").select("node_id", (F.coalesce("degree", F.lit(0)) / F.lit(max(n - 1, 1))).alias("centrality"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, density."""
    every = full_nodes(nodes, edges)
    n = every.agg(F.count("*").alias("total_nodes"))
    m = edges.agg(F.count("*").alias("total_edges"))
    c = components(every, edges).agg(F.countDistinct("component").alias("components"))
    density = F.when(F.col("total_nodes") > 1, F.col("total_edges") / (F.col("total_nodes") * (F.col("total_nodes") - 1))).otherwise(0.0)
    return n.join(m).join(c).withColumn("density", density)


def counts_by_type(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.groupBy(F.col("node_type").alias("type")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("node"))
    return a.unionByName(edges.groupBy(F.col("edge_type").alias("type")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge")))


def most_central(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    return degree_centrality(nodes, edges).orderBy(F.desc("centrality"), "node_id").limit(k)


def node_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, label, predecessors, successors), each a sorted set."""
    none = F.array().cast("array<string>")
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_set("dst")).alias("successors"))
    into = edges.groupBy(F.col("dst").alias("node_id")).agg(F.array_sort(F.collect_set("src")).alias("predecessors"))
    return nodes.join(into, "node_id", "left").join(out, "node_id", "left").select("node_id", "label", F.coalesce("predecessors", none).alias("predecessors"), F.coalesce("successors", none).alias("successors"))


def subgraph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends among keep (node_id)."""
    return edges.join(keep.select(F.col("node_id").alias("src")), "src", "left_semi").join(keep.select(F.col("node_id").alias("dst")), "dst", "left_semi")


#: Colours of node types.  Fixed values; other types have none.
COLOURS = {"document": "#FF6B6B", "section": "#4ECDC4", "table": "#45B7D1", "formula": "#96CEB4", "concept": "#DDA0DD", "variable": "#FFD93D", "rule": "#FF8C94"}


def coloured(nodes: DataFrame) -> DataFrame:
    """The nodes plus ``colour``."""
    return nodes.withColumn("colour", F.element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), F.col("node_type")))


def export(nodes: DataFrame, edges: DataFrame, form: str = "json") -> DataFrame:
    """(part, ord, text): records of nodes and edges as JSON, GraphML or GEXF elements."""
    if form == "json":
        a = nodes.select(F.lit("node").alias("part"), F.col("node_id").alias("ord"), F.to_json(F.struct(F.col("node_id").alias("id"), "node_type", "label")).alias("text"))
        b = edges.select(F.lit("edge").alias("part"), F.lpad(F.col("edge_seq").cast("string"), 20, "0").alias("ord"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "edge_type")).alias("text"))
        return a.unionByName(b)
    if form not in ("graphml", "gexf"):
        raise ValueError(f"no such form: {form}")
    xml = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    label = '<data key="label">%s</data></node>' if form == "graphml" else ""
    node = F.format_string('<node id="%s">' + label, xml("node_id"), xml("label")) if form == "graphml" else F.format_string('<node id="%s" label="%s"/>', xml("node_id"), xml("label"))
    a = nodes.select(F.lit("node").alias("part"), F.col("node_id").alias("ord"), node.alias("text"))
    b = edges.select(F.lit("edge").alias("part"), F.lpad(F.col("edge_seq").cast("string"), 20, "0").alias("ord"), F.format_string('<edge id="%s" source="%s" target="%s"/>', F.col("edge_seq").cast("string"), xml("src"), xml("dst")).alias("text"))
    return a.unionByName(b)


# --- building ---------------------------------------------------------------------------------------------------------


def _id(kind: str, *cols):
    return F.concat_ws("_", F.lit(kind), *[F.col(c).cast("string") for c in cols])


def build(documents: DataFrame, sections: DataFrame, formulas: DataFrame, mentions: DataFrame, shared: DataFrame, tables: DataFrame | None = None, table_of: DataFrame | None = None, concepts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of documents (doc_id, title), sections, formulas (with section ``number``), mentions and shared
    variables.  Variables are global nodes, so they link documents.  ``edge_seq`` follows kind, document and place."""
    null = F.lit(None).cast("map<string,string>").alias("properties")
    node = lambda df, i, kind, label: df.select(i.alias("node_id"), F.lit(kind).alias("node_type"), label.cast("string").alias("label"), null)
    variables = formulas.select(F.explode("variables").alias("v")).distinct()
    nodes = node(documents, _id("doc", "doc_id"), "document", F.col("title"))
    nodes = nodes.unionByName(node(sections.dropDuplicates(["doc_id", "number"]), _id("section", "doc_id", "number"), "section", F.concat_ws(" ", "number", "title")))
    nodes = nodes.unionByName(node(formulas, _id("formula", "doc_id", "formula_no"), "formula", F.col("raw_text")))
    nodes = nodes.unionByName(node(variables, _id("variable", "v"), "variable", F.col("v")))
    edge = lambda df, part, a, b, kind, *order: df.select(F.lit(part).alias("part"), F.col("doc_id"), F.struct(*order).cast("string").alias("o"), a.alias("src"), b.alias("dst"), F.lit(kind).alias("edge_type"))
    key = F.lpad(F.col("seq").cast("string"), 9, "0")
    up = sections.select("doc_id", F.col("seq").alias("parent_seq"), F.col("number").alias("up"))
    tree = sections.select("doc_id", "seq", "number", "parent_seq").join(up, ["doc_id", "parent_seq"], "left")
    edges = edge(tree, 0, F.coalesce(F.concat_ws("_", F.lit("section"), F.col("doc_id").cast("string"), F.when(F.col("up").isNotNull(), F.col("up"))), F.lit("")), _id("section", "doc_id", "number"), "contains", key)
    edges = edges.withColumn("src", F.when(F.col("src") == F.concat_ws("_", F.lit("section"), F.col("doc_id").cast("string")), _id("doc", "doc_id")).otherwise(F.col("src")))
    if "number" in formulas.columns:
        there = formulas.join(sections.select("doc_id", "number").distinct(), ["doc_id", "number"], "left_semi")
        edges = edges.unionByName(edge(there, 1, _id("section", "doc_id", "number"), _id("formula", "doc_id", "formula_no"), "contains", F.lpad(F.col("formula_no").cast("string"), 9, "0")))
    uses = formulas.select("doc_id", "formula_no", F.posexplode("variables").alias("k", "v"))
    edges = edges.unionByName(edge(uses, 2, _id("formula", "doc_id", "formula_no"), _id("variable", "v"), "uses_variable", F.lpad(F.col("formula_no").cast("string"), 9, "0"), "k"))
    for part, a, b in ((3, "a", "b"), (4, "b", "a")):
        edges = edges.unionByName(edge(shared, part, _id("formula", "doc_id", a), _id("formula", "doc_id", b), "shares_variable", F.lpad(F.col("a").cast("string"), 9, "0"), F.lpad(F.col("b").cast("string"), 9, "0"), "variable"))
    edges = edges.unionByName(edge(mentions, 5, _id("section", "doc_id", "source"), _id("section", "doc_id", "target"), "references", "source", "target"))
    if tables is not None:
        nodes = nodes.unionByName(node(tables, _id("table", "doc_id", "table_id"), "table", F.coalesce("title", "table_id")))
        edges = edges.unionByName(edge(tables, 6, _id("doc", "doc_id"), _id("table", "doc_id", "table_id"), "contains", "table_id"))
        if table_of is not None:
            edges = edges.unionByName(edge(table_of, 7, _id("section", "doc_id", "number"), _id("table", "doc_id", "table_id"), "contains", "table_id"))
    if concepts is not None:
        terms = concepts.withColumn("slug", slug(F.col("concept")))
        nodes = nodes.unionByName(node(terms.groupBy("slug").agg(F.min("concept").alias("concept")), F.col("slug"), "concept", F.col("concept")))
        edges = edges.unionByName(edge(terms, 8, _id("table", "doc_id", "table_id"), F.col("slug"), "related_to", "table_id", "rn"))
    return nodes, with_edge_seq(edges)


def with_edge_seq(edges: DataFrame) -> DataFrame:
    """A number for each edge that only depends on (part, doc_id, o): dense within a document, documents far apart.

    One global counter would take one task; order is only compared among the edges of a node's neighbourhood.
    """
    w = Window.partitionBy("doc_id").orderBy("part", "o", "src", "dst")
    number = "decimal(20,0)"
    doc = F.col("doc_id") if edges.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64("doc_id")
    return edges.withColumn("edge_seq", doc.cast(number) * F.lit(10**12).cast("decimal(13,0)") + F.row_number().over(w)).select("edge_seq", "src", "dst", "edge_type")
