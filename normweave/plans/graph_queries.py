"""Queries on graphs: geography (region to nation to customer and supplier), links of pages, and the graph of the derived text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .ingest import ingest
from .spec import SECTIONS, TEXTS, pages
from .text_queries import CELLS_SQL, CONCEPTS_SQL, FORMULA_SQL, cells


def _geo(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    node = lambda df, key, kind, label: df.select(F.concat(F.lit(f"{kind}_"), F.col(key).cast("string")).alias("node_id"), F.lit(kind).alias("node_type"), F.col(label).alias("label"), F.lit(None).cast("map<string,string>").alias("properties"))
    region, nation, supplier = read("region"), read("nation"), read("supplier")
    nodes = node(region, "r_regionkey", "region", "r_name").unionByName(node(nation, "n_nationkey", "nation", "n_name")).unionByName(node(supplier, "s_suppkey", "supplier", "s_name"))
    edge = lambda df, seq, a, b, kind: df.select(seq.cast("long").alias("edge_seq"), a.alias("src"), b.alias("dst"), F.lit(kind).alias("edge_type"))
    ref = lambda kind, c: F.concat(F.lit(f"{kind}_"), F.col(c).cast("string"))
    edges = edge(nation, F.col("n_nationkey"), ref("region", "n_regionkey"), ref("nation", "n_nationkey"), "contains")
    edges = edges.unionByName(edge(supplier, 1000 + F.col("s_suppkey"), ref("nation", "s_nationkey"), ref("supplier", "s_suppkey"), "contains"))
    # every third supplier refers back to its nation and twice to the next supplier
    third = supplier.where("s_suppkey % 3 = 0")
    edges = edges.unionByName(edge(third, 1_000_000 + F.col("s_suppkey"), ref("supplier", "s_suppkey"), ref("nation", "s_nationkey"), "references"))
    edges = edges.unionByName(edge(third, 2_000_000 + F.col("s_suppkey"), ref("supplier", "s_suppkey"), F.concat(F.lit("supplier_"), (F.col("s_suppkey") + 1).cast("string")), "related_to"))
    edges = edges.unionByName(edge(third, 3_000_000 + F.col("s_suppkey"), ref("supplier", "s_suppkey"), F.concat(F.lit("supplier_"), (F.col("s_suppkey") + 1).cast("string")), "related_to"))
    return nodes, edges


_GEO = """nodes AS (SELECT 'region_' || CAST(r_regionkey AS VARCHAR) AS node_id, 'region' AS node_type, r_name AS label FROM region
 UNION ALL SELECT 'nation_' || CAST(n_nationkey AS VARCHAR), 'nation', n_name FROM nation UNION ALL SELECT 'supplier_' || CAST(s_suppkey AS VARCHAR), 'supplier', s_name FROM supplier),
edges AS (SELECT CAST(n_nationkey AS BIGINT) AS edge_seq, 'region_' || CAST(n_regionkey AS VARCHAR) AS src, 'nation_' || CAST(n_nationkey AS VARCHAR) AS dst, 'contains' AS edge_type FROM nation
 UNION ALL SELECT 1000 + s_suppkey, 'nation_' || CAST(s_nationkey AS VARCHAR), 'supplier_' || CAST(s_suppkey AS VARCHAR), 'contains' FROM supplier
 UNION ALL SELECT 1000000 + s_suppkey, 'supplier_' || CAST(s_suppkey AS VARCHAR), 'nation_' || CAST(s_nationkey AS VARCHAR), 'references' FROM supplier WHERE s_suppkey % 3 = 0
 UNION ALL SELECT 2000000 + s_suppkey, 'supplier_' || CAST(s_suppkey AS VARCHAR), 'supplier_' || CAST(s_suppkey + 1 AS VARCHAR), 'related_to' FROM supplier WHERE s_suppkey % 3 = 0
 UNION ALL SELECT 3000000 + s_suppkey, 'supplier_' || CAST(s_suppkey AS VARCHAR), 'supplier_' || CAST(s_suppkey + 1 AS VARCHAR), 'related_to' FROM supplier WHERE s_suppkey % 3 = 0),
every_node AS (SELECT node_id, node_type, label FROM nodes UNION ALL SELECT DISTINCT x, 'unknown', x FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges) WHERE x NOT IN (SELECT node_id FROM nodes)),
hops AS (SELECT DISTINCT src, dst FROM edges)"""


def graph_edges(spark, sf_dir):
    nodes, edges = _geo(spark, sf_dir)
    return graph.counts_by_type(nodes, edges)


def graph_nodes(spark, sf_dir):
    return graph.full_nodes(*_geo(spark, sf_dir)).groupBy("node_type").agg(F.count("*").alias("n"))


def graph_related(spark, sf_dir):
    nodes, edges = _geo(spark, sf_dir)
    return graph.related(edges, nodes.where("node_type = 'nation'").select("node_id"), None, 10).select("node_id", "related", "direction", F.col("rn").cast("int").alias("rn"))


def graph_bfs2(spark, sf_dir):
    nodes, edges = _geo(spark, sf_dir)
    return graph.reachable(edges, nodes.where("node_type = 'region'").select("node_id"), 2)


def graph_path(spark, sf_dir):
    """From the region of the first supplier to that supplier."""
    _, edges = _geo(spark, sf_dir)
    supplier, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    start = supplier.where("s_suppkey = 1").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    return graph.shortest_path(edges, f"region_{start}", "supplier_1").select(F.array_join("path", ">").alias("path"))


def graph_components(spark, sf_dir):
    nodes, edges = _geo(spark, sf_dir)
    return graph.components(nodes, edges.where("edge_type <> 'references'"))


def graph_stats(spark, sf_dir):
    out = graph.statistics(*_geo(spark, sf_dir))
    return out.select("total_nodes", "total_edges", "components", F.round("density", 9).alias("density"))


def graph_centrality(spark, sf_dir):
    return graph.most_central(*_geo(spark, sf_dir)).select("node_id", F.round("centrality", 9).alias("centrality"))


def graph_search(spark, sf_dir):
    return graph.search_nodes(_geo(spark, sf_dir)[0], "ION").select("node_id", "node_type", "label")


def graph_context(spark, sf_dir):
    out = graph.node_context(*_geo(spark, sf_dir))
    return out.select("node_id", F.array_join("predecessors", ",").alias("predecessors"), F.array_join("successors", ",").alias("successors"))


def graph_subgraph(spark, sf_dir):
    nodes, edges = _geo(spark, sf_dir)
    return graph.subgraph(edges, nodes.where("node_type <> 'supplier'")).select("edge_seq", "src", "dst")


def graph_export(spark, sf_dir):
    return graph.export(*_geo(spark, sf_dir)).where("part = 'edge'").select("ord", "text")


def page_links(spark, sf_dir):
    """What the pages of a host link to: (host, target, links)."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    links = p.select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))).alias("dst"))
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def _ingested(spark, sf_dir):
    """The derived text with two tables: the regions on page 1 of document 0, the nations, in two flavors, on page 2 of document 1."""
    region = F.col("table_id") == "region"
    return ingest(pages(spark, sf_dir), cells(spark, sf_dir).select(F.when(region, 0).otherwise(1).cast("long").alias("doc_id"), F.when(region, 1).otherwise(2).alias("page_number"), "*"))


def document_graph(spark, sf_dir):
    """The graph that ingestion builds: edges by type."""
    return _ingested(spark, sf_dir).edges.groupBy("edge_type").agg(F.count("*").alias("n"))


def document_nodes(spark, sf_dir):
    return _ingested(spark, sf_dir).nodes.groupBy("node_type").agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("ids"))


def document_registry(spark, sf_dir):
    return _ingested(spark, sf_dir).documents.select("doc_id", "title", "total_pages", "n_sections", "n_formulas", "n_tables")


def ingest_chunks(spark, sf_dir):
    return _ingested(spark, sf_dir).chunks.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids"))


def graph_upsert(spark, sf_dir):
    """Nodes that come several times: the last one counts."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = nation.select(F.col("n_regionkey").cast("string").alias("node_id"), F.col("n_nationkey").alias("node_seq"), F.col("n_name").alias("label"))
    return graph.coloured(graph.upsert_nodes(rows).withColumn("node_type", F.when(F.col("node_id") == "0", "section").otherwise("other"))).select("node_id", "label", "colour")


#: Formulas of sections: the relations f and v of the text queries, over section contents; doc_id holds document and section.
_FORMED = SECTIONS + ", stexts AS (SELECT doc_id * 1000000 + seq AS doc_id, content AS text FROM sections_)" + FORMULA_SQL[len(TEXTS) :].replace("FROM texts", "FROM stexts")
QUERIES = {
    "graph_edges": (graph_edges, f"WITH {_GEO} SELECT node_type AS type, count(*) AS n, 'node' AS kind FROM nodes GROUP BY 1 UNION ALL SELECT edge_type, count(*), 'edge' FROM edges GROUP BY 1"),
    "graph_nodes": (graph_nodes, f"WITH {_GEO} SELECT node_type, count(*) AS n FROM every_node GROUP BY 1"),
    "graph_related": (
        graph_related,
        f"WITH {_GEO}, s AS (SELECT node_id FROM nodes WHERE node_type = 'nation'), o AS (SELECT node_id, dst AS related, 'out' AS direction, edge_seq FROM edges JOIN s ON src = node_id), i AS (SELECT node_id, src AS related, 'in' AS direction, min(edge_seq) AS edge_seq FROM edges JOIN s ON dst = node_id GROUP BY 1, 2), u AS (SELECT * FROM o UNION ALL SELECT i.* FROM i WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.node_id = i.node_id AND o.related = i.related)), f AS (SELECT *, min(edge_seq) OVER (PARTITION BY node_id, direction, related) AS first FROM u) SELECT node_id, related, direction, CAST(row_number() OVER (PARTITION BY node_id ORDER BY direction DESC, first, edge_seq) AS INTEGER) AS rn FROM f QUALIFY rn <= 10",
    ),
    "graph_bfs2": (graph_bfs2, f'WITH RECURSIVE {_GEO}, w("start", node_id, distance) AS (SELECT node_id, node_id, 0 FROM nodes WHERE node_type = \'region\' UNION SELECT w."start", h.dst, w.distance + 1 FROM w JOIN hops h ON w.node_id = h.src WHERE w.distance < 2) SELECT "start", node_id, CAST(min(distance) AS INTEGER) AS distance FROM w WHERE node_id <> "start" GROUP BY 1, 2'),
    "graph_path": (graph_path, f"WITH RECURSIVE {_GEO}, z AS (SELECT 'region_' || n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1), w(node_id, path, d) AS (SELECT r, r, 0 FROM z UNION SELECT h.dst, w.path || '>' || h.dst, d + 1 FROM w JOIN hops h ON w.node_id = h.src WHERE d < 6) SELECT path FROM w WHERE node_id = 'supplier_1' ORDER BY d, path LIMIT 1"),
    "graph_components": (graph_components, f"WITH RECURSIVE {_GEO}, b AS (SELECT src AS a, dst AS b FROM edges WHERE edge_type <> 'references' UNION SELECT dst, src FROM edges WHERE edge_type <> 'references'), w(node_id, x) AS (SELECT node_id, node_id FROM nodes UNION SELECT w.node_id, b.b FROM w JOIN b ON w.x = b.a) SELECT node_id, min(x) AS component FROM w WHERE x IN (SELECT node_id FROM nodes) GROUP BY 1"),
    "graph_stats": (graph_stats, f"WITH RECURSIVE {_GEO}, b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), w(node_id, x) AS (SELECT node_id, node_id FROM every_node UNION SELECT w.node_id, b.b FROM w JOIN b ON w.x = b.a), c AS (SELECT node_id, min(x) AS r FROM w GROUP BY 1) SELECT (SELECT count(*) FROM every_node) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, (SELECT count(DISTINCT r) FROM c) AS components, round((SELECT count(*) FROM edges) / CAST((SELECT count(*) * (count(*) - 1) FROM every_node) AS DOUBLE), 9) AS density"),
    "graph_centrality": (graph_centrality, f"WITH {_GEO}, d AS (SELECT x AS node_id, count(*) AS n FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) SELECT nodes.node_id, round(coalesce(n, 0) / CAST((SELECT count(*) - 1 FROM nodes) AS DOUBLE), 9) AS centrality FROM nodes LEFT JOIN d ON nodes.node_id = d.node_id ORDER BY coalesce(n, 0) DESC, nodes.node_id LIMIT 5"),
    "graph_search": (graph_search, f"WITH {_GEO} SELECT node_id, node_type, label FROM nodes WHERE contains(lower(label), 'ion') OR contains(lower(node_type), 'ion')"),
    "graph_context": (graph_context, f"WITH {_GEO} SELECT node_id, coalesce((SELECT string_agg(DISTINCT src, ',' ORDER BY src) FROM edges WHERE dst = node_id), '') AS predecessors, coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM edges WHERE src = node_id), '') AS successors FROM nodes"),
    "graph_subgraph": (graph_subgraph, f"WITH {_GEO} SELECT edge_seq, src, dst FROM edges WHERE NOT starts_with(src, 'supplier') AND NOT starts_with(dst, 'supplier')"),
    "graph_export": (graph_export, f"""WITH {_GEO} SELECT lpad(CAST(edge_seq AS VARCHAR), 20, '0') AS ord, concat('{{"source":"', src, '","target":"', dst, '","edge_type":"', edge_type, '"}}') AS text FROM edges"""),
    "page_links": (page_links, "WITH l AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS dst FROM pages) SELECT src, dst, count(*) AS n FROM l GROUP BY 1, 2"),
    "document_graph": (
        document_graph,
        f"""WITH {_FORMED}, {CELLS_SQL}, {CONCEPTS_SQL},
 m AS (SELECT DISTINCT a.doc_id, a.number, b.number AS target FROM sections_ a JOIN sections_ b ON a.doc_id = b.doc_id AND a.number <> b.number AND (contains(lower(a.content), 'section ' || b.number) OR contains(lower(a.content), 'clause ' || b.number) OR contains(lower(a.content), 'see ' || b.number) OR contains(lower(a.content), 'refer ' || b.number))),
 k AS (SELECT doc_id // 1000000 AS d, variable, count(*) AS n FROM v GROUP BY ALL)
 SELECT 'contains' AS edge_type, (SELECT count(*) FROM sections_) + (SELECT count(*) FROM f) + 2 + (SELECT count(DISTINCT doc_id) FROM sections_ WHERE (doc_id = 0 AND page_number = 1) OR (doc_id = 1 AND page_number = 2)) AS n
 UNION ALL SELECT 'uses_variable', count(*) FROM v UNION ALL SELECT 'shares_variable', CAST(sum(n * (n - 1)) AS BIGINT) FROM k UNION ALL SELECT 'references', count(*) FROM m UNION ALL SELECT 'related_to', count(*) FROM concepts_ WHERE table_id <> 'nation_s'""",
    ),
    "document_nodes": (
        document_nodes,
        f"""WITH {_FORMED}, {CELLS_SQL}, {CONCEPTS_SQL}, x AS (SELECT DISTINCT concept FROM concepts_ WHERE table_id <> 'nation_s')
 SELECT 'document' AS node_type, count(*) AS n, count(*) AS ids FROM (SELECT DISTINCT doc_id FROM pages_) UNION ALL SELECT 'section', count(*), count(*) FROM known UNION ALL SELECT 'formula', count(*), count(*) FROM f
 UNION ALL SELECT 'variable', count(DISTINCT variable), count(DISTINCT variable) FROM v UNION ALL SELECT 'table', 2, 2 UNION ALL SELECT 'concept', count(*), count(*) FROM (SELECT DISTINCT replace(lower(concept), ' ', '_') FROM x)""",
    ),
    "document_registry": (
        document_registry,
        f"""WITH {_FORMED}, raw AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no) AS t, max(page_no) AS total_pages FROM pages_ GROUP BY 1),
 up AS (SELECT a.doc_id, a.seq, max(b.seq) AS parent FROM sections_ a LEFT JOIN sections_ b ON a.doc_id = b.doc_id AND b.seq < a.seq AND b.level < a.level GROUP BY 1, 2)
 SELECT raw.doc_id, coalesce(list_filter(list_transform(list_slice(string_split(trim(t), chr(10)), 1, 10), lambda x: trim(x)), lambda s: length(s) > 10 AND NOT regexp_matches(s, '^[0-9]'))[1], 'Untitled Document') AS title, total_pages,
  (SELECT count(*) FROM up WHERE up.doc_id = raw.doc_id AND parent IS NULL) AS n_sections, (SELECT count(*) FROM f WHERE f.doc_id // 1000000 = raw.doc_id) AS n_formulas, CAST(CASE WHEN raw.doc_id IN (0, 1) THEN 1 ELSE 0 END AS BIGINT) AS n_tables FROM raw""",
    ),
    "ingest_chunks": (ingest_chunks, f"WITH {_FORMED} SELECT 'section' AS type, count(*) AS n, count(DISTINCT doc_id || '_' || number) AS ids FROM sections_ WHERE trim(content) <> '' UNION ALL SELECT 'formula', count(*), count(*) FROM f UNION ALL SELECT 'table', 2, 2"),
    "graph_upsert": (graph_upsert, "SELECT CAST(n_regionkey AS VARCHAR) AS node_id, max_by(n_name, n_nationkey) AS label, CASE WHEN n_regionkey = 0 THEN '#4ECDC4' END AS colour FROM nation GROUP BY n_regionkey"),
}
