import os

import pytest
from pyspark.sql import functions as F

from normweave.operators import chunks, formulas, graph, rules, sections, tables, vectors
from normweave.functions.text import quantity, title, value_and_unit
from normweave.plans import intent
from normweave.sources import readers
from normweave.sources.catalog import Catalog


def pages(spark, *texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id long, page_no int, text string")


def test_text_before_the_first_header_belongs_to_it(spark):
    got = sections.sections(pages(spark, "intro\n1 One\nbody\n1.1 Two\n1.2 Three\nmore\n2 Four", "no header here", "", "A.1 Annex\nx")).orderBy("seq").collect()
    assert [(r.number, r.title, r.content, r.level, r.parent_seq) for r in got] == [("1", "One", "intro\nbody", 1, None), ("1.1", "Two", "", 2, 1), ("1.2", "Three", "more", 2, 1), ("2", "Four", "", 1, None), ("A.1", "Annex", "x", 2, 4)]


def test_duplicate_numbers_last_wins(spark):
    found = sections.sections(pages(spark, "1 One\n1 Other\n1.1 Sub"))
    assert {(r.number, r.title) for r in sections.lookup(found).collect()} == {("1", "Other"), ("1.1", "Sub")}
    assert [r.path for r in sections.full_paths(sections.hierarchy(found)).where("number = '1.1'").collect()] == ["1 Other > 1.1 Sub"]


def test_formulas(spark):
    docs = spark.createDataFrame([(1, "Q = n × q and 6 × 300 = 1800"), (2, "V ≤ 0.5 m/s"), (3, ""), (4, None)], "doc_id long, text string")
    got = formulas.formulas(docs).orderBy("doc_id", "formula_no").collect()
    assert (got[0].raw_text, got[0].formula_type, got[0].variables[:3]) == ("Q = n × q and 6 × 300 = 1800", "calculation", ["Q", "n", "q"])
    assert {r.formula_type for r in got if r.doc_id == 2} == {"inequality", "reference"}
    assert formulas.parsed_calculations(formulas.formulas(docs)).where("result = 1800").count() >= 1


def test_definitions(spark):
    docs = spark.createDataFrame([(1, "where q is the flow (m/s)\nlet n be cars\nq: other\nB = width (mm)")], "doc_id long, text string")
    got = {r.symbol: (r.name, r.unit) for r in formulas.variable_definitions(docs).collect()}
    assert got["q"] == ("flow", "m/s") and got["n"] == ("cars", None)


@pytest.mark.parametrize(
    "text, kind",
    [("If flow > 5, then use fan", "conditional"), ("Doors must be closed", "requirement"), ("Minimum width is 3 m", "constraint"), ("Q = n * q", "calculation"), ("Verify that flow is set", "validation"), ("See Section 3", "reference")],
)
def test_rule_types(spark, text, kind):
    got = rules.extract_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert kind in {r.rule_type for r in got}


def test_rule_evaluation(spark):
    some = rules.extract_rules(spark.createDataFrame([(1, "If flow > 5, then use fan")], "doc_id long, text string")).where("rule_type = 'conditional'")
    facts = spark.createDataFrame([(1, {"flow": "6"}), (2, {"flow": "5"}), (3, {"other": "9"}), (4, {"flow": "many"})], "fact_id long, vars map<string,string>")
    assert [r.fact_id for r in rules.evaluate_rules(some, facts).collect()] == [1]
    assert rules.statistics(some).first()["n_conditional"] == 1


def test_minimum_is_at_least(spark):
    got = rules.extract_rules(spark.createDataFrame([(1, "Minimum width is 3 m")], "doc_id long, text string")).where("rule_type = 'constraint'").first()
    assert (got.conditions[0].op, got.conditions[0].num, got.conditions[0].unit) == (">=", 3.0, "m")


@pytest.mark.parametrize("n", [0, 1, 500, 501, 1000, 1001, 2500])
def test_chunks_cover_the_text(n):
    text = ("word. " * (n // 6 + 1))[:n]
    got = list(chunks.windows(text, 1000, 200))
    assert all(b[0] < a[1] for a, b in zip(got, got[1:])) and (not n or got[-1][1] >= n)


def test_chunks_of_null(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "   "), (4, "x")], "doc_id long, text string")
    assert [r.doc_id for r in chunks.create_chunks(docs).collect()] == [4]
    with pytest.raises(ValueError):
        chunks.create_chunks(docs, 100, 50)


def test_tables(spark):
    rows = [("a", "lattice", 0, 0, "Key"), ("a", "lattice", 0, 1, "Val"), ("a", "lattice", 1, 0, "one"), ("a", "lattice", 1, 1, "1"), ("a", "lattice", 2, 0, ""), ("a", "lattice", 2, 1, "2"), ("a", "lattice", 3, 0, None), ("a", "lattice", 3, 1, None), ("a", "lattice", 4, 0, "two"), ("a", "lattice", 4, 1, "4")]
    cells = spark.createDataFrame(rows, "table_id string, flavor string, r int, c int, text string")
    told, filled = tables.process(cells)
    assert [(r.table_type, r.headers) for r in told.collect()] == [("lookup", ["Key", "Val"])]
    assert [r.text for r in filled.where("c = 0").orderBy("r").collect()] == ["one", "one", "two"]
    assert tables.lookup_value(tables.clean_cells(cells), "TWO").first()["value"] == "4"


def test_graph(spark):
    edges = spark.createDataFrame([(1, "a", "b", "x"), (2, "a", "b", "x"), (3, "b", "c", "x"), (4, "c", "a", "y"), (5, "d", "e", "x"), (6, "c", "b", "x")], "edge_seq long, src string, dst string, edge_type string")
    nodes = graph.full_nodes(spark.createDataFrame([("a", "t", "A", None)], "node_id string, node_type string, label string, properties map<string,string>"), edges)
    assert nodes.count() == 5
    assert {(r.node_id, r.distance) for r in graph.reachable(edges, nodes.where("node_id = 'a'").select("node_id"), 3).collect()} == {("b", 1), ("c", 2)}
    assert graph.shortest_path(edges, "a", "c").first()["path"] == ["a", "b", "c"]
    assert graph.shortest_path(edges, "a", "e").count() == 0
    assert {r.component for r in graph.components(nodes, edges).collect()} == {"a", "d"}
    assert [r.related for r in graph.related(edges, nodes.where("node_id = 'b'").select("node_id")).orderBy("rn").collect()] == ["c", "a"]
    assert [r.related for r in graph.related(edges, nodes.where("node_id = 'a'").select("node_id")).orderBy("rn").collect()] == ["b", "b", "c"]
    with pytest.raises(ValueError):
        graph.export(nodes, edges, "svg")
    assert graph.export(nodes, edges, "graphml").count() == 11


def test_search_ignores_zero_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id long, embedding array<float>")
    got = vectors.search(v, [1.0, 0.0], 2).collect()
    assert [r.id for r in got] == [1, 3]


def test_scalar_text(spark):
    df = spark.createDataFrame([("3.5 m³/h here",), ("none",), ("\n 1 x\nA longer title line\n",)], "t string")
    got = df.select(quantity(F.col("t")).alias("q"), value_and_unit(F.col("t")).alias("v"), title(F.col("t")).alias("title")).collect()
    assert (got[0].q.value, got[0].q.unit) == (3.5, "m³/h") and got[1].q is None and got[1].v.str == "none"
    assert got[2].title == "A longer title line" and got[1].title == "Untitled Document"


def test_intent(spark):
    df = spark.createDataFrame([('{"query_type":"calculation","required_sections":["1"]}',), ("{",), (None,)], "j string")
    got = [r.i for r in df.select(intent.parse_intent(F.col("j")).alias("i")).collect()]
    assert [x.query_type for x in got] == ["calculation", "lookup", "lookup"] and got[0].required_sections == ["1"] and got[1].entities == {}


def test_catalog(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/store")
    assert store.statistics("chunks")["count"] == 0
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, content string")
    assert store.add("chunks", rows) == 2
    assert [r.content for r in store.by_ids("chunks", ["b", "z"]).collect()] == ["y"]
    store.clear()
    assert store.statistics("chunks")["count"] == 0


def test_readers_fall_through(spark, tmp_path):
    for name, body in (("a.txt", b"one\ftwo"), ("b.txt", b"bad")):
        (tmp_path / name).write_bytes(body)

    def first(content):
        raise ValueError

    def second(content):
        return content.decode().split("\f") if content != b"bad" else [" "]

    got = readers.decoded(readers.files(spark, str(tmp_path), "*.txt"), first, second)
    assert [(os.path.basename(r.path), r.page_no, r.text) for r in got.orderBy("page_no").collect()] == [("a.txt", 1, "one"), ("a.txt", 2, "two")]


def test_streams(spark, tmp_path):
    from normweave.streaming import ingest as s

    spark.createDataFrame([(1, "same", None), (2, "same", None), (3, "other", None)], "doc_id long, text string, ts timestamp").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    q = s.once(s.document_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("got").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("got").count() == 2


def test_ingestion_reads_its_pages_once(spark, tmp_path):
    from normweave.plans.ingest import ingest

    pages(spark, "1 One\nq = n × 2\nt = q × 2\nsee 1.1\n1.1 Two\nq = 6 × n").write.parquet(f"{tmp_path}/pages")
    cells = spark.createDataFrame([(1, 1, "t", "lattice", r, c, f"word {r} {c}") for r in range(3) for c in range(2)], "doc_id long, page_number int, table_id string, flavor string, r int, c int, text string")
    got = ingest(spark.read.parquet(f"{tmp_path}/pages"), cells)
    # the graph is made of tables already written: its plan holds neither the pages nor a copy of their derivation for each branch
    assert not [f for f in got.edges.inputFiles() if f"{tmp_path}/pages" in f]
    assert got.edges._jdf.queryExecution().executedPlan().toString().count("Exchange") < 60
    assert {(r.src, r.dst) for r in got.edges.where("edge_type = 'references'").collect()} == {("section_1_1", "section_1_1.1")}
    assert got.formulas.count() == got.nodes.where("node_type = 'formula'").count() > 2
