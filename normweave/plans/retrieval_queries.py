"""Queries on vectors, chunks and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import title
from ..operators import chunks, vectors
from . import intent


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")


def _query(spark, sf_dir) -> list[float]:
    """The vector of id 0 is the question's."""
    return list(_vectors(spark, sf_dir).where("id = 0").first()["embedding"])


def _top(df):
    return df.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def vector_topk(spark, sf_dir):
    return _top(vectors.search(_vectors(spark, sf_dir), _query(spark, sf_dir), 10))


def vector_topk_filtered(spark, sf_dir):
    return _top(vectors.search(_vectors(spark, sf_dir), _query(spark, sf_dir), 8, F.col("label") == 3))


def vector_search_many(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    asked = v.where("id < 5").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.search_many(v, asked, 5).select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def _vector_graph(spark, sf_dir):
    """A graph over the vectors: four types of nodes, followed and other edges, parallel edges, and hubs with many in-edges."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("i"))
    name = lambda c: F.concat(F.lit("n_"), c.cast("string"))
    kind = F.element_at(F.array(*map(F.lit, ["section", "formula", "table", "document"])), (F.col("i") % 4 + 1).cast("int"))
    text = F.col("i").cast("string")
    properties = F.create_map(F.lit("section_number"), F.concat(F.lit("3."), text), F.lit("page_number"), F.when(F.col("i") % 3 > 0, text), F.lit("content_preview"), F.concat(F.lit("about "), text), F.lit("variables"), F.concat(F.lit("Q, v"), text), F.lit("formula_type"), F.lit("equation"))
    nodes = v.select(name(F.col("i")).alias("node_id"), kind.alias("node_type"), F.concat(F.lit("Item "), text).alias("label"), properties.alias("properties"))
    one = lambda part, to, kind, where: v.where(where).select((F.col("i") * 4 + part).alias("edge_seq"), name(F.col("i")).alias("src"), name(F.expr(to)).alias("dst"), F.lit(kind).alias("edge_type"))
    edges = one(0, "i + 1", "contains", "true").unionByName(one(1, "i + 1", "shares_variable", "i % 2 = 0")).unionByName(one(2, "i - i % 10", "references", "i % 10 > 6")).unionByName(one(3, "i + 5", "uses_variable", "true"))
    return nodes, edges


def _expanded(spark, sf_dir):
    hits = vectors.search(_vectors(spark, sf_dir), _query(spark, sf_dir), 8)
    hits = hits.select(F.row_number().over(F_window()).alias("rank"), F.concat(F.lit("n_"), F.col("id").cast("string")).alias("id"), "score", F.concat(F.lit("Label "), F.col("label").cast("string")).alias("section_title"))
    return hits, vectors.expand(hits, *_vector_graph(spark, sf_dir))


def hybrid_retrieval(spark, sf_dir):
    """Top 8, then up to three neighbours of each hit in the graph, those of a wanted section first, 15 rows in all."""
    out = vectors.context(*_expanded(spark, sf_dir), ["item 1"])
    return out.select("first", "part", F.col("rank").cast("int").alias("rank"), F.col("rn").cast("int").alias("rn"), "id", F.round("score", 6).alias("score"))


def graph_expansion(spark, sf_dir):
    """What the graph adds to the hits, as context items."""
    out = _expanded(spark, sf_dir)[1]
    return out.select(F.col("rank").cast("int").alias("rank"), F.col("rn").cast("int").alias("rn"), "id", "type", "score", "content", "section_number", "section_title", "page_number", "item_id", "formula_type", "variables", "reason")


def search_with_context(spark, sf_dir):
    """The first chunk of each of five documents as hits, with the chunks beside them."""
    cut = chunks.create_chunks(_docs(spark, sf_dir))
    hits = cut.where("doc_id < 50 AND chunk_index = 1").select("doc_id", "chunk_index")
    return chunks.with_context(hits, cut).select("doc_id", "chunk_index", F.md5("content").alias("md5"))


def F_window():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("score"), "id")


_COS = "round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"
_SCORED = f"q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, {_COS.format(a='embedding', b='q')} AS score, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS exact FROM embeddings, q)"


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def chunk_documents(spark, sf_dir):
    out = chunks.create_chunks(_docs(spark, sf_dir))
    return out.select("doc_id", "chunk_index", "chunk_start", "chunk_end", F.md5("content").alias("content_md5"))


def chunk_stats(spark, sf_dir):
    return chunks.create_chunks(_docs(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("chunk_end").alias("last_end"))


def chunk_neighbours(spark, sf_dir):
    out = chunks.neighbours(chunks.create_chunks(_docs(spark, sf_dir)))
    return out.groupBy("doc_id").agg(F.count("*").alias("n_pairs"), F.sum("near").cast("long").alias("sum_near"))


_CHUNKS = r"""ends AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL),
walk(doc_id, st, en, n) AS (
  SELECT doc_id, CAST(0 AS BIGINT), CASE WHEN 1000 < n THEN {e0} ELSE 1000 END, n FROM ends WHERE n > 0
  UNION ALL
  SELECT w.doc_id, CASE WHEN w.en < w.n THEN w.en - 200 ELSE w.en END,
         CASE WHEN w.en - 200 + 1000 < w.n THEN {e1} ELSE w.en - 200 + 1000 END, w.n
  FROM walk w JOIN ends d ON w.doc_id = d.doc_id WHERE w.en < w.n),
cut AS (SELECT w.doc_id, w.st, w.en, regexp_replace(substr(d.text, w.st + 1, w.en - w.st), '^\s+|\s+$', '', 'g') AS content FROM walk w JOIN ends d USING (doc_id)),
chunks_ AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS INTEGER) AS chunk_index FROM cut WHERE content <> '')"""


def _end(start: str, text: str) -> str:
    """SQL for the end of a window that does not reach the text's end."""
    win = f"substr({text}, CAST(({start}) + 1 AS BIGINT), 1000)"
    out = f"({start}) + 1000"
    for sep in ("'? '", "'! '", "'. '", "chr(10)", "chr(10) || chr(10)"):
        last = f"(length({win}) - strpos(reverse({win}), reverse({sep})) - length({sep}) + 1)"
        out = f"CASE WHEN strpos(reverse({win}), reverse({sep})) > 0 AND {last} > 500 THEN ({start}) + {last} + length({sep}) ELSE {out} END"
    return out


_CHUNKS = _CHUNKS.replace("{e0}", _end("0", "text")).replace("{e1}", _end("w.en - 200", "d.text"))


def title_inference(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", title(F.coalesce("text", F.lit(""))).alias("title"))


def _questions(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


def plan_steps(spark, sf_dir):
    q = _questions(spark, sf_dir).withColumn("kind", F.element_at(F.array(*map(F.lit, intent.QUERY_TYPES)), (F.col("turn") % 6 + 1).cast("int")))
    wanted = F.when(F.col("turn") % 2 == 1, F.array(F.lit("3.1"), F.lit("3.2"))).otherwise(F.array().cast("array<string>"))
    steps = intent.plan_steps(F.col("kind"), wanted, F.lower("text"), F.array(F.lit("6*300")))
    return q.select("conv_id", "turn", F.array_join(steps, "; ").alias("steps"))


def confidence(spark, sf_dir):
    q = _questions(spark, sf_dir).withColumn("kind", F.element_at(F.array(*map(F.lit, intent.QUERY_TYPES)), (F.col("turn") % 6 + 1).cast("int")))
    return q.select("conv_id", "turn", F.round(intent.confidence(F.col("kind"), F.col("turn") % 5, F.col("conv_id") % 2), 6).alias("confidence"))


def keyword_intent(spark, sf_dir):
    return _questions(spark, sf_dir).groupBy(intent.keyword_type(F.col("text")).alias("query_type")).agg(F.count("*").alias("n"))


def parse_intent(spark, sf_dir):
    q = _questions(spark, sf_dir)
    json = F.when(F.col("turn") % 3 == 0, "not json").when(F.col("turn") % 3 == 1, F.format_string('{"query_type":"calculation","required_sections":["%d"]}', "conv_id")).otherwise('{"query_type":"nonsense"}')
    got = q.select("conv_id", "turn", intent.parse_intent(json).alias("i"))
    return got.select("conv_id", "turn", "i.query_type", F.array_join("i.required_sections", ",").alias("sections"))


def citations(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    answers = part.select(F.col("p_partkey").alias("answer_id"), F.concat(F.lit("As Section "), (F.col("p_size") % 7).cast("string"), F.lit(" and Section "), (F.col("p_size") % 5).cast("string"), F.lit(".2 say.")).alias("answer"))
    context = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") % 6).cast("string").alias("section_number"), F.col("n_name").alias("section_title"), F.col("n_nationkey").alias("rank"))
    return intent.citations(answers, context)


def answer_markdown(spark, sf_dir):
    q = _questions(spark, sf_dir)
    sums = F.array(F.struct(F.lit("6*300").alias("expression"), F.lit("1800").alias("result"), F.when(F.col("turn") % 4 == 0, "m").alias("units")))
    sources = F.array(F.struct(F.lit("3.1").alias("section"), F.lit("Scope").alias("title"), F.when(F.col("conv_id") % 2 == 0, F.col("conv_id")).alias("page")))
    some = lambda items, when: F.when(when, items).otherwise(F.slice(items, 1, 0))
    steps = some(F.array(F.lit("Search"), F.lit("Check")), F.col("turn") % 3 == 0)
    text = intent.markdown(F.concat(F.lit("Answer "), F.col("conv_id").cast("string")), some(sums, F.col("turn") % 2 == 0), some(sources, F.col("turn") % 5 > 0), steps, (F.col("turn") % 8) / 16)
    return q.select("conv_id", "turn", F.md5(text).alias("md5"))


#: Neighbours of the hits: out-edges first, repeats kept, then in-edges from nodes not listed; three for each hit, each node once.
_EXPANDED = """g AS (SELECT CAST(vec_id AS BIGINT) AS i FROM embeddings),
nodes AS (SELECT 'n_' || i AS node_id, (['section','formula','table','document'])[CAST(i % 4 + 1 AS INTEGER)] AS node_type, 'Item ' || i AS label, i FROM g),
edges AS (SELECT i * 4 AS seq, i AS a, i + 1 AS b FROM g UNION ALL SELECT i * 4 + 1, i, i + 1 FROM g WHERE i % 2 = 0 UNION ALL SELECT i * 4 + 2, i, i - i % 10 FROM g WHERE i % 10 > 6),
hits AS (SELECT CAST(row_number() OVER (ORDER BY exact DESC, vec_id) AS INTEGER) AS rank, CAST(vec_id AS BIGINT) AS i, 'n_' || vec_id AS id, exact AS score, 'Label ' || label AS section_title FROM s QUALIFY rank <= 8),
o AS (SELECT rank, b AS x, 0 AS side, seq, min(seq) OVER (PARTITION BY rank, b) AS first FROM hits JOIN edges ON a = i),
n AS (SELECT rank, a AS x, 1 AS side, min(seq) AS seq, min(seq) AS first FROM hits JOIN edges ON b = i GROUP BY 1, 2),
l AS (SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.rank = n.rank AND o.x = n.x)),
p AS (SELECT rank, x, CAST(row_number() OVER (PARTITION BY rank ORDER BY side, first, seq) AS INTEGER) AS rn FROM l QUALIFY rn <= 3),
items AS (SELECT rank, rn, node_id AS id, node_type AS type, CASE node_type WHEN 'section' THEN CAST(0.7 AS DOUBLE) WHEN 'formula' THEN 0.8 ELSE 0.6 END AS score,
 CASE node_type WHEN 'section' THEN 'about ' || i WHEN 'formula' THEN 'Formula: ' || label || chr(10) || 'Variables: Q, v' || i ELSE 'Table: ' || label || ' on page ' || CASE WHEN i % 3 > 0 THEN CAST(i AS VARCHAR) ELSE 'Unknown' END END AS content,
 CASE WHEN node_type = 'section' THEN '3.' || i END AS section_number, CASE WHEN node_type = 'section' THEN label END AS section_title, CASE WHEN node_type <> 'formula' AND i % 3 > 0 THEN CAST(i AS VARCHAR) END AS page_number,
 CASE WHEN node_type <> 'section' THEN CAST(i AS VARCHAR) END AS item_id, CASE WHEN node_type = 'formula' THEN 'equation' END AS formula_type, CASE WHEN node_type = 'formula' THEN 'Q, v' || i END AS variables, 'related_' || node_type AS reason
 FROM p JOIN nodes ON x = i WHERE node_type <> 'document' QUALIFY row_number() OVER (PARTITION BY i ORDER BY rank, rn) = 1)"""
_Q = "q AS (SELECT conv_id, turn, coalesce(text, '') AS text, (['lookup','calculation','comparison','explanation','validation','multi_step'])[CAST(turn % 6 + 1 AS INTEGER)] AS kind FROM conversations WHERE role = 'user')"
QUERIES = {
    "hybrid_retrieval": (
        hybrid_retrieval,
        f"WITH {_SCORED}, {_EXPANDED}, u AS (SELECT 0 AS part, rank, 0 AS rn, id, score, section_title FROM hits UNION ALL SELECT 1, rank, rn, id, score, section_title FROM items) "
        "SELECT coalesce(contains(lower(section_title), 'item 1'), false) AS first, part, rank, rn, id, round(score, 6) AS score FROM u ORDER BY first DESC, part, rank, rn LIMIT 15",
    ),
    "graph_expansion": (graph_expansion, f"WITH {_SCORED}, {_EXPANDED} SELECT rank, rn, id, type, score, content, section_number, section_title, page_number, item_id, formula_type, variables, reason FROM items"),
    "search_with_context": (search_with_context, f"WITH RECURSIVE {_CHUNKS}, h AS (SELECT doc_id, chunk_index FROM chunks_ WHERE doc_id < 50 AND chunk_index = 1) SELECT h.doc_id, h.chunk_index, md5(string_agg(c.content, chr(10) || chr(10) ORDER BY c.chunk_index)) AS md5 FROM h JOIN chunks_ c ON c.doc_id = h.doc_id AND abs(c.chunk_index - h.chunk_index) <= 1 GROUP BY 1, 2"),
    "vector_topk": (vector_topk, f"WITH {_SCORED} SELECT vec_id, score FROM s ORDER BY exact DESC, vec_id LIMIT 10"),
    "vector_topk_filtered": (vector_topk_filtered, f"WITH {_SCORED} SELECT vec_id, score FROM s WHERE label = 3 ORDER BY exact DESC, vec_id LIMIT 8"),
    "vector_search_many": (
        vector_search_many,
        f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) AS exact FROM embeddings a, embeddings b WHERE a.vec_id < 5) SELECT query_id, vec_id, round(exact, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5",
    ),
    "chunk_documents": (chunk_documents, f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_index, st AS chunk_start, CAST(en AS BIGINT) AS chunk_end, md5(content) AS content_md5 FROM chunks_"),
    "chunk_stats": (chunk_stats, f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, count(*) AS n_chunks, CAST(max(en) AS BIGINT) AS last_end FROM chunks_ GROUP BY doc_id"),
    "chunk_neighbours": (chunk_neighbours, f"WITH RECURSIVE {_CHUNKS} SELECT a.doc_id, count(*) AS n_pairs, CAST(sum(b.chunk_index) AS BIGINT) AS sum_near FROM chunks_ a JOIN chunks_ b ON a.doc_id = b.doc_id AND abs(a.chunk_index - b.chunk_index) = 1 GROUP BY a.doc_id"),
    "title_inference": (title_inference, r"SELECT doc_id, coalesce(list_filter(list_transform(list_slice(string_split(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), chr(10)), 1, 10), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 10 AND NOT regexp_matches(s, '^\d'))[1], 'Untitled Document') AS title FROM documents"),
    "plan_steps": (
        plan_steps,
        f"WITH {_Q} SELECT conv_id, turn, concat_ws('; ', CASE WHEN turn % 2 = 1 THEN 'Search for sections: 3.1, 3.2' END, CASE WHEN regexp_matches(lower(text), 'table|rate|value') THEN 'Search for relevant tables' END, CASE WHEN kind = 'calculation' THEN 'Extract calculation formulas; Perform calculation: 6*300' END, CASE WHEN kind = 'validation' THEN 'Retrieve validation criteria; Check against requirements' END, CASE WHEN kind = 'comparison' THEN 'Retrieve items to compare; Extract comparison criteria' END) AS steps FROM q",
    ),
    "confidence": (confidence, f"WITH {_Q} SELECT conv_id, turn, round(CAST(greatest(0, least(1, 0.5 + least(0.3, (turn % 5) * 0.1) + CASE WHEN kind = 'calculation' AND conv_id % 2 > 0 THEN 0.2 ELSE 0 END - CASE WHEN kind = 'multi_step' THEN 0.1 ELSE 0 END)) AS DOUBLE), 6) AS confidence FROM q"),
    "keyword_intent": (keyword_intent, f"WITH {_Q} SELECT CASE WHEN regexp_matches(lower(text), 'calculat|comput|how much|how many') THEN 'calculation' WHEN regexp_matches(lower(text), 'compar|differ|versus|better') THEN 'comparison' WHEN regexp_matches(lower(text), 'valid|verif|check|comply|allowed') THEN 'validation' WHEN regexp_matches(lower(text), 'explain|why|describe') THEN 'explanation' ELSE 'lookup' END AS query_type, count(*) AS n FROM q GROUP BY 1"),
    "parse_intent": (parse_intent, f"WITH {_Q} SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'calculation' ELSE 'lookup' END AS query_type, CASE WHEN turn % 3 = 1 THEN CAST(conv_id AS VARCHAR) ELSE '' END AS sections FROM q"),
    "citations": (
        citations,
        "WITH c AS (SELECT CAST(n_nationkey % 6 AS VARCHAR) AS section_number, min_by(n_name, n_nationkey) AS section_title FROM nation GROUP BY 1), a AS (SELECT p_partkey AS answer_id, 0 AS pos, CAST(p_size % 7 AS VARCHAR) AS section_number FROM part UNION ALL SELECT p_partkey, 1, concat(CAST(p_size % 5 AS VARCHAR), '.2') FROM part) SELECT answer_id, CAST(pos AS INTEGER) AS pos, section_number, section_title FROM a JOIN c USING (section_number)",
    ),
    "answer_markdown": (
        answer_markdown,
        f"WITH {_Q} SELECT conv_id, turn, md5(concat('## Answer', chr(10), chr(10), 'Answer ', CAST(conv_id AS VARCHAR), chr(10), chr(10), CASE WHEN turn % 2 = 0 THEN concat('### Calculations', chr(10), chr(10), '- `6*300 = 1800', CASE WHEN turn % 4 = 0 THEN ' m' ELSE '' END, '`', chr(10), chr(10)) ELSE '' END, "
        "CASE WHEN turn % 5 > 0 THEN concat('### Sources', chr(10), chr(10), '- Section 3.1: Scope', CASE WHEN conv_id % 2 = 0 AND conv_id <> 0 THEN concat(' (Page ', CAST(conv_id AS VARCHAR), ')') ELSE '' END, chr(10), chr(10)) ELSE '' END, "
        "CASE WHEN turn % 3 = 0 THEN concat('### Reasoning Steps', chr(10), chr(10), '1. Search', chr(10), '1. Check', chr(10), chr(10)) ELSE '' END, '*Confidence: ', (['0','6','12','19','25','31','38','44'])[CAST(turn % 8 + 1 AS INTEGER)], '%*', chr(10))) AS md5 FROM q",
    ),
}
