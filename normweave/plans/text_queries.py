"""Queries on structure, formulas and tables of the derived specification text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import FORMULA_SYMBOLS, FORMULAS, FUNCTION_NAMES, ID, NUM
from ..operators import formulas, sections, tables
from ..sources.readers import html_structure
from .spec import PAGES, SECTIONS, TEXTS, pages, texts


def _sections(spark, sf_dir):
    return sections.sections(pages(spark, sf_dir))


def section_extract(spark, sf_dir):
    return _sections(spark, sf_dir).select("doc_id", "seq", "number", "title", "page_number", F.md5("content").alias("content_md5"))


def section_levels(spark, sf_dir):
    return _sections(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"))


def section_parent(spark, sf_dir):
    return _sections(spark, sf_dir).select("doc_id", "seq", "parent_seq", "is_root")


def section_tree_order(spark, sf_dir):
    return sections.tree_order(_sections(spark, sf_dir)).select("doc_id", "seq", "number", "tree_pos")


def section_hierarchy(spark, sf_dir):
    return sections.hierarchy(_sections(spark, sf_dir)).select("doc_id", "number", "title", "level", "parent_number")


def section_paths(spark, sf_dir):
    return sections.full_paths(sections.hierarchy(_sections(spark, sf_dir)))


def section_siblings(spark, sf_dir):
    out = sections.node_context(sections.hierarchy(_sections(spark, sf_dir)))
    return out.select("doc_id", "number", F.array_join("siblings", ",").alias("siblings"), F.array_join("children", ",").alias("children"))


def xref_resolve(spark, sf_dir):
    return sections.cross_references(_sections(spark, sf_dir)).groupBy("doc_id", "source", "target").agg(F.count("*").alias("n"))


def text_references(spark, sf_dir):
    return sections.mentions(_sections(spark, sf_dir))


def raw_text(spark, sf_dir):
    return sections.raw_text(pages(spark, sf_dir)).select("doc_id", F.md5("raw_text").alias("md5"), "total_pages")


def _formulas(spark, sf_dir):
    return formulas.formulas(texts(spark, sf_dir))


def formula_extract(spark, sf_dir):
    return _formulas(spark, sf_dir).select("doc_id", "formula_no", "line_no", "raw_text", "normalized_text", "formula_type")


def formula_types(spark, sf_dir):
    return _formulas(spark, sf_dir).groupBy("formula_type").agg(F.count("*").alias("n"))


def formula_variables(spark, sf_dir):
    return _formulas(spark, sf_dir).select("doc_id", "formula_no", F.array_join("variables", ",").alias("variables"))


def formula_dependencies(spark, sf_dir):
    return formulas.dependencies(_formulas(spark, sf_dir)).select("doc_id", "formula_no", F.array_join(F.transform("depends_on", lambda x: x.cast("string")), ",").alias("depends_on"))


def shared_variables(spark, sf_dir):
    return formulas.shared_variables(_formulas(spark, sf_dir))


def variable_definitions(spark, sf_dir):
    return formulas.variable_definitions(texts(spark, sf_dir)).select("doc_id", "symbol", "name", "unit")


def formula_calc_parse(spark, sf_dir):
    return formulas.parsed_calculations(_formulas(spark, sf_dir)).select("doc_id", "formula_no", "left", "op", "right", "result")


def line_context(spark, sf_dir):
    return _formulas(spark, sf_dir).select("doc_id", "formula_no", F.md5("context").alias("context_md5"))


# --- tables: region and nation as cells -------------------------------------------------------------------------------


def cells(spark, sf_dir):
    """Nations (four columns, with some empty cells) in two flavors, and regions (two columns)."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    cell = lambda c, x: F.struct(F.lit(c).alias("c"), x.alias("text"))
    body = nation.select((F.col("n_nationkey") + 1).alias("r"), F.explode(F.array(cell(0, F.col("n_nationkey").cast("string")), cell(1, F.col("n_name")), cell(2, F.when(F.col("n_nationkey") % 3 > 0, "").otherwise(F.concat(F.lit("group "), F.col("n_nationkey").cast("string")))), cell(3, F.when(F.col("n_nationkey") % 3 == 1, "").otherwise(F.concat(F.lit("class "), F.col("n_nationkey").cast("string")))))).alias("x"))
    head = spark.createDataFrame([(0, 0, "Key"), (0, 1, "Name"), (0, 2, "Group"), (0, 3, "Class")], "r int, c int, text string")
    one = head.unionByName(body.select("r", "x.c", "x.text"))
    both = one.select(F.lit("nation_l").alias("table_id"), F.lit("lattice").alias("flavor"), "r", "c", "text").unionByName(one.select(F.lit("nation_s").alias("table_id"), F.lit("stream").alias("flavor"), "r", "c", "text"))
    reg = region.select(F.lit("region").alias("table_id"), F.lit("lattice").alias("flavor"), F.col("r_regionkey").alias("r"), F.explode(F.array(cell(0, F.col("r_name")), cell(1, F.col("r_regionkey").cast("string")))).alias("x")).select("table_id", "flavor", "r", "x.c", "x.text")
    return both.unionByName(reg)


_CELLS = """one AS (SELECT * FROM (VALUES (0, 0, 'Key'), (0, 1, 'Name'), (0, 2, 'Group'), (0, 3, 'Class')) AS t(r, c, text)
 UNION ALL SELECT n_nationkey + 1, 0, CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT n_nationkey + 1, 1, n_name FROM nation
 UNION ALL SELECT n_nationkey + 1, 2, CASE WHEN n_nationkey % 3 > 0 THEN '' ELSE 'group ' || CAST(n_nationkey AS VARCHAR) END FROM nation
 UNION ALL SELECT n_nationkey + 1, 3, CASE WHEN n_nationkey % 3 = 1 THEN '' ELSE 'class ' || CAST(n_nationkey AS VARCHAR) END FROM nation),
cells AS (SELECT 'nation_l' AS table_id, 'lattice' AS flavor, * FROM one UNION ALL SELECT 'nation_s', 'stream', * FROM one
 UNION ALL SELECT 'region', 'lattice', r_regionkey, 0, r_name FROM region UNION ALL SELECT 'region', 'lattice', r_regionkey, 1, CAST(r_regionkey AS VARCHAR) FROM region),
num AS (SELECT table_id, bool_or(regexp_full_match(replace(replace(text, '.', ''), ',', ''), '[0-9]+')) AS numeric FROM cells WHERE r = 0 GROUP BY 1),
body AS (SELECT table_id, flavor, CASE WHEN numeric THEN r ELSE r - 1 END AS r, c, text FROM cells JOIN num USING (table_id) WHERE numeric OR r > 0)"""


def table_headers(spark, sf_dir):
    return tables.headers(tables.clean_cells(cells(spark, sf_dir))).select("table_id", F.array_join("headers", ",").alias("headers"), "has_header")


def table_types(spark, sf_dir):
    return tables.table_types(tables.body(cells(spark, sf_dir)))


def table_ffill(spark, sf_dir):
    return tables.fill_merged(tables.body(cells(spark, sf_dir))).select("table_id", F.col("r").cast("int").alias("r"), "c", "text")


def table_dedupe(spark, sf_dir):
    return tables.distinct_tables(cells(spark, sf_dir)).groupBy("table_id").agg(F.count("*").alias("n_cells"))


def table_lookup(spark, sf_dir):
    return tables.lookup_value(cells(spark, sf_dir), "^a")


def table_search(spark, sf_dir):
    return tables.search(cells(spark, sf_dir), "GROUP")


def table_process(spark, sf_dir):
    out, _ = tables.process(cells(spark, sf_dir))
    return out.select("table_id", "table_type", F.col("n_rows").cast("int").alias("n_rows"), F.col("n_cols").cast("int").alias("n_cols"))


def table_markdown(spark, sf_dir):
    found, below = tables.process(cells(spark, sf_dir))
    titled = found.withColumn("title", F.when(F.col("table_id") == "nation_l", "Nations")).withColumn("caption", F.when(F.col("table_id") != "region", F.concat(F.lit("As of "), "table_id")))
    return tables.markdown(titled, below).select("table_id", F.md5("markdown").alias("md5"))


def table_concepts(spark, sf_dir):
    return tables.concepts(cells(spark, sf_dir)).select("table_id", F.col("rn").cast("int").alias("rn"), "concept")


def html_pages(spark, sf_dir):
    out = html_structure(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "heading", F.size("links").alias("n_links"))


_SQL_LINES = TEXTS + ", l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i - 1, 'line': x, 'all': string_split(text, chr(10))})) AS k FROM texts)"
_HITS = " UNION ALL ".join(f"SELECT doc_id, k.i AS line_no, k.all AS every, {k} AS pattern, unnest(list_transform(regexp_extract_all(k.line, '{p}'), lambda x, i: {{'pos': i, 'raw': x}})) AS m FROM l" for k, p in enumerate(FORMULAS))
_NORMAL = "trim(regexp_replace(raw_text, '\\s+', ' ', 'g'))"
for _a, _b in FORMULA_SYMBOLS:
    _NORMAL = f"replace({_NORMAL}, '{_a}', '{_b}')"
_F = f"""{_SQL_LINES}, hit AS ({_HITS}),
f0 AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pattern, m.pos) AS INTEGER) AS formula_no, CAST(line_no AS INTEGER) AS line_no, trim(m.raw) AS raw_text, every FROM hit),
f AS (SELECT *, {_NORMAL} AS normalized_text, CASE WHEN regexp_matches(raw_text, '[<>≤≥]') THEN 'inequality' WHEN contains(raw_text, '=') AND regexp_matches(raw_text, '\\d+\\s*[×*]\\s*\\d+') THEN 'calculation' WHEN contains(raw_text, '=') THEN 'equation' WHEN contains(lower(raw_text), 'is defined as') THEN 'definition' ELSE 'reference' END AS formula_type FROM f0),
v0 AS (SELECT doc_id, formula_no, unnest(list_transform(regexp_extract_all(normalized_text, '{ID}'), lambda x, i: {{'i': i, 'v': x}})) AS x FROM f),
v AS (SELECT doc_id, formula_no, x.v AS variable, min(x.i) AS i FROM v0 WHERE lower(x.v) NOT IN ({", ".join(f"'{n}'" for n in FUNCTION_NAMES)}) GROUP BY ALL)"""
_DEFS = r"""d AS (
 SELECT doc_id, 0 AS p, unnest(list_transform(list_zip(regexp_extract_all(text, '(?im)where\s+([A-Za-z_][\p{L}\p{N}_]*)\s+(?:is|=)\s+(?:the\s+)?([^,.\n]+)', 1), regexp_extract_all(text, '(?im)where\s+([A-Za-z_][\p{L}\p{N}_]*)\s+(?:is|=)\s+(?:the\s+)?([^,.\n]+)', 2)), lambda x, i: {'i': i, 's': x[1], 'd': x[2]})) AS m FROM texts
 UNION ALL SELECT doc_id, 2, unnest(list_transform(list_zip(regexp_extract_all(text, '(?im)let\s+([A-Za-z_][\p{L}\p{N}_]*)\s+be\s+(?:the\s+)?([^,.\n]+)', 1), regexp_extract_all(text, '(?im)let\s+([A-Za-z_][\p{L}\p{N}_]*)\s+be\s+(?:the\s+)?([^,.\n]+)', 2)), lambda x, i: {'i': i, 's': x[1], 'd': x[2]})) FROM texts),
r AS (SELECT doc_id, m.s AS symbol, trim(m.d) AS name, row_number() OVER (PARTITION BY doc_id, m.s ORDER BY p, m.i) AS rn FROM d)"""
FORMULA_SQL, CELLS_SQL = _F, _CELLS
CONCEPTS_SQL = """h AS (SELECT table_id, 0 AS part, c AS pos, CASE WHEN numeric THEN 'Column_' || CAST(c AS VARCHAR) ELSE text END AS label FROM cells JOIN num USING (table_id) WHERE r = 0),
 hu AS (SELECT * FROM h WHERE length(label) > 2 AND lower(label) NOT IN ('id', 'no', 'ref') UNION ALL SELECT table_id, 1, r, text FROM body WHERE c = 0 AND r < 10 AND length(text) > 3),
 hd AS (SELECT table_id, label, min((part * 1000 + pos)) AS place FROM hu GROUP BY ALL), concepts_ AS (SELECT table_id, label AS concept FROM hd QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY place, label) <= 5)"""


def formulas_by_variable(spark, sf_dir):
    return formulas.by_variable(_formulas(spark, sf_dir)).select("doc_id", "variable", F.array_join(F.transform("formulas", lambda x: x.cast("string")), ",").alias("formulas"))


def formula_operators(spark, sf_dir):
    return _formulas(spark, sf_dir).select("doc_id", "formula_no", F.array_join("operators", " ").alias("operators"))


def formula_definitions(spark, sf_dir):
    """The defined variables of each formula."""
    found = formulas.with_definitions(_formulas(spark, sf_dir), formulas.variable_definitions(texts(spark, sf_dir)))
    return found.select("doc_id", "formula_no", F.array_join(F.array_sort(F.transform(F.map_entries("var_defs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["name"]))), ";").alias("defined"))


def table_records(spark, sf_dir):
    found, below = tables.process(cells(spark, sf_dir))
    return tables.to_records(found, below).select("table_id", F.size("data").alias("n"), F.element_at("data", 2)["Name"].alias("name"))


def section_ancestors(spark, sf_dir):
    out = sections.node_context(sections.hierarchy(_sections(spark, sf_dir)))
    return out.select("doc_id", "number", F.array_join("ancestors", ",").alias("ancestors"))


def section_find(spark, sf_dir):
    return sections.find_node(sections.hierarchy(_sections(spark, sf_dir)), "1").select("doc_id", "title", "level")


QUERIES = {
    "section_extract": (section_extract, f"WITH {SECTIONS} SELECT doc_id, seq, number, title, page_number, md5(content) AS content_md5 FROM sections_"),
    "section_levels": (section_levels, f"WITH {SECTIONS} SELECT level, count(*) AS n FROM sections_ GROUP BY level"),
    "section_parent": (section_parent, f"WITH {SECTIONS} SELECT a.doc_id, a.seq, CAST(max(b.seq) AS INTEGER) AS parent_seq, max(b.seq) IS NULL AS is_root FROM sections_ a LEFT JOIN sections_ b ON a.doc_id = b.doc_id AND b.seq < a.seq AND b.level < a.level GROUP BY 1, 2"),
    "section_tree_order": (section_tree_order, f"WITH {SECTIONS} SELECT doc_id, seq, number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY list_transform(regexp_extract_all(number, '\\d+'), lambda x: CAST(x AS INTEGER)), seq) AS INTEGER) AS tree_pos FROM sections_"),
    "section_hierarchy": (section_hierarchy, f"WITH {SECTIONS} SELECT k.doc_id, k.number, k.title, k.level, p.number AS parent_number FROM known k LEFT JOIN known p ON k.doc_id = p.doc_id AND contains(k.number, '.') AND p.number = split_part(k.number, '.', 1)"),
    "section_paths": (section_paths, f"WITH {SECTIONS} SELECT k.doc_id, k.number, concat_ws(' > ', p.number || ' ' || p.title, k.number || ' ' || k.title) AS path FROM known k LEFT JOIN known p ON k.doc_id = p.doc_id AND contains(k.number, '.') AND p.number = split_part(k.number, '.', 1)"),
    "section_siblings": (
        section_siblings,
        f"WITH {SECTIONS}, t AS (SELECT k.doc_id, k.number, p.number AS up FROM known k LEFT JOIN known p ON k.doc_id = p.doc_id AND contains(k.number, '.') AND p.number = split_part(k.number, '.', 1)) SELECT t.doc_id, t.number, coalesce((SELECT string_agg(s.number, ',' ORDER BY s.number) FROM t s WHERE s.doc_id = t.doc_id AND s.up = t.up AND s.number <> t.number), '') AS siblings, coalesce((SELECT string_agg(s.number, ',' ORDER BY s.number) FROM t s WHERE s.doc_id = t.doc_id AND s.up = t.number), '') AS children FROM t",
    ),
    "xref_resolve": (xref_resolve, f"WITH {SECTIONS}, x AS (SELECT doc_id, number AS source, unnest(regexp_extract_all(content, '(?i)see\\s+section\\s+(\\d+(?:\\.\\d+)*)', 1)) AS target FROM sections_) SELECT x.doc_id, source, target, count(*) AS n FROM x JOIN known k ON x.doc_id = k.doc_id AND x.target = k.number GROUP BY ALL"),
    "text_references": (text_references, f"WITH {SECTIONS} SELECT DISTINCT a.doc_id, a.number AS source, b.number AS target FROM sections_ a JOIN sections_ b ON a.doc_id = b.doc_id AND a.number <> b.number AND (contains(lower(a.content), 'section ' || b.number) OR contains(lower(a.content), 'clause ' || b.number) OR contains(lower(a.content), 'see ' || b.number) OR contains(lower(a.content), 'refer ' || b.number))"),
    "raw_text": (raw_text, f"WITH {PAGES} SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY page_no)) AS md5, max(page_no) AS total_pages FROM pages_ GROUP BY doc_id"),
    "formula_extract": (formula_extract, f"WITH {_F} SELECT doc_id, formula_no, line_no, raw_text, normalized_text, formula_type FROM f"),
    "formula_types": (formula_types, f"WITH {_F} SELECT formula_type, count(*) AS n FROM f GROUP BY 1"),
    "formula_variables": (formula_variables, f"WITH {_F} SELECT f.doc_id, f.formula_no, coalesce(string_agg(variable, ',' ORDER BY i), '') AS variables FROM f LEFT JOIN v USING (doc_id, formula_no) GROUP BY ALL"),
    "formula_dependencies": (formula_dependencies, f"WITH {_F}, p AS (SELECT DISTINCT a.doc_id, a.formula_no, b.formula_no AS o FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.variable = b.variable AND a.formula_no <> b.formula_no) SELECT doc_id, formula_no, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS depends_on FROM p GROUP BY ALL"),
    "shared_variables": (shared_variables, f"WITH {_F} SELECT a.doc_id, a.formula_no AS a, b.formula_no AS b, a.variable FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.variable = b.variable AND a.formula_no < b.formula_no"),
    "variable_definitions": (variable_definitions, f"WITH {TEXTS}, {_DEFS} SELECT doc_id, symbol, CASE WHEN regexp_matches(name, '\\([^)]+\\)$') THEN trim(regexp_replace(name, '\\s*\\([^)]+\\)$', '')) ELSE name END AS name, CASE WHEN regexp_matches(name, '\\([^)]+\\)$') THEN regexp_extract(name, '\\(([^)]+)\\)$', 1) END AS unit FROM r WHERE rn = 1"),
    "formula_calc_parse": (formula_calc_parse, f"WITH {_F}, c AS (SELECT doc_id, formula_no, regexp_extract(normalized_text, '({NUM})\\s*([*/+-])\\s*({NUM})\\s*=\\s*({NUM})', ['a', 'o', 'b', 'r']) AS m FROM f WHERE formula_type = 'calculation' AND regexp_matches(normalized_text, '({NUM})\\s*([*/+-])\\s*({NUM})\\s*=\\s*({NUM})')) SELECT doc_id, formula_no, CAST(m.a AS DOUBLE) AS left, m.o AS op, CAST(m.b AS DOUBLE) AS right, CAST(m.r AS DOUBLE) AS result FROM c".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"')),
    "line_context": (line_context, f"WITH {_F} SELECT doc_id, formula_no, md5(array_to_string(list_slice(every, greatest(line_no - 1, 1), line_no + 3), chr(10))) AS context_md5 FROM f"),
    "table_headers": (table_headers, f"WITH {_CELLS} SELECT table_id, string_agg(CASE WHEN numeric THEN 'Column_' || CAST(c AS VARCHAR) ELSE text END, ',' ORDER BY c) AS headers, NOT bool_or(numeric) AS has_header FROM cells JOIN num USING (table_id) WHERE r = 0 GROUP BY table_id"),
    "table_types": (table_types, f"WITH {_CELLS} SELECT table_id, CASE WHEN count(DISTINCT c) = 2 THEN 'lookup' WHEN avg(CASE WHEN length(text) > 20 THEN 1 ELSE 0 END) > 0.5 THEN 'reference' ELSE 'data' END AS table_type FROM body GROUP BY 1"),
    "table_ffill": (table_ffill, f"WITH {_CELLS}, s AS (SELECT *, avg(CASE WHEN text = '' THEN 1 ELSE 0 END) OVER (PARTITION BY table_id, c) AS e FROM body) SELECT table_id, CAST(r AS INTEGER) AS r, c, CASE WHEN e > 0 AND e < 0.5 THEN coalesce(last_value(nullif(text, '') IGNORE NULLS) OVER (PARTITION BY table_id, c ORDER BY r), '') ELSE text END AS text FROM s"),
    "table_dedupe": (table_dedupe, f"WITH {_CELLS} SELECT table_id, count(*) AS n_cells FROM cells WHERE table_id <> 'nation_s' GROUP BY 1"),
    "table_lookup": (table_lookup, f"WITH {_CELLS}, k AS (SELECT table_id, r, max(text) FILTER (c = 0) AS k, max(text) FILTER (c = 1) AS v FROM cells GROUP BY ALL) SELECT table_id, min_by(v, r) AS value FROM k WHERE regexp_matches(k, '(?i)^a') GROUP BY 1"),
    "table_search": (table_search, f"WITH {_CELLS} SELECT DISTINCT table_id FROM cells WHERE contains(lower(text), 'group')"),
    "table_process": (table_process, f"WITH {_CELLS} SELECT table_id, CASE WHEN count(DISTINCT c) = 2 THEN 'lookup' ELSE 'data' END AS table_type, CAST(max(r) + 1 AS INTEGER) AS n_rows, CAST(max(c) + 1 AS INTEGER) AS n_cols FROM body GROUP BY 1 HAVING avg(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) >= 0.2"),
    "table_markdown": (
        table_markdown,
        f"""WITH {_CELLS}, st AS (SELECT *, avg(CASE WHEN text = '' THEN 1 ELSE 0 END) OVER (PARTITION BY table_id, c) AS e FROM body),
 fl AS (SELECT table_id, r, c, CASE WHEN e > 0 AND e < 0.5 THEN coalesce(last_value(nullif(text, '') IGNORE NULLS) OVER (PARTITION BY table_id, c ORDER BY r), '') ELSE text END AS text FROM st),
 al AS (SELECT table_id, -1 AS r, c, CASE WHEN numeric THEN 'Column_' || c ELSE text END AS text FROM cells JOIN num USING (table_id) WHERE r = 0 UNION ALL SELECT * FROM fl),
 w AS (SELECT table_id, c, max(length(text) + CASE WHEN r < 0 THEN 2 ELSE 0 END) AS w, bool_and(regexp_full_match(text, '[0-9]+')) FILTER (r >= 0) AS n FROM al GROUP BY ALL),
 p AS (SELECT table_id, c, CASE WHEN r < 0 THEN 0 ELSE r + 2 END AS line, ' ' || CASE WHEN n THEN repeat(' ', w - length(text)) || text ELSE text || repeat(' ', w - length(text)) END || ' ' AS x FROM al JOIN w USING (table_id, c)
  UNION ALL SELECT table_id, c, 1, CASE WHEN n THEN repeat('-', w + 1) || ':' ELSE ':' || repeat('-', w + 1) END FROM w),
 m AS (SELECT table_id, line, '|' || string_agg(x, '|' ORDER BY c) || '|' AS row FROM p GROUP BY ALL)
 SELECT table_id, md5(CASE WHEN table_id = 'nation_l' THEN '### Nations' || chr(10) || chr(10) ELSE '' END || CASE WHEN table_id <> 'region' THEN '*As of ' || table_id || '*' || chr(10) || chr(10) ELSE '' END || string_agg(row, chr(10) ORDER BY line)) AS md5 FROM m GROUP BY table_id""",
    ),
    "table_concepts": (
        table_concepts,
        f"WITH {_CELLS}, h AS (SELECT table_id, 0 AS part, c AS pos, CASE WHEN numeric THEN 'Column_' || CAST(c AS VARCHAR) ELSE text END AS label FROM cells JOIN num USING (table_id) WHERE r = 0), u AS (SELECT * FROM h WHERE length(label) > 2 AND lower(label) NOT IN ('id', 'no', 'ref') UNION ALL SELECT table_id, 1, r, text FROM body WHERE c = 0 AND r < 10 AND length(text) > 3), d AS (SELECT table_id, label, min((part * 1000 + pos)) AS place FROM u GROUP BY ALL) SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY place, label) AS INTEGER) AS rn, label AS concept FROM d QUALIFY rn <= 5",
    ),
    "html_pages": (html_pages, "SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS heading, CAST(length(regexp_extract_all(html, '(?i)href=[\"'']([^\"'']+)[\"'']', 1)) AS INTEGER) AS n_links FROM pages"),
    "formulas_by_variable": (formulas_by_variable, f"WITH {_F} SELECT doc_id, variable, string_agg(CAST(formula_no AS VARCHAR), ',' ORDER BY formula_no) AS formulas FROM v GROUP BY 1, 2"),
    "formula_operators": (formula_operators, f"WITH {_F} SELECT doc_id, formula_no, array_to_string(list_filter(['!=', '*', '+', '-', '/', '<', '<=', '=', '>', '>=', '^', '~='], lambda o: contains(normalized_text, o)), ' ') AS operators FROM f"),
    "formula_definitions": (formula_definitions, f"WITH {_F}, {_DEFS} SELECT v.doc_id, v.formula_no, string_agg(v.variable || '=' || CASE WHEN regexp_matches(name, '\\([^)]+\\)$') THEN trim(regexp_replace(name, '\\s*\\([^)]+\\)$', '')) ELSE name END, ';' ORDER BY v.variable) AS defined FROM v JOIN r ON r.doc_id = v.doc_id AND r.symbol = v.variable AND rn = 1 GROUP BY 1, 2"),
    "table_records": (table_records, f"WITH {_CELLS} SELECT table_id, CAST(max(r) + 1 AS INTEGER) AS n, max(text) FILTER (r = 1 AND c = 1 AND table_id <> 'region') AS name FROM body GROUP BY 1"),
    "section_ancestors": (section_ancestors, f"WITH {SECTIONS} SELECT k.doc_id, k.number, coalesce((SELECT string_agg(p.number, ',' ORDER BY length(p.number)) FROM known p WHERE p.doc_id = k.doc_id AND starts_with(k.number, p.number || '.')), '') AS ancestors FROM known k"),
    "section_find": (section_find, f"WITH {SECTIONS} SELECT doc_id, title, level FROM known WHERE number = '1'"),
}
