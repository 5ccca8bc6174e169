"""Registered queries of code extraction and of the index, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codequarry.functions import text as fx
from codequarry.operators import code, index
from codequarry.session import cut, spread, table

CUTOFF = "2025-10-01"


def _sources(spark, d):
    return spread(table(spark, d, "code_chunks").select("id", "language", "content"))


def _numbered(rows, place: str):
    """``file_path, line, text``: the rows of each file as its lines, in order of place and text, counted from 1."""
    w = W.partitionBy("file_path").orderBy(place, "text")
    return rows.select("file_path", F.row_number().over(w).alias("line"), "text")


def _statements(spark, d, family: str):
    """Source lines: an import statement for each row of the dependency table, by source file."""
    g = table(spark, d, "dependency_graph").where((F.col("target_file") != "") & F.col("import_name").isNotNull() & (F.col("source_file") != ""))
    name, path = F.col("import_name"), F.regexp_replace("target_file", r"\.(ts|js|py|go)$", "")
    quoted = F.concat(F.lit("'"), path, F.lit("'"))
    if family == "python":
        line = F.concat(F.lit("from "), F.regexp_replace(F.regexp_replace(path, "^/", ""), "[^A-Za-z0-9_]+", "."), F.lit(" import "), name)
    elif family == "go":
        line = F.concat(F.lit("import "), name, F.lit(' "'), path, F.lit('"'))
    else:
        line = (
            F.when(F.col("line") % 4 == 0, F.concat(F.lit("import { "), name, F.lit(" } from "), quoted))
            .when(F.col("line") % 4 == 1, F.concat(F.lit("import "), name, F.lit(" from "), quoted))
            .when(F.col("line") % 4 == 2, F.concat(F.lit("import * as "), name, F.lit(" from "), quoted))
            .otherwise(F.concat(F.lit("const { "), name, F.lit(" } = require("), quoted, F.lit(")")))
        )
    rows = g.select(F.col("source_file").alias("file_path"), "line", line.alias("text")).where(F.col("line").isNotNull()).distinct()
    return _numbered(rows, "line").withColumn("language", F.lit(family))


def _imports(spark, d, family):
    found = code.parse_imports(_statements(spark, d, family), ["file_path"])
    return found.select("file_path", "line", "type", "name", "path", F.array_join("imported_names", ",").alias("names"))


def parse_imports_js(spark, d):
    return _imports(spark, d, "javascript")


def parse_imports_py(spark, d):
    return _imports(spark, d, "python")


def parse_imports_go(spark, d):
    return _imports(spark, d, "go")


def dependency_edges(spark, d):
    g = table(spark, d, "dependency_graph")
    files = g.select(F.col("source_file").alias("file_path")).unionByName(g.select(F.col("target_file").alias("file_path")))
    return code.build_dependency_graph(_statements(spark, d, "javascript"), files)


def extract_calls(spark, d):
    return code.extract_calls(_sources(spark, d), ["id"]).distinct()


def find_calls(spark, d):
    """How often each name is called."""
    return code.extract_calls(_sources(spark, d), ["id"]).distinct().groupBy("name").agg(F.count("*").alias("n_calls"), F.countDistinct("id").alias("n_sources"))


def calls_of_name(spark, d):
    """The calls of the name that is called most."""
    calls = cut(code.extract_calls(_sources(spark, d), ["id"]).distinct())
    row = calls.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").first()
    return code.find_calls(calls, row.name if row else "")


def extract_symbols(spark, d):
    return code.extract_symbols(_sources(spark, d), "id").distinct()


def _declared(spark, d):
    """The source lines of each file of the node table: classes with their methods, functions, types."""
    n = table(spark, d, "graph_nodes").where(F.col("kind").isin("class", "method", "function", "interface", "enum", "type_alias"))
    pad = {"class": "export class %s {", "method": "  %s(a) {", "function": "function %s(a) {", "interface": "interface %s {", "enum": "enum %s {", "type_alias": "type %s = a"}
    line = F.coalesce(*[F.when(F.col("kind") == k, F.format_string(v, "name")) for k, v in pad.items()])
    rows = n.where(F.col("name").rlike(r"^\w+$")).select("file_path", "start_line", line.alias("text")).distinct()
    return _numbered(rows, "start_line")


def extract_symbols_declared(spark, d):
    return code.extract_symbols(_declared(spark, d), "file_path")


def class_members(spark, d):
    return code.class_members(code.extract_symbols(_declared(spark, d), "file_path"), "file_path")


def asof_symbol(spark, d):
    """The declared symbol that holds each line of a file that an edge was made at."""
    n = table(spark, d, "graph_nodes").select("file_path", F.col("start_line").alias("line"), "qualified_name").distinct()
    u = table(spark, d, "unresolved_refs").where(F.col("file_path").isNotNull() & F.col("line").isNotNull()).select("file_path", "line", "reference_kind").distinct()
    return code.containing_symbol(u, n, "file_path")


def extract_references(spark, d):
    """References in a file to its own symbols: the chunks of all spellings of its path, each line at its place."""
    c = table(spark, d, "code_chunks").select(fx.one_spelling("file_path").alias("file_path"), "start_line", "content")
    lines = code.chunk_lines(spread(c), "file_path")
    return code.extract_references(lines, code.extract_symbols(lines, "file_path"), "file_path")


def normalize_import_path(spark, d):
    """Relative spellings of each dependency's target, taken back to the file."""
    g = table(spark, d, "dependency_graph").where(F.col("target_file").startswith("/") & F.col("source_file").startswith("/"))
    up = F.repeat(F.lit("../"), F.size(F.split("source_file", "/")) - 2)
    rel = F.concat(F.lit("./"), up, F.substring("target_file", F.lit(2), F.length("target_file")), F.lit("?raw=1"))
    return g.select("source_file", code.normal_import(rel, "source_file").alias("normal")).distinct()


def language_of(spark, d):
    return table(spark, d, "graph_nodes").select("file_path", fx.language_of("file_path").alias("lang")).distinct()


def project_stats(spark, d):
    return index.project_stats(table(spark, d, "code_chunks"))


def language_counts(spark, d):
    return index.language_counts(table(spark, d, "code_chunks"))


def stats_empty(spark, d):
    """Statistics of the empty project path: zeros."""
    own = table(spark, d, "code_chunks").where(F.col("project_path") == "")
    return own.agg(F.count("*").alias("n_chunks"), F.countDistinct("file_path").alias("n_files"), F.coalesce(F.sum(F.col("end_line") - F.col("start_line") + 1), F.lit(0).cast("long")).alias("n_lines"))


def latest_file_hash(spark, d):
    return index.latest_hash(table(spark, d, "code_chunks"), ["project_path", "file_path"], "file_hash", "indexed_at")


def changed_files(spark, d):
    """Files whose last hash isn't the one an index of the cutoff day held."""
    c = table(spark, d, "code_chunks")
    keys = ["project_path", "file_path"]
    old = index.latest_hash(c.where(F.col("indexed_at") < CUTOFF), keys, "file_hash", "indexed_at")
    return index.changed_files(index.latest_hash(c, keys, "file_hash", "indexed_at"), old, keys, "file_hash")


def file_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("file_hash"))


def reindexed_chunks(spark, d):
    """Chunks after files that were indexed again on or after the cutoff replaced their old chunks."""
    c = table(spark, d, "code_chunks").select("project_path", "file_path", "id", "indexed_at").distinct()
    return index.replace_by_key(c.where(F.col("indexed_at") < CUTOFF), c.where(F.col("indexed_at") >= CUTOFF), ["project_path", "file_path"])


def deleted_file_graph(spark, d):
    """Edges left after the graph of every file under a folder is deleted."""
    nodes = table(spark, d, "graph_nodes")
    return index.delete_graph_of_files(nodes, table(spark, d, "graph_edges"), nodes.where(F.col("file_path").contains("/tools/")))[1].select("source", "target", "kind").distinct()


def embed_local_slots(spark, d):
    return index.local_embedding(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text").withColumn("weight", F.round("weight", 6))


def embed_local_topk(spark, d):
    """Documents nearest to the first long English one, by hashed word vectors."""
    vectors = index.local_embedding(table(spark, d, "documents"), "doc_id", "text")
    first = table(spark, d, "documents").where((F.col("lang") == "en") & (F.col("n_chars") > 300)).agg(F.min("doc_id")).first()[0]
    return index.embedding_topk(vectors, "doc_id", vectors.where(F.col("doc_id") == first), 20).withColumn("score", F.round("score", 6))


def chunk_documents(spark, d):
    """Documents packed into chunks of up to 64 words at line boundaries."""
    return index.chunk_sources(table(spark, d, "documents"), "doc_id", "text", 64)


def split_long_text(spark, d):
    return index.split_messages(table(spark, d, "code_chunks").select("id", "content").distinct(), "id", "content")


QUERIES = {f.__name__: f for f in (
    parse_imports_js, parse_imports_py, parse_imports_go, dependency_edges, extract_calls, find_calls, calls_of_name, extract_symbols,
    extract_symbols_declared, class_members, asof_symbol, extract_references, normalize_import_path, language_of, project_stats,
    language_counts, stats_empty, latest_file_hash, changed_files, file_hashes, reindexed_chunks, deleted_file_graph,
    embed_local_slots, embed_local_topk, chunk_documents, split_long_text,
)}

_G = "FROM dependency_graph WHERE target_file <> '' AND import_name IS NOT NULL AND source_file <> '' AND line IS NOT NULL"
_PATH = r"regexp_replace(target_file, '\.(ts|js|py|go)$', '')"


def _statement_sql(text: str) -> str:
    return f"SELECT file_path, kind, name, path, CAST(row_number() OVER (PARTITION BY file_path ORDER BY l, text) AS INTEGER) AS line FROM (SELECT DISTINCT source_file AS file_path, line AS l, import_name AS name, {text} {_G})"


_JS = _statement_sql(f"""{_PATH} AS path, line % 4 AS kind, CASE line % 4 WHEN 0 THEN 'import {{ ' || import_name || ' }} from ''' || {_PATH} || ''''
      WHEN 1 THEN 'import ' || import_name || ' from ''' || {_PATH} || '''' WHEN 2 THEN 'import * as ' || import_name || ' from ''' || {_PATH} || ''''
      ELSE 'const {{ ' || import_name || ' }} = require(''' || {_PATH} || ''')' END AS text""")
_PYPATH = f"regexp_replace(regexp_replace({_PATH}, '^/', ''), '[^A-Za-z0-9_]+', '.', 'g')"
_PY = _statement_sql(f"{_PYPATH} AS path, 0 AS kind, 'from ' || {_PYPATH} || ' import ' || import_name AS text")
_GO = _statement_sql(f"{_PATH} AS path, 0 AS kind, 'import ' || import_name || ' \"' || {_PATH} || '\"' AS text")

_LINES = "SELECT DISTINCT id, fam, line, ls[line] AS text FROM (SELECT id, fam, ls, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT DISTINCT id, CASE WHEN lower(language) IN ('python', 'go') THEN lower(language) ELSE 'javascript' END AS fam, string_split(content, chr(10)) AS ls FROM code_chunks WHERE content IS NOT NULL))"


def _calls_part(fam: str) -> str:
    pattern = (code.PLAIN_CALL if fam == "python" else code.DOTTED_CALL).replace("'", "''")
    words = lambda s: ", ".join(f"'{w}'" for w in s)
    return f"""SELECT id, CAST(line AS INTEGER) AS line, CAST(off AS INTEGER) AS "column", name FROM (
        SELECT id, line, text, names[i] AS name, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
          + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0) AS off
        FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
          SELECT id, line, text, regexp_extract_all(text, '{pattern}', 0) AS whole, regexp_extract_all(text, '{pattern}', 1) AS names,
            string_split_regex(text, '{pattern}') AS gaps FROM lines WHERE fam = '{fam}')))
      WHERE name NOT IN ({words(code.NO_CALLS[fam])}) AND trim(text[1:CAST(off AS BIGINT)], ' ' || chr(9) || chr(13)) NOT IN ({words(code.DECLARES[fam])})"""


_CALLS = f"WITH lines AS ({_LINES}) SELECT DISTINCT * FROM (" + " UNION ALL ".join(map(_calls_part, ("javascript", "python", "go"))) + ")"
_SYMBOL_RULES = (("class", code.CLASS), ("function", code.FUNCTION), ("function", code.ARROW), ("method", code.METHOD), *code.OTHERS)


def _symbols(key: str, lines: str) -> str:
    q = lambda p: p.replace("'", "''")
    cls, blocks = q(code.CLASS), ", ".join(f"'{b}'" for b in code.BLOCKS)
    cases = {"kind": "", "name": ""}
    for kind, p in _SYMBOL_RULES:
        when = f"WHEN regexp_matches(text, '{q(p)}')" + (" AND scope <> ''" if kind == "method" else "")
        name = f"regexp_extract(text, '{q(p)}', 1)"
        if kind == "method":
            cases["kind"] += f" {when} THEN CASE WHEN {name} NOT IN ({blocks}) THEN 'method' END"
        else:
            cases["kind"] += f" {when} THEN '{kind}'"
        cases["name"] += f" {when} THEN {name}"
    return f"""SELECT {key}, line, kind, name, CASE WHEN kind IN ('function', 'method') AND scope <> '' THEN scope || '.' || name ELSE name END AS qualified_name,
        contains(text, 'export') AND kind NOT IN ('method', 'import') AS is_exported FROM (
      SELECT *, CASE {cases['kind']} END AS kind, CASE {cases['name']} END AS name FROM (
        SELECT *, last_value(event IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY line, text ROWS UNBOUNDED PRECEDING) AS scope FROM (
          SELECT *, CASE WHEN regexp_matches(text, '{cls}') THEN regexp_extract(text, '{cls}', 1) WHEN regexp_matches(text, '^\\s*\\}}') THEN '' END AS event
          FROM ({lines})))) WHERE kind IS NOT NULL"""


_DECLARED = """SELECT file_path, CAST(row_number() OVER (PARTITION BY file_path ORDER BY start_line, text) AS INTEGER) AS line, text FROM (
    SELECT DISTINCT file_path, start_line, CASE kind WHEN 'class' THEN 'export class ' || name || ' {' WHEN 'method' THEN '  ' || name || '(a) {'
      WHEN 'function' THEN 'function ' || name || '(a) {' WHEN 'interface' THEN 'interface ' || name || ' {' WHEN 'enum' THEN 'enum ' || name || ' {'
      ELSE 'type ' || name || ' = a' END AS text
    FROM graph_nodes WHERE kind IN ('class', 'method', 'function', 'interface', 'enum', 'type_alias') AND regexp_full_match(name, '\\w+'))"""
_FILE_LINES = r"""SELECT DISTINCT file_path, CAST(first + i - 1 AS INTEGER) AS line, ls[i] AS text FROM (SELECT file_path, first, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
    SELECT regexp_replace(replace(file_path, '\', '/'), '/(\.?/)+', '/', 'g') AS file_path, coalesce(start_line, 1) AS first, string_split(content, chr(10)) AS ls
    FROM code_chunks WHERE content IS NOT NULL))"""
_REFERENCES = rf"""WITH l AS ({_FILE_LINES}), s AS ({_symbols('file_path', 'SELECT * FROM l')}),
    r AS (SELECT file_path, line, 'calls' AS kind, name FROM (SELECT *, unnest(regexp_extract_all(text, '(\w+)\(', 1)) AS name FROM l)
        WHERE NOT contains(text, 'function ' || name) AND NOT contains(text, 'const ' || name)
      UNION SELECT file_path, line, 'instantiates', regexp_extract(text, '\bnew\s+(\w+)\s*\(', 1) FROM l WHERE regexp_matches(text, '\bnew\s+(\w+)\s*\(')
      UNION SELECT file_path, line, 'extends', regexp_extract(text, '\bextends\s+(\w+)', 1) FROM l WHERE regexp_matches(text, '\bextends\s+(\w+)')),
    t AS (SELECT file_path, name, arg_min(qualified_name, (line, qualified_name)) AS target, bool_or(kind IN ('function', 'method')) AS f, bool_or(kind = 'class') AS c FROM s GROUP BY 1, 2),
    k AS (SELECT r.*, target FROM r JOIN t USING (file_path, name) WHERE CASE WHEN r.kind = 'calls' THEN f ELSE c END)
    SELECT DISTINCT k.file_path, k.line, k.kind, max_by(s.qualified_name, (s.line, s.qualified_name)) AS source, k.target
    FROM k JOIN s ON s.file_path = k.file_path AND s.line <= k.line GROUP BY k.file_path, k.line, k.kind, k.name, k.target HAVING source <> k.target"""
_SLOTS = r"""words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^A-Za-z0-9_]+'), lambda w: length(w) > 2) AS ws FROM documents),
    freq AS (SELECT doc_id, n, w, count(*) AS c FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS w FROM words) GROUP BY ALL),
    hashed AS (SELECT DISTINCT w, abs(list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(w, ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda h, c: ((h * 32 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 + h + c)) % 3072 AS slot FROM freq),
    slots AS (SELECT doc_id, slot, sum(c / n) AS x FROM freq JOIN hashed USING (w) GROUP BY ALL),
    unit AS (SELECT doc_id, CAST(slot AS INTEGER) AS slot, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM slots)"""
_LAST = "SELECT project_path, file_path, max_by(file_hash, (indexed_at, file_hash)) AS file_hash FROM code_chunks WHERE file_hash IS NOT NULL {more} GROUP BY 1, 2"
_EXT = "lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1))"

ORACLE = {
    "parse_imports_js": f"""SELECT file_path, line, CASE kind WHEN 0 THEN 'named' WHEN 1 THEN 'default' WHEN 2 THEN 'namespace' ELSE 'require' END AS type,
      CASE WHEN kind IN (1, 2) THEN name ELSE path END AS name, path, CASE WHEN kind = 2 THEN '*' ELSE name END AS names FROM ({_JS})""",
    "parse_imports_py": f"SELECT file_path, line, 'named' AS type, path AS name, path, name AS names FROM ({_PY})",
    "parse_imports_go": f"SELECT file_path, line, 'namespace' AS type, name, path, name AS names FROM ({_GO})",
    "dependency_edges": f"""WITH files AS (SELECT DISTINCT source_file AS f FROM dependency_graph WHERE source_file <> '' UNION SELECT target_file FROM dependency_graph WHERE target_file <> ''),
      ends AS (SELECT * FROM (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '.py'), (6, '.go'), (7, '/index.ts'), (8, '/index.js')) v(r, e))
      SELECT DISTINCT file_path AS source_file, arg_min(f, r) AS target_file, CASE WHEN kind = 2 THEN '*' ELSE name END AS import_name, line
      FROM ({_JS}) JOIN ends ON true JOIN files ON f = path || e GROUP BY file_path, line, path, kind, name""",
    "extract_calls": _CALLS,
    "calls_of_name": f"WITH c AS ({_CALLS}) SELECT * FROM c WHERE name = (SELECT name FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    "find_calls": f"SELECT name, count(*) AS n_calls, count(DISTINCT id) AS n_sources FROM ({_CALLS}) GROUP BY 1",
    "extract_symbols": "SELECT DISTINCT id, CAST(line AS INTEGER) AS line, kind, name, qualified_name, is_exported FROM (" + _symbols("id", _LINES) + ")",
    "extract_symbols_declared": _symbols("file_path", _DECLARED),
    "class_members": f"""SELECT DISTINCT file_path, split_part(qualified_name, '.', 1) AS source, qualified_name AS target
      FROM ({_symbols('file_path', _DECLARED)}) WHERE kind IN ('function', 'method') AND contains(qualified_name, '.')""",
    "asof_symbol": """SELECT u.file_path, u.line, u.reference_kind,
      (SELECT max_by(n.qualified_name, (n.start_line, n.qualified_name)) FROM graph_nodes n WHERE n.file_path = u.file_path AND n.start_line <= u.line) AS inside
      FROM (SELECT DISTINCT file_path, line, reference_kind FROM unresolved_refs WHERE file_path IS NOT NULL AND line IS NOT NULL) u""",
    "extract_references": _REFERENCES,
    "normalize_import_path": "SELECT DISTINCT source_file, target_file AS normal FROM dependency_graph WHERE starts_with(target_file, '/') AND starts_with(source_file, '/')",
    "language_of": f"""SELECT DISTINCT file_path, CASE WHEN {_EXT} IN ('ts', 'tsx') THEN 'typescript' WHEN {_EXT} IN ('js', 'jsx') THEN 'javascript' WHEN {_EXT} = 'py' THEN 'python'
      WHEN {_EXT} = 'rs' THEN 'rust' WHEN {_EXT} IN ('c', 'h') THEN 'c' WHEN {_EXT} IN ('cpp', 'hpp') THEN 'cpp' WHEN {_EXT} IN ('go', 'java', 'json') THEN {_EXT} ELSE 'text' END AS lang FROM graph_nodes""",
    "project_stats": """SELECT project_path, count(*) AS n_chunks, count(DISTINCT file_path) AS n_files, CAST(sum(end_line - start_line + 1) AS BIGINT) AS n_lines,
      count(DISTINCT language) AS n_languages, max(indexed_at) AS last_indexed
      FROM (SELECT DISTINCT project_path, id, file_path, start_line, end_line, language, indexed_at FROM code_chunks) GROUP BY 1""",
    "language_counts": """SELECT project_path, language, count(*) AS n_chunks, count(DISTINCT file_path) AS n_files
      FROM (SELECT DISTINCT project_path, language, id, file_path FROM code_chunks) GROUP BY 1, 2""",
    "stats_empty": "SELECT count(*) AS n_chunks, count(DISTINCT file_path) AS n_files, CAST(coalesce(sum(end_line - start_line + 1), 0) AS BIGINT) AS n_lines FROM code_chunks WHERE project_path = ''",
    "latest_file_hash": _LAST.format(more=""),
    "changed_files": f"SELECT * FROM ({_LAST.format(more='')}) EXCEPT SELECT * FROM ({_LAST.format(more=f"AND indexed_at < '{CUTOFF}'")})",
    "file_hashes": "SELECT doc_id, sha256(text) AS file_hash FROM documents",
    "reindexed_chunks": f"""WITH c AS (SELECT DISTINCT project_path, file_path, id, indexed_at FROM code_chunks)
      SELECT * FROM c WHERE indexed_at >= '{CUTOFF}' OR NOT EXISTS (SELECT 1 FROM c n WHERE n.indexed_at >= '{CUTOFF}' AND n.project_path = c.project_path AND n.file_path = c.file_path)""",
    "deleted_file_graph": """WITH gone AS (SELECT id FROM graph_nodes WHERE contains(file_path, '/tools/'))
      SELECT DISTINCT source, target, kind FROM graph_edges e WHERE NOT EXISTS (SELECT 1 FROM gone WHERE id = e.source) AND NOT EXISTS (SELECT 1 FROM gone WHERE id = e.target)""",
    "embed_local_slots": f"WITH {_SLOTS} SELECT doc_id, slot, round(weight, 6) AS weight FROM unit",
    "embed_local_topk": f"""WITH {_SLOTS} SELECT u.doc_id, round(sum(u.weight * q.weight), 6) AS score FROM unit u JOIN unit q ON q.slot = u.slot
      WHERE q.doc_id = (SELECT min(doc_id) FROM documents WHERE lang = 'en' AND n_chars > 300) GROUP BY u.doc_id ORDER BY sum(u.weight * q.weight) DESC, u.doc_id LIMIT 20""",
}
