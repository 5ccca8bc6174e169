"""Rows from source text: imports, calls, symbols, references, and the dependency graph of files.

Everything is built from JVM expressions; lines that can't matter are filtered before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codequarry.functions.text import strip

#: Words before a parenthesis that are no calls, and what directly before a name makes it a declaration.
NO_CALLS = {
    "python": (
        "if", "while", "for", "try", "except", "finally", "with", "return", "raise", "import", "from", "as", "def", "class",
        "lambda", "assert", "pass", "break", "continue", "global", "nonlocal", "yield", "async", "await", "print", "len",
        "range", "str", "int", "float", "list", "dict", "set", "tuple", "bool", "type", "isinstance", "hasattr", "getattr",
        "setattr", "open", "input", "enumerate", "zip", "map", "filter",
    ),
    "go": (
        "if", "else", "for", "switch", "case", "default", "return", "break", "continue", "fallthrough", "goto", "go",
        "defer", "chan", "map", "make", "new", "append", "copy", "delete", "panic", "recover", "close", "len", "cap", "real",
        "imag", "complex", "print", "println", "printf", "fmt", "os", "package", "import", "func", "type", "struct",
        "interface", "const", "var",
    ),
    "javascript": (
        "if", "while", "for", "switch", "catch", "return", "throw", "new", "typeof", "instanceof", "import", "export",
        "from", "default", "const", "let", "var", "function", "class", "extends", "implements", "interface", "type", "enum",
        "async", "await", "yield", "static", "public", "private", "protected", "readonly", "get", "set",
    ),
}
DECLARES = {
    "python": (
        "def", "class", "import", "from",
    ),
    "go": (
        "func", "type", "const", "var",
    ),
    "javascript": (
        "function", "const", "let", "var", "class", "import", "export", "if", "while", "for", "return", "throw", "new",
    ),
}
DOTTED_CALL = r"([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*)\s*\("
PLAIN_CALL = r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\("

#: Import statements as (type, pattern, group of the path, group of the name; 0: the path itself).
JS_IMPORTS = (
    ("namespace", r"^import\s+\*\s+as\s+(\w+)\s+from\s+['\"]([^'\"]+)['\"]", 2, 1),
    ("named", r"^import\s+\{([^}]+)\}\s+from\s+['\"]([^'\"]+)['\"]", 2, 0),
    ("default", r"^import\s+(\w+)\s+from\s+['\"]([^'\"]+)['\"]", 2, 1),
    ("mixed", r"^import\s+(\w+\s*,\s*\{[^}]+)\}\s+from\s+['\"]([^'\"]+)['\"]", 2, 0),
    ("require", r"^const\s+\{([^}]+)\}\s+=\s+require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", 2, 0),
    ("namespace_require", r"^const\s+(\w+)\s+=\s+require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", 2, 1),
)
PY_IMPORTS = (("default", r"^import\s+(\w+)(?:\s+as\s+\w+)?", 1, 1), ("named", r"^from\s+((?:\w+\.)*\w+)\s+import\s+(.+)", 1, 0))
GO_IMPORTS = (("default", r"^import\s+\"([^\"]+)\"", 1, 1), ("namespace", r"^import\s+(\w+)\s+\"([^\"]+)\"", 2, 1))


def family(language: str | Column) -> Column:
    """python, go, or javascript for anything else."""
    low = F.lower(F.col(language) if isinstance(language, str) else language)
    return F.when(low.isin("python", "go"), low).otherwise(F.lit("javascript"))


def source_lines(sources: DataFrame, keys: list[str], content: str, keep: str | None = None) -> DataFrame:
    """``keys, line, text``: the lines of each content, counted from 1; only those that match ``keep``. Null has none.

    Sources without a content column are lines already (``keys, line, text``) and keep their numbers, so a large source need
    not be one row.
    """
    if content not in sources.columns:
        rows = sources if keep is None else sources.where(F.col("text").rlike(keep))
        return rows.select(*keys, "line", "text")
    lines = F.transform(F.split(content, "\n"), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    if keep is not None:
        lines = F.filter(lines, lambda x: x["text"].rlike(keep))
    return sources.select(*keys, F.explode(lines).alias("l")).select(*keys, "l.line", "l.text")


def chunk_lines(chunks: DataFrame, key: str, start: str = "start_line", content: str = "content") -> DataFrame:
    """``key, line, text``: the lines of chunks by their place in the file that ``key`` names.

    A chunk without a start begins at 1. A line in several chunks has as many rows; readers take equal ones once, and those
    that differ in order of text.
    """
    first = F.coalesce(F.col(start), F.lit(1)).cast("int") - 1
    rows = source_lines(chunks.withColumn("_first", first), [key, "_first"], content)
    return rows.select(key, (F.col("_first") + F.col("line")).alias("line"), "text")


def _names(text: Column) -> Column:
    parts = F.transform(F.split(F.regexp_replace(text, r"[(){}]", ""), ","), lambda n: strip(n))
    return F.filter(parts, lambda n: (n != "") & (n != "*"))


def _import_struct(text: Column, rules: tuple) -> Column:
    """The first rule that matches a line, as a struct; null if none does."""
    out: Column | None = None
    for kind, pattern, path_at, name_at in rules:
        hit = text.rlike(pattern)
        path = F.regexp_extract(text, pattern, path_at)
        name = F.regexp_extract(text, pattern, name_at) if name_at else path
        if kind == "named" and path_at == 1:
            names = _names(F.regexp_extract(text, pattern, 2))
        elif kind in ("named", "mixed", "require"):
            names = _names(F.regexp_extract(text, pattern, 1))
        elif kind in ("namespace", "namespace_require") and rules is JS_IMPORTS:
            names = F.array(F.lit("*"))
        else:
            names = F.array(name)
        shown = {"mixed": "named", "namespace_require": "namespace"}.get(kind, kind)
        made = F.struct(F.lit(shown).alias("type"), name.alias("name"), path.alias("path"), names.alias("imported_names"))
        out = F.when(hit, made) if out is None else out.when(hit, made)
    return out


def parse_imports(sources: DataFrame, keys: list[str], content: str = "content", language: str = "language") -> DataFrame:
    """``keys, line, type, name, path, imported_names`` of every import statement.

    One statement a line. JavaScript rules hold for all languages but Python and Go; lines are trimmed first, but for Go.
    """
    lines = source_lines(sources.withColumn("_family", family(language)), [*keys, "_family"], content, r"^\s*(?:import|from|const)\s")
    text = F.when(F.col("_family") == "go", F.col("text")).otherwise(strip("text"))
    found = F.when(F.col("_family") == "python", _import_struct(F.col("t"), PY_IMPORTS)).when(F.col("_family") == "go", _import_struct(F.col("t"), GO_IMPORTS)).otherwise(_import_struct(F.col("t"), JS_IMPORTS))
    return lines.withColumn("t", text).withColumn("i", found).where(F.col("i").isNotNull()).select(*keys, "line", "i.*")


def extract_calls(sources: DataFrame, keys: list[str], content: str = "content", language: str = "language") -> DataFrame:
    """``keys, line, column, name`` of every call; columns count from 0.

    Offsets come from the lengths of what lies between the matches, so no Python is needed.
    """
    lines = source_lines(sources.withColumn("_family", family(language)), [*keys, "_family"], content, r"[a-zA-Z0-9_]\s*\(")
    fam, plain = F.col("_family"), F.col("_family") == "python"
    first = r"(?<![a-zA-Z_])"  # a match never starts within a word, so a long word without a parenthesis is tried once
    whole = F.when(plain, F.regexp_extract_all("text", F.lit(first + PLAIN_CALL), F.lit(0))).otherwise(F.regexp_extract_all("text", F.lit(first + DOTTED_CALL), F.lit(0)))
    gaps = F.when(plain, F.split("text", first + PLAIN_CALL, -1)).otherwise(F.split("text", first + DOTTED_CALL, -1))
    own = lines.withColumn("whole", whole).where(F.size("whole") > 0).withColumn("gaps", gaps)
    own = own.withColumn("names", F.transform("whole", lambda w: strip(F.substring(w, F.lit(1), F.length(w) - 1))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    sized = F.zip_with(F.slice("gaps", 1, F.size("whole")), "whole", lambda g, w: F.struct(F.length(g).alias("g"), F.length(w).alias("w")))
    offsets = F.aggregate(sized, start, lambda s, x: F.struct((s["at"] + x["g"] + x["w"]).alias("at"), F.concat(s["all"], F.array(s["at"] + x["g"])).alias("all")))["all"]
    calls = own.select(*keys, "_family", "line", "text", F.inline(F.arrays_zip(offsets.alias("column"), F.col("names").alias("name"))))
    before = strip(F.substring("text", F.lit(1), F.col("column")))
    ruled = lambda c, words: F.coalesce(*[F.when(fam == k, c.isin(*w)) for k, w in words.items()])
    return calls.where(~ruled(F.col("name"), NO_CALLS) & ~ruled(before, DECLARES)).select(*keys, "line", "column", "name")


def find_calls(calls: DataFrame, name: str) -> DataFrame:
    return calls.where(F.col("name") == name)


#: Declarations in the order in which they are tried.
CLASS = r"^\s*(?:export\s+)?class\s+(\w+)"
FUNCTION = r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"
ARROW = r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>"
METHOD = r"^\s*(?:readonly\s+)?(\w+)\s*\([^)]*\)\s*\{"
OTHERS = (("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type_alias", r"^\s*(?:export\s+)?type\s+(\w+)"), ("enum", r"^\s*(?:export\s+)?enum\s+(\w+)"), ("import", r"^\s*import\s+(?:\{[^}]+\}|\w+)\s+from\s+['\"](.+?)['\"]"))
BLOCKS = ("if", "else", "for", "while", "switch", "catch")


def extract_symbols(sources: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``key, line, kind, name, qualified_name, is_exported`` of the declarations in each source.

    A class is the scope of what follows until a line that starts with ``}``; the scope is the last such event before a
    line. One declaration a line, the first kind that matches. Sources with equal keys are taken as one text.
    """
    wanted = "|".join(f"(?:{p})" for p in (CLASS, FUNCTION, ARROW, METHOD, r"^\s*\}", *(p for _, p in OTHERS)))
    lines = source_lines(sources, [key], content, wanted).distinct()
    t = F.col("text")
    event = F.when(t.rlike(CLASS), F.regexp_extract(t, CLASS, 1)).when(t.rlike(r"^\s*\}"), F.lit(""))
    w = W.partitionBy(key).orderBy("line", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = lines.withColumn("scope", F.nullif(F.last(event, ignorenulls=True).over(w), F.lit("")))
    scope = F.col("scope")
    pick = lambda kind, p: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(t, p, 1).alias("name"))
    method = F.regexp_extract(t, METHOD, 1)
    found = F.when(t.rlike(CLASS), pick("class", CLASS)).when(t.rlike(FUNCTION), pick("function", FUNCTION)).when(t.rlike(ARROW), pick("function", ARROW))
    found = found.when(t.rlike(METHOD) & scope.isNotNull(), F.when(~method.isin(*BLOCKS), pick("method", METHOD)))
    for kind, p in OTHERS:
        found = found.when(t.rlike(p), pick(kind, p))
    rows = lines.withColumn("s", found).where(F.col("s").isNotNull())
    scoped = F.col("s.kind").isin("function", "method") & scope.isNotNull()
    exported = t.contains("export") & ~F.col("s.kind").isin("method", "import")
    return rows.select(key, "line", "s.kind", "s.name", F.when(scoped, F.concat_ws(".", scope, F.col("s.name"))).otherwise(F.col("s.name")).alias("qualified_name"), exported.alias("is_exported"))


def class_members(symbols: DataFrame, key: str) -> DataFrame:
    """``key, source, target``: the ``contains`` edges from a class to its methods."""
    m = symbols.where(F.col("kind").isin("function", "method") & F.col("qualified_name").contains("."))
    return m.select(key, F.substring_index("qualified_name", ".", 1).alias("source"), F.col("qualified_name").alias("target")).distinct()


def containing_symbol(marks: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """``marks`` (key, line, …) with ``inside``: the qualified name of the last symbol that starts at or before the line.

    A backward as-of join as one sort of both sides by key and line. Null where no symbol comes before.
    """
    cols = marks.columns
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in marks.schema.fields if f.name not in (key, "line")]
    s = symbols.select(key, "line", *blank, F.col("qualified_name").alias("_symbol"), F.lit(0).alias("_side"))
    m = marks.select(key, "line", *[c for c in cols if c not in (key, "line")], F.lit(None).cast("string").alias("_symbol"), F.lit(1).alias("_side"))
    w = W.partitionBy(key).orderBy("line", "_side", "_symbol").rowsBetween(W.unboundedPreceding, W.currentRow)
    return s.unionByName(m).withColumn("inside", F.last("_symbol", ignorenulls=True).over(w)).where(F.col("_side") == 1).select(*cols, "inside")


def extract_references(sources: DataFrame, symbols: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``key, line, kind, source, target``: calls, ``new X(`` and ``extends X`` that name a symbol of the same source.

    Source is the symbol that holds the line, target the first symbol of the name, of whatever kind, if one of them is a
    function or method (for calls) or a class; a reference to itself is dropped. Names are whole words, so the join is an
    equi-join. Only the first ``new`` and ``extends`` of a line count.
    """
    lines = source_lines(sources, [key], content, r"\w\(|\bnew\s|\bextends\s").distinct()
    t = F.col("text")
    names = F.array_distinct(F.regexp_extract_all(t, F.lit(r"(\w+)\("), F.lit(1)))
    called = F.filter(names, lambda n: ~F.contains(t, F.concat(F.lit("function "), n)) & ~F.contains(t, F.concat(F.lit("const "), n)))
    one = lambda p, kind: F.array_compact(F.array(F.when(t.rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(t, p, 1).alias("name")))))
    refs = F.concat(F.transform(called, lambda n: F.struct(F.lit("calls").alias("kind"), n.alias("name"))), one(r"\bnew\s+(\w+)\s*\(", "instantiates"), one(r"\bextends\s+(\w+)", "extends"))
    refs = lines.select(key, "line", F.explode(refs).alias("r")).select(key, "line", "r.kind", "r.name")
    has = lambda *kinds: F.max(F.col("kind").isin(*kinds))
    targets = symbols.groupBy(key, "name").agg(F.min(F.struct("line", "qualified_name")).alias("q"), has("function", "method").alias("f"), has("class").alias("c"))
    groups = F.array_compact(F.array(F.when(F.col("f"), "calls"), F.when(F.col("c"), "instantiates"), F.when(F.col("c"), "extends")))
    targets = targets.select(key, "name", F.explode(groups).alias("kind"), F.col("q.qualified_name").alias("target"))
    known = refs.join(targets, [key, "name", "kind"])
    found = containing_symbol(known.select(key, "line", "kind", "target"), symbols, key)
    return found.where(F.col("inside").isNotNull() & (F.col("inside") != F.col("target"))).select(key, "line", "kind", F.col("inside").alias("source"), "target").distinct()


def joined_path(file: Column, relative: Column) -> Column:
    """The relative path seen from the folder of the file, without ``.`` and ``..`` steps."""
    steps = F.filter(F.split(F.concat_ws("/", F.regexp_replace(file, "[^/]*$", ""), relative), "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return F.concat(F.when(file.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(walked, "/"))


def normal_import(path: str | Column, source_file: str | Column) -> Column:
    """An import path without its query; relative ones joined to the folder of the file. Packages stay as they are."""
    p = F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"(?s)[?#].*$", "")
    f = F.col(source_file) if isinstance(source_file, str) else source_file
    return F.when(p.startswith("."), joined_path(f, p)).otherwise(p)


#: What may be missing at the end of an import path, in the order in which it is tried.
ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".py", ".go", "/index.ts", "/index.js")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (source_file, path, …) with ``target_file``: the file that each import means; unresolved ones dropped.

    A path means a file that it equals or that ends with it at a folder boundary, as given or with an ending filled in; of
    several the exact one, then the first by name. Files are listed under each of their path's tails, so this is an
    equi-join and not a comparison of all imports with all files.
    """
    steps = F.split("file", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, i, F.size(steps)), "/"))
    named = files.select(F.col("file_path").alias("file")).where(F.col("file") != "").distinct()
    named = named.select("file", F.explode(F.array_distinct(F.concat(F.array("file"), F.filter(tails, lambda x: x != "")))).alias("tail"))
    tried = F.array(F.col("resolved"), *[F.concat("resolved", F.lit(e)) for e in ENDINGS])
    own = imports.withColumn("resolved", normal_import("path", "source_file")).withColumn("_id", F.struct(*imports.columns))
    asked = own.select("_id", "resolved", F.posexplode(tried).alias("rank", "tail"))
    hits = asked.join(named, "tail").withColumn("best", F.struct((F.col("file") != F.col("tail")).alias("partial"), "rank", "file"))
    found = hits.groupBy("_id").agg(F.min("best").alias("best"))
    return found.select("_id.*", F.col("best.file").alias("target_file"))


def build_dependency_graph(sources: DataFrame, files: DataFrame, content: str = "content") -> DataFrame:
    """``source_file, target_file, import_name, line`` from the imports of each ``file_path``."""
    found = parse_imports(sources.withColumn("source_file", F.col("file_path")), ["source_file"], content)
    rows = found.select("source_file", "line", "path", F.array_join("imported_names", ", ").alias("import_name")).distinct()
    return resolve_imports(rows, files).select("source_file", "target_file", "import_name", "line").distinct()
