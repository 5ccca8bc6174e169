"""Source trees as tables: scanning with ignore rules, counting, hashing, and small configuration files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.text import extension, language_of

#: What scans leave out by default, and the endings they read.
IGNORED = (
    "node_modules", ".git", "dist", "build", ".next", ".nuxt", ".cache", "__pycache__", "*.pyc", ".DS_Store", "Thumbs.db",
    ".env.local", ".env.*.local", "*.log", "pnpm-lock.yaml", "package-lock.json", "yarn.lock",
)
CHUNKED = ("ts", "js", "py", "go", "rs", "java", "c", "cpp", "h", "json")
LINKED = ("ts", "tsx", "js", "jsx", "py", "go")


def glob_pattern(rule: str) -> tuple[bool, str] | None:
    """(negated, regex for a relative path) of one line of an ignore file; None for blanks and comments.

    ``*`` and ``?`` stay within a folder, ``**`` crosses folders, a slash in front or within ties the rule to the root, one at
    the end means folders; whatever matches takes all below it along.
    """
    rule = rule.strip()
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule[negated:]
    folder = rule.endswith("/")
    body = rule.strip("/")
    if not body:
        return None
    tied = "/" in rule.rstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return negated, ("^" if tied else r"^(?:.*/)?") + out + (r"/.*\z" if folder else r"(?:/.*)?\z")


def ignored(path: str | Column, rules: Iterable[str] = IGNORED) -> Column:
    """Whether a relative path is left out: the last rule that matches decides. One regex for each run of like rules."""
    c = F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"\\", "/")
    runs: list[tuple[bool, list[str]]] = []
    for g in filter(None, map(glob_pattern, rules)):
        if runs and runs[-1][0] == g[0]:
            runs[-1][1].append(g[1])
        else:
            runs.append((g[0], [g[1]]))
    out = F.lit(False)
    for negated, patterns in runs:
        out = F.when(c.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(not negated)).otherwise(out)
    return out


def relative_path(path: str | Column, root: str) -> Column:
    """A path (or file URI) below the root, without it."""
    c = F.regexp_replace(F.col(path) if isinstance(path, str) else path, "^file:/+", "/")
    return F.regexp_replace(c, "^" + re.escape(root.rstrip("/")) + "/", "")


#: The files of a tree that name what is left out.
IGNORE_FILES = (".gitignore", ".indexignore")


def ignore_rules(spark: SparkSession, root: str, names: Iterable[str] = IGNORE_FILES) -> tuple[str, ...]:
    """The default rules and those of the ignore files right below a root, in order; files that aren't there add none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    rules = list(IGNORED)
    for name in names:
        path = hadoop.Path(f"{root.rstrip('/')}/{name}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            stream = fs.open(path)
            try:
                rules += bytes(stream.readAllBytes()).decode("utf-8", "replace").splitlines()
            finally:
                stream.close()
    return tuple(rules)


def _listed(spark: SparkSession, root: str, endings: Iterable[str]) -> DataFrame:
    """The files below a root with one of the endings: Spark lists them, none is read until its content is asked for."""
    ending = ",".join(f"{e},{e.upper()}" for e in endings)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{ending}}}").load(root)


def scan_sources(spark: SparkSession, root: str, *, endings: Iterable[str] = CHUNKED, rules: Iterable[str] | None = None, longest: int | None = None) -> DataFrame:
    """``file_path, content, file_hash, language``: the text files below a root, relative paths, one row each.

    Rules are by default those of the tree's ignore files after the fixed ones. Names are listed first; only the files that
    stay are opened, and of those only up to ``longest`` bytes.
    """
    kept = kept_files(spark, root, endings=endings, rules=rules)
    paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(r.path)) for r in kept.select("path").toLocalIterator()]  # the listing, which the driver has made
    shape = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], shape)
    if longest is not None:
        raw = raw.where(F.col("length") <= longest)
    own = raw.withColumn("file_path", relative_path("path", root))
    text = F.decode("content", "utf-8")
    return own.select("file_path", text.alias("content"), F.sha2("content", 256).alias("file_hash"), language_of("file_path").alias("language"))


def kept_files(spark: SparkSession, root: str, *, endings: Iterable[str] = CHUNKED, rules: Iterable[str] | None = None) -> DataFrame:
    """``path, file_path, length`` of the files that a scan reads."""
    endings = list(endings)
    listed = _listed(spark, root, endings).select("path", relative_path("path", root).alias("file_path"), "length")
    return listed.where(extension("file_path").isin(*endings) & ~ignored("file_path", ignore_rules(spark, root) if rules is None else rules))


def skipped_files(spark: SparkSession, root: str, *, endings: Iterable[str] = CHUNKED, rules: Iterable[str] | None = None, longest: int | None = None) -> DataFrame:
    """``file_path, reason``: what a scan leaves out: ``ending``, ``ignored`` or ``size``."""
    rules = ignore_rules(spark, root) if rules is None else rules
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(relative_path("path", root).alias("file_path"), "length")
    reason = F.when(ignored("file_path", rules), "ignored").when(~extension("file_path").isin(*endings), "ending")
    if longest is not None:
        reason = reason.when(F.col("length") > longest, "size")
    return every.select("file_path", reason.alias("reason")).where(F.col("reason").isNotNull())


def count_files(spark: SparkSession, root: str, *, endings: Iterable[str] = LINKED, rules: Iterable[str] | None = None) -> DataFrame:
    """``n_files, n_folders`` below a root; no file is read."""
    own = kept_files(spark, root, endings=endings, rules=rules).select(F.col("file_path").alias("p")).where(~F.col("p").rlike(r"(^|/)\."))
    return own.agg(F.count("*").alias("n_files"), F.countDistinct(F.regexp_extract("p", "^(.*/)?", 1)).alias("n_folders"))


def changed_sources(scanned: DataFrame, indexed: DataFrame) -> DataFrame:
    """Scanned files that the index doesn't hold with the same hash."""
    return scanned.join(indexed.select("file_path", "file_hash").distinct(), ["file_path", "file_hash"], "left_anti")


def json_rows(spark: SparkSession, path: str, item: str, *, wrappers: Iterable[str] = ("data", "items", "messages", "sessions")) -> DataFrame:
    """``item`` (JSON text) of each element of JSON files that hold an array, or an object with an array under a known name."""
    v = F.try_parse_json("value")
    arrays = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), *[F.try_variant_get(v, f"$.{w}", "array<variant>") for w in wrappers])
    return spark.read.text(path, wholetext=True).select(F.explode(arrays).alias("v")).select(F.to_json("v").alias(item))


def without_comments(text: str) -> str:
    """JSON with comments and trailing commas as plain JSON; strings stay as they are."""
    kept = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", kept, flags=re.S)


def merged(target: dict, source: dict) -> dict:
    """A deep merge of objects: the source wins, arrays and scalars are replaced."""
    out = dict(target)
    for k, v in source.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_config(text: str, defaults: dict) -> dict:
    """Defaults with a configuration's values over them; text that is no JSON object gives the defaults."""
    try:
        got = json.loads(without_comments(text))
    except ValueError:
        return dict(defaults)
    return merged(defaults, got) if isinstance(got, dict) else dict(defaults)


def parse_env(lines: DataFrame, text: str = "value") -> DataFrame:
    """``name, setting`` of ``NAME=setting`` lines; comments and blanks are skipped, one pair of quotes is taken off."""
    rule = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"
    raw = F.regexp_extract(text, rule, 2)
    quoted = F.regexp_extract(raw, r"^(?:\"(.*)\"|'(.*)')$", 1), F.regexp_extract(raw, r"^(?:\"(.*)\"|'(.*)')$", 2)
    value = F.when(raw.rlike("^\".*\"$"), quoted[0]).when(raw.rlike("^'.*'$"), quoted[1]).otherwise(raw)
    return lines.where(F.col(text).rlike(rule)).select(F.regexp_extract(text, rule, 1).alias("name"), value.alias("setting"))


def parse_roots(lines: DataFrame, text: str) -> DataFrame:
    """``pos, scope, label, path`` of ``label=path;path;…`` lists: the first = splits, a label defaults to the last folder."""
    parts = lines.select(F.posexplode(F.split(text, ";")).alias("pos", "part")).where(F.trim("part") != "")
    at = F.instr("part", "=")
    path = F.regexp_replace(F.trim(F.when(at > 0, F.substring("part", at + 1, F.length("part"))).otherwise(F.col("part"))), "(?<=.)/+$", "")
    label = F.nullif(F.trim(F.when(at > 0, F.substring("part", F.lit(1), at - 1)).otherwise(F.lit(""))), F.lit(""))
    base = F.nullif(F.regexp_extract(path, "([^/]+)$", 1), F.lit(""))
    named = F.coalesce(label, base, F.concat(F.lit("Root "), (F.col("pos") + 1).cast("string")))
    scope = F.regexp_replace(F.regexp_replace(F.lower(named), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return parts.select("pos", scope.alias("scope"), named.alias("label"), path.alias("path")).where(F.col("path") != "")
