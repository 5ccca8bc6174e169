"""Extraction on the literal cases: imports, calls, paths, symbols, references."""

import pytest

from codequarry.operators import code as c
from codequarry.operators import graph as g
from codequarry.plans import code_queries


def frame(spark, language, *lines):
    return spark.createDataFrame([("f", "\n".join(lines), language)], "file_path string, content string, language string")


IMPORTS = [
    ("typescript", "import React from 'react';", ("default", "React", "react", ["React"])),
    ("typescript", "  import { useState, useEffect } from 'react';", ("named", "react", "react", ["useState", "useEffect"])),
    ("javascript", "import * as React from 'react';", ("namespace", "React", "react", ["*"])),
    ("typescript", "import React, { useState } from 'react';", ("named", "react", "react", ["React", "useState"])),
    ("javascript", "const { foo, bar } = require('./utils');", ("require", "./utils", "./utils", ["foo", "bar"])),
    ("javascript", "const _ = require('lodash');", ("namespace", "_", "lodash", ["*"])),
    ("python", "import sys as system", ("default", "sys", "sys", ["sys"])),
    ("python", "from os.path import (join, exists)", ("named", "os.path", "os.path", ["join", "exists"])),
    ("go", 'import "fmt"', ("default", "fmt", "fmt", ["fmt"])),
    ("go", 'import f "fmt"', ("namespace", "f", "fmt", ["f"])),
    ("javascript", "// import x from 'y'", None),
    ("go", '  import "fmt"', None),
    ("python", "# import os", None),
]


@pytest.mark.parametrize(("language", "line", "want"), IMPORTS)
def test_imports(spark, language, line, want):
    got = c.parse_imports(frame(spark, language, "", line), ["file_path"]).collect()
    assert [(r.line, r.type, r.name, r.path, r.imported_names) for r in got] == ([(2, *want)] if want else [])


CALLS = [
    ("javascript", ["foo();", " bar();"], [("foo", 1, 0), ("bar", 2, 1)]),
    ("javascript", ["obj.method();", "arr.map(x => x);"], [("obj.method", 1, 0), ("arr.map", 2, 0)]),
    ("javascript", ["if (a) {", "for (;;) x", "return (1)", "new Foo (2)", "function own() {"], []),
    ("javascript", ["a(b(c ( 1 )))"], [("a", 1, 0), ("b", 1, 2), ("c", 1, 4)]),
    ("python", ["foo()", "  x.bar()"], [("foo", 1, 0), ("bar", 2, 4)]),
    ("python", ["if x:", "for i in range(10):", "  return x", "def f():"], []),
    ("go", ['fmt.Println("hello")', "func f() {", "os.Exit(1)"], [("fmt.Println", 1, 0), ("os.Exit", 3, 0)]),
]


@pytest.mark.parametrize(("language", "lines", "want"), CALLS)
def test_calls(spark, language, lines, want):
    got = c.extract_calls(frame(spark, language, *lines), ["file_path"])
    assert sorted((r.name, r.line, r.column) for r in got.collect()) == sorted(want)
    assert c.find_calls(got, "nonexistent").count() == 0


def test_nulls_and_empty(spark):
    rows = spark.createDataFrame([("a", None, None), ("b", "", "go"), ("c", "x" * 100_000 + "(", None)], "file_path string, content string, language string")
    assert c.parse_imports(rows, ["file_path"]).count() == 0
    assert [r.file_path for r in c.extract_calls(rows, ["file_path"]).collect()] == ["c"]
    assert c.extract_symbols(rows.limit(0), "file_path").count() == 0


def test_symbols_and_references(spark):
    src = frame(
        spark, "typescript", "export class Base {", "}", "export class Shop extends Base {", "  sell(item) {", "    helper(item);", "    if (x) {", "  }", "  readonly buy(n) {", "}",
        "export async function helper(x) {", "  return new Shop(x);", "interface Face {", "export type Kind = string", "enum Color {", "const arrow = async (a) => a", "import { z } from './z'", "stray(a) {",
    )
    symbols = c.extract_symbols(src, "file_path")
    got = [(r.line, r.kind, r.qualified_name, r.is_exported) for r in symbols.orderBy("line").collect()]
    assert got == [
        (1, "class", "Base", True), (3, "class", "Shop", True), (4, "method", "Shop.sell", False), (10, "function", "helper", True), (12, "interface", "Face", False),
        (13, "type_alias", "Kind", True), (14, "enum", "Color", False), (15, "function", "arrow", False), (16, "import", "./z", False),
    ]
    assert {(r.source, r.target) for r in c.class_members(symbols, "file_path").collect()} == {("Shop", "Shop.sell")}
    refs = {(r.line, r.kind, r.source, r.target) for r in c.extract_references(src, symbols, "file_path").collect()}
    assert refs == {(3, "extends", "Shop", "Base"), (5, "calls", "Shop.sell", "helper"), (11, "instantiates", "helper", "Shop")}


def test_references_of_a_file_in_chunks(spark, tmp_path):
    rows = [
        ("z", "/p/./a.ts", 1, "class Shop {\n  sell(item) {"), ("c", "/p//a.ts", 3, "    helper(item);\n  }"), ("a", "\\p\\a.ts", 5, "}\nfunction helper(x) {\n  return new Shop(x);"),
        ("b", "/p/a.ts", 7, "  return new Shop(x);\n}"), ("d", "/p/b.ts", 1, "function alone(x) {\n  helper(x);"), ("e", "/p/b.ts", 3, None),
    ]
    spark.createDataFrame(rows, "id string, file_path string, start_line int, content string").write.parquet(str(tmp_path / "code_chunks.parquet"))
    got = sorted(tuple(r) for r in code_queries.extract_references(spark, str(tmp_path)).collect())
    assert got == [("/p/a.ts", 3, "calls", "Shop.sell", "helper"), ("/p/a.ts", 7, "instantiates", "helper", "Shop")]


def test_no_file_is_gathered_into_a_row(spark, tmp_path):
    deps = [("/p/big.ts", f"/p/m{k}.ts", f"n{k}", k) for k in range(40)]
    spark.createDataFrame(deps, "source_file string, target_file string, import_name string, line int").write.parquet(str(tmp_path / "dependency_graph.parquet"))
    nodes = [("/p/big.ts", "class", "Shop", 1), ("/p/big.ts", "method", "sell", 2)]
    spark.createDataFrame(nodes, "file_path string, kind string, name string, start_line int").write.parquet(str(tmp_path / "graph_nodes.parquet"))
    rows = {}
    for f in (code_queries.parse_imports_js, code_queries.parse_imports_py, code_queries.parse_imports_go, code_queries.dependency_edges, code_queries.extract_symbols_declared, code_queries.class_members):
        df = f(spark, str(tmp_path))
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
        rows[f.__name__] = df.count()
    assert rows == {"parse_imports_js": 40, "parse_imports_py": 40, "parse_imports_go": 40, "dependency_edges": 40, "extract_symbols_declared": 2, "class_members": 1}
    bare = spark.createDataFrame([("f", 7, "import a from 'b'", "go"), ("f", 9, "import a from 'b'", None)], "file_path string, line int, text string, language string")
    assert [(r.line, r.path) for r in c.parse_imports(bare, ["file_path"]).collect()] == [(9, "b")]


PATHS = [("./utils", "/src/components/Button.tsx", "/src/components/utils"), ("../a/./b?x=1", "/src/c/d.ts", "/src/a/b"), ("react", "/a.ts", "react"), ("./u#h", "/a.ts", "/u"), ("../../../x", "/a/b.ts", "/x")]


def test_paths_and_graph(spark):
    rows = spark.createDataFrame(PATHS, "path string, source_file string, want string")
    assert all(r.got == r.want for r in rows.select("want", c.normal_import("path", "source_file").alias("got")).collect())
    src = spark.createDataFrame([("/p/src/index.ts", "import f from './foo'\nimport { b } from './bar'\nimport React from 'react'", "typescript"), ("/p/src/foo.ts", "", "typescript"), ("/p/src/bar.ts", "", "typescript")], "file_path string, content string, language string")
    edges = c.build_dependency_graph(src, src.select("file_path"))
    assert {tuple(r) for r in edges.collect()} == {("/p/src/index.ts", "/p/src/foo.ts", "f", 1), ("/p/src/index.ts", "/p/src/bar.ts", "b", 2)}
    assert {r[0] for r in g.dependencies_of(edges, "/p/src/index.ts").collect()} == {"/p/src/foo.ts", "/p/src/bar.ts"}
    assert {r[0] for r in g.dependents_of(edges, "/p/src/foo.ts").collect()} == {"/p/src/index.ts"}
    assert {r[0] for r in g.files_importing(edges, "bar").collect()} == {"/p/src/index.ts"}


def test_resolution_order(spark):
    imports = spark.createDataFrame([("/a/x.ts", "./m"), ("/a/y.ts", "lib/n"), ("/a/z.ts", "gone")], "source_file string, path string")
    files = spark.createDataFrame([("/a/m.js",), ("/a/m.ts",), ("/q/lib/n/index.ts",), ("/q/mylib/n.ts",), (None,)], "file_path string")
    assert {(r.source_file, r.target_file) for r in c.resolve_imports(imports, files).collect()} == {("/a/x.ts", "/a/m.ts"), ("/a/y.ts", "/q/lib/n/index.ts")}
