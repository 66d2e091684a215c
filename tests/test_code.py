"""Syntax trees, the property graph and chunks on small sources."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import chunking as K
from lodestar.operators import property_graph as G
from lodestar.operators import syntax as X

SAMPLES = [
    "const f = (x: number, y = 2): Promise<Map<string, number>> => { return x + y; };", "export const g = async ({a, b: c}, [d]) => a ? b : c;", "type T = { a: string } | null;\ninterface I extends J<K> { a: string; m(): void }",
    "export default class A<T> extends B<C> implements D, E { private x: number = 1; static async go<T>(a: T): Promise<void> { if (a) return; } get q() { return 1 } constructor(private readonly a: string) { super(); } }",
    "let re = /a[/]b/g, s = `x${a + `y${b}`}z`;", "try { a() } catch (e: any) { b() } finally { c() }", "x ||= y && z\ntotal += a\ndo { i++ } while (i < 3)", "const v = new Foo<Bar>(1, ...rest).baz as unknown as string[];",
    "label: for (let i = 0, n = 3; i < n; i++) { continue label; }", "p = new Map<string, { resolve: (v: X) => void }>();", "if (a) b(); else if (c) d(); else { e() }", "export * as ns from './x';\nexport { a as b } from './y';",
]


@pytest.mark.parametrize("text", SAMPLES)
def test_trees_cover_their_texts(text):
    root = X.parse(text)
    for n in root.walk():
        ends = [(c.start, c.end) for c in n.children]
        assert ends == sorted(ends) and all(n.start <= a <= b <= n.end for a, b in ends)
    leaves = "".join(text[n.start : n.end] for n in root.walk() if not n.children)
    assert leaves == "".join(text[a:b] for _, a, b in X.tokens(text))


@pytest.mark.parametrize("text", ["??", "function (", "if (a", "`x", "class {{"])
def test_broken_texts_raise(text):
    with pytest.raises(SyntaxError):
        X.parse(text)


def test_branches_loops_and_switches():
    f = G.File("a.ts", "function f(a, xs) {\n  if (a) { one(); } else { two(); }\n  for (const x of xs) { if (x) break; go(); }\n  switch (a) { case 1: p(); case 2: q(); break; default: r(); }\n}")
    kinds = {e[2] for e in f.control()[1]}
    assert kinds == {"TRUE_BRANCH", "FALSE_BRANCH", "NEXT_STATEMENT", "FALLTHROUGH"}
    first, ends = f.entry()
    assert first is not None and ends == [first]
    alone = G.File("b.ts", "if (a) { b(); }")
    me = alone.id(alone.root.children[0])
    assert (me, me, "FALSE_BRANCH") in alone.control()[1]


def test_short_circuits():
    kinds = [e[2] for e in G.File("a.ts", "const x = a && b, y = c || d, z = e ? f : g;").control()[1]]
    assert kinds.count("TRUE_BRANCH") == 3 and kinds.count("FALSE_BRANCH") == 3 and kinds.count("NEXT_STATEMENT") == 2


def test_unparsed_files_have_no_rows(spark):
    files = spark.createDataFrame([("a.ts", "??"), ("b.py", "x = 1"), ("c.ts", None), ("d.ts", "f(1)")], "file string, content string")
    assert {r["file"] for r in G.ast_layer(files).nodes.collect()} == {"c.ts", "d.ts"}
    assert G.ast_layer(files, next_token=False).edges.filter("type <> 'CHILD'").count() == 0
    assert set(G.build(files)) == {"ast", "cfg", "dfg", "callGraph", "importGraph"}


def test_destructuring_and_compound_assignments(spark):
    files = spark.createDataFrame([("a.ts", "const { a, b: c } = source;\nlet total = 0;\ntotal += a;\n")], "file string, content string")
    lines = {(r["name"], r["def_line"]): r["use_lines"] for r in G.use_lines(files).collect()}
    assert lines == {("a", 1): [1], ("c", 1): [1], ("total", 2): [], ("total", 3): [3]}


def test_calls_across_files(spark):
    files = spark.createDataFrame([
        ("src/a.ts", "import { helper } from './lib';\nimport tool, { x as y } from './tool';\nexport function run() { helper(); y(); tool.z(); other(); this.run(); }\n"),
        ("src/lib/index.ts", "export function helper() { return 1; }\nclass K {}\n"), ("src/tool.js", "export function x() {}\nexport function z() { const q = require('../src/a'); q.run(); }\n"),
        ("src/sub.ts", "import { K } from './lib';\nclass L extends K<T> implements M {}\ninterface M {}\n"),
    ], "file string, content string")
    names = G.definitions(files).select("id", "name")
    calls = G.call_graph(files)
    pairs = calls.join(names.select(F.col("id").alias("caller"), F.col("name").alias("a")), "caller").join(names.select(F.col("id").alias("callee"), F.col("name").alias("b")), "callee").select("a", "b")
    assert sorted(map(tuple, pairs.collect())) == [("run", "helper"), ("run", "run"), ("run", "x"), ("run", "z"), ("z", "run")]
    run = names.filter("name = 'run'").first()["id"]
    assert G.callees(calls, run).count() == 4 and G.callers(calls, run).count() == 2
    kinds = {(r["type"], r["n"]) for r in G.import_layer(files).edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {("IMPORTS", 4), ("INHERITS", 1)}


def test_chunks(spark):
    body = "\n".join(f"  const a{i} = b{i} + c{i};" for i in range(200))
    files = spark.createDataFrame([("f.ts", "function small() { return helper(1); }"), ("c.ts", "class C { m() { return 1; } }"), ("long.ts", f"function long() {{\n{body}\n}}"), ("broken.ts", "?? " * 60), ("few.ts", "x = 1;")], "file string, content string")
    rows = K.chunks(files, max_tokens=200).collect()
    by = {f: [r for r in rows if r["file"] == f] for f in ("f.ts", "c.ts", "long.ts", "broken.ts", "few.ts")}
    assert [(r["node_type"], r["ast_path"], r["symbol_refs"]) for r in by["f.ts"]] == [("function_declaration", ["program", "function_declaration"], ["small", "helper"])]
    assert [r["node_type"] for r in by["c.ts"]] == ["class_declaration"] and len(by["long.ts"]) > 1 and all(r["token_count"] <= 200 for r in by["long.ts"])
    assert [r["node_type"] for r in by["broken.ts"]] == ["fragment"] and by["few.ts"] == []
    assert K.fold_hash("hello") == "5e918d2" and len({r["id"] for r in rows}) == len(rows)
