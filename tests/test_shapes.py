"""Texts of one shape share a tree, and files' rows are made where the files are parsed."""

import pytest
from conftest import SF
from test_code import SAMPLES
from test_growth import figures

from lodestar.operators import property_graph as G
from lodestar.operators import syntax as X
from lodestar.plans import catalogue, roles

MORE = [*SAMPLES, roles.SCRIPT, roles.BASE, "", "  // only\n", "#!/bin/x\na()", "a = b / c; d = /x/;", "return1 = x\ny = 2", "return\nx", "let s = 'a', n = 0x1F; // b", "rested(1);\nx\n++y"]


def shown(n):
    return (n.type, n.start, n.end, n.named, [shown(c) for c in n.children], sorted((k, f.type, f.start) for k, f in n.fields.items()))


def test_a_reader_reads_as_the_parser():
    reader = X.Reader()
    # longer names, other numbers and more space keep a shape; each text is met twice
    texts = [t for s in MORE for t in (s, "  " + s.replace("foo", "foobar"), s.replace(" a", "  abc").replace("1", "12"), s.replace(" ", "\n"), s)]
    for t in texts:
        try:
            want = shown(X.parse(t))
        except SyntaxError:
            with pytest.raises(SyntaxError):
                reader.read(t)
            continue
        got = reader.read(t)
        assert shown(got.root) == want and [n.start for n in got.nodes] == [n.start for n in X.parse(t).walk()]
    assert 0 < len(reader.shapes) < len(texts)


def test_rows_of_a_shape_are_those_of_each_file():
    reader = X.Reader()
    for i in range(3):
        for text in (roles.SCRIPT.replace("{k}", str(9 + i)).replace("{n}", str(10**i)).replace("{s}", "7"), *SAMPLES):
            name = f"src/{i}.ts"
            for what in ("syntax", "control", "entry", "data", "definitions", "imports", "calls", "heritage"):
                assert getattr(G.File(name, text, reader), what)() == getattr(G.File(name, text), what)()


def test_targets():
    got = [G.resolved(f, m) for f, m in (("src/a.ts", "./b"), ("src/a.ts", "../lib/./c"), ("a.ts", "../../x"), ("/r/a.ts", "../b"), ("src/a.ts", "react"))]
    assert got == ["src/b", "lib/c", "../../x", "/b", "react"]


@pytest.mark.parametrize("name", ["cfg_edges", "dfg_edges", "ast_edges", "dfg_use_lines", "cfg_ends"])
def test_rows_of_a_file_do_not_travel(spark, name):
    sent, got = figures(spark, lambda: catalogue.queries()[name](spark, SF).collect())
    assert sent < 12 * 2001 and len(got) >= 2001


def test_scripts_of_one_small_file_are_dealt_out(spark):
    assert roles.scripts(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
