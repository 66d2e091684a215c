import os

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import vectors as V
from lodestar.operators import parsing as P
from lodestar.operators import retrieval as R
from lodestar.operators import search as S
from lodestar.sources import repository as REPO
from lodestar.streaming import changes as CH


@pytest.mark.parametrize("query, mode, case, rows, want", [
    ("get*repo", None, True, ["get_repo", "getRepo", "set_repo"], ["getRepo", "get_repo"]),
    ("get_", "prefix", False, ["get_repo", "forget_repo"], ["get_repo"]),
    ("^get.*repo$", "regex", True, ["get_repo", "getRepo", "set_repo"], ["getRepo", "get_repo"]),
    ("gtrp", "fuzzy", False, ["get_repo", "set_repo"], ["get_repo"]),
    ("(", "regex", False, ["a("], []),
])
def test_symbol_search(spark, query, mode, case, rows, want):
    found = S.search_symbols(spark.createDataFrame([(r,) for r in rows], "symbol string"), query, mode, case)
    assert sorted(r["symbol"] for r in found.collect()) == want


def test_modes_and_query_words():
    assert S.mode_of("get*repo") == "wildcard" and S.mode_of("getRepo") == "substring"
    assert T.strip_keywords("export const  MY_VAR") == "MY_VAR" and T.strip_keywords("async function f") == "f"
    assert T.coarse_token("a.b handle_it x") == "handle_it"
    assert S.select_languages(["ts", "go"], "auto") == ["ts"] and S.select_languages([], "java") == ["java"]


def test_fuzzy_score(spark):
    r = spark.range(1).select(T.fuzzy_score(F.lit("get_repo"), "gtrp").alias("a"), T.fuzzy_score(F.lit("set_repo"), "gtrp").alias("b"), T.fuzzy_score(F.lit("abc"), "ab").alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (4, -1, 3)


def test_codes_round_halves_up(spark):
    r = spark.range(1).select(V.quantise(F.array(F.lit(-2.5), F.lit(127.0), F.lit(0.5)))["q"].alias("q")).first()
    assert r["q"] == [-2, 127, 1]


def test_retrieval_examples(spark):
    q = spark.createDataFrame([("commit history for parseFile",), ("callers of authenticateUser",), ("auth cfg",)], "q string")
    got = q.select("q", R.classify(F.col("q")).alias("c"), R.expand(F.col("q")).alias("e")).collect()
    assert got[0]["c"]["primary"] == "historical" and got[0]["c"]["confidence"] > 0.3 and got[1]["c"]["primary"] == "structural"
    assert {"authentication", "configuration"} <= set(got[2]["e"])


def test_source_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("class A:\n    def run(self):\n        return go()\n")
    (tmp_path / "src/broken.ts").write_text("??")
    (tmp_path / "node_modules/x.js").write_text("function x() {}")
    files = REPO.scan(spark, str(tmp_path))
    assert sorted(r["file"] for r in files.collect()) == ["src/a.py", "src/broken.ts"]
    tables = P.index_rows(P.parse_sources(files))
    assert set(tables) == set(REPO.TABLES)
    assert {(r["symbol"], r["kind"]) for r in tables["refs"].collect()} == {("A", "class"), ("run", "method"), ("broken.ts", "document")}
    assert [r["callee_name"] for r in tables["ast_call_name"].collect()] == ["go"]
    root = str(tmp_path / "index")
    REPO.save({k: tables[k] for k in ("chunks", "refs")}, root)
    assert REPO.check_index(root)["problems"] == ["missing_metadata"]
    REPO.write_meta(root, dim=256)
    assert REPO.check_index(root)["ok"] and REPO.load(spark, root, "refs", ["python"]).count() == 2
    a, b = REPO.pack(root, str(tmp_path / "1.tar.gz")), REPO.pack(root, str(tmp_path / "2.tar.gz"))
    assert open(a, "rb").read() == open(b, "rb").read()
    REPO.unpack(a, str(tmp_path / "again"))
    assert sorted(os.listdir(tmp_path / "again")) == sorted(os.listdir(root))


def test_changes():
    assert REPO.parse_changes("M\0a\0R100\0old\0new\0D\0b\0") == [("D", "b", None), ("M", "a", None), ("R", "new", "old")]
    assert P.heritage("class B<T> extends A<X> implements C<D, E>, F {") == (["A<X>"], ["C<D, E>", "F"])


def test_stream_of_changes_is_a_rebuild(spark, tmp_path):
    schema = "status string, path string, old_path string"
    before = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "file string, v int")
    after = spark.createDataFrame([("a", 2), ("b", 2), ("d", 2)], "file string, v int")
    spark.createDataFrame([("M", "a", None), ("R", "d", "c")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    state = [before]

    def step(batch, _):
        state[0] = spark.createDataFrame(CH.apply(state[0], batch, after).collect(), "file string, v int")

    CH.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), step, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, state[0].collect())) == [("a", 2), ("b", 1), ("d", 2)]


@pytest.mark.parametrize("pattern, ok", [("a+", True), ("(", False), ("(?P<n>a)", False), (r"\p{L}+", True)])
def test_the_engine_judges_a_regex(spark, pattern, ok):
    assert S.valid_regex(pattern) is ok
    rows = spark.createDataFrame([("é",), ("a",)], "symbol string")
    assert S.search_symbols(rows, pattern, "regex").count() == (2 if "p{L}" in pattern else 1 if ok else 0)


def test_file_predicates(spark):
    files = spark.createDataFrame([("a/b_c.py",), ("a/bxc.py",), ("a/B%c.ts",)], "file string")
    found = lambda *a, **k: sorted(r["file"] for r in S.search_files(files, *a, **k).collect())
    assert found("b_c") == ["a/b_c.py"] and found("a/b_*") == ["a/b_c.py"] and found("A/b", "prefix", ignore_case=True) == ["a/B%c.ts", "a/b_c.py", "a/bxc.py"] and found("%") == ["a/B%c.ts"]
    assert T.like_pattern("a*b?_%") == r"a%b_\_\%"


def test_fallbacks_and_gate(spark):
    files = spark.createDataFrame([("a/x.ts", "???\n" * 120, 10), ("big.md", "# H\n" + "y" * 20_000, 2_000_000), (".github/workflows/c.yml", "- x", 3), ("d.yml", "# no", 4), ("e.yml", "a: 1\nb:\n  c: 2", 9)], "file string, content string, size long")
    got = lambda f: sorted((r["file"], r["name"], r["kind"], r["start_line"], r["end_line"]) for r in P.parse_sources(files, f).filter("row = 'symbol'").collect())
    rest = [(".github/workflows/c.yml", "c.yml", "document", 1, 1), ("big.md", "H", "section", 1, 2), ("d.yml", "d.yml", "node", 1, 1), ("e.yml", "a", "node", 1, 1), ("e.yml", "b", "node", 2, 2), ("e.yml", "c", "node", 3, 3)]
    assert got("skip") == rest
    assert got("text-only") == sorted([*rest, ("a/x.ts", "x.ts", "document", 1, 121)])
    assert got("line-chunk") == sorted([*rest, ("a/x.ts", "x.ts:1-100", "document", 1, 100), ("a/x.ts", "x.ts:101-121", "document", 101, 121)])
    assert P.gated is not None and files.select(F.length(P.gated(F.col("content"), F.col("size")))).collect()[1][0] == 10_000


def test_declarations_end_where_they_do():
    go = P.parse_braces("type X int\nfunc f() {\n  g(1)\n}\ntype S struct {\n  A Foo\n}\nfunc (s S) M(\n  a int,\n) {\n}\n", "go")
    assert [(f[1], f[2], f[4], f[5]) for f in go if f[0] == "symbol"] == [("X", "class", 1, 1), ("f", "function", 2, 4), ("S", "class", 5, 7), ("M", "method", 8, 11)]
    java = P.parse_braces("public class E extends A<X> implements B<C, D>, F {\n  private int x = 1;\n  void run() {\n    greet();\n  }\n}\n", "java")
    assert [(f[1], f[2], f[3], f[6]) for f in java if f[0] == "symbol"] == [("E", "class", "class E", None), ("x", "field", "private int x = 1", 0), ("run", "method", "void run()", 0)]
    assert java[0][9:] == (["A<X>"], ["B<C, D>", "F"])


def test_forced_split_against_its_definition(spark):
    import random

    rng = random.Random(3)
    text = "\n".join(" ".join("w" for _ in range(rng.randrange(0, 30))) for _ in range(300))
    got = [tuple(r)[1:] for r in P.forced_split(spark.createDataFrame([("f", text)], "file string, content string"), max_tokens=100).collect()]
    counts, lines, start, end, want = [len(x.split()) for x in text.split("\n")], 300, 0, 0, []
    while True:
        end += 1  # a run has a line that the one before hasn't
        while end < lines and sum(counts[start : end + 1]) <= 100:
            end += 1
        want.append((len(want), start + 1, end, sum(counts[start:end])))
        if end == lines:
            break
        start = max(start + 1, end - 4)
    assert got == want


def test_rerank_by_model(spark):
    rows = spark.createDataFrame([(1, "auth service", 0.2), (2, "database pool", 0.9), (3, "auth", 0.5)], "id long, content string, score double")
    known = lambda q, c: F.when(c == "auth service", 0.9).when(c == "auth", 2.0).otherwise(0.1)
    got = R.rerank_by_model(rows, F.lit(" auth "), 2, (0.0, 1.0), score=known).orderBy("rank").collect()
    assert [(r["id"], r["model"], r["rank"]) for r in got] == [(1, 0.9, 1), (2, 0.1, 2)]
    assert R.rerank_by_model(rows, F.lit("  ")).count() == 0
    again = R.rerank_by_model(rows, F.lit("auth"), 3, (0.3, 0.7), score=known).orderBy("rank").collect()
    assert [(r["id"], round(r["final"], 6)) for r in again] == [(3, round(0.3 * 0.3 / 0.7 + 0.7, 6)), (1, 0.63), (2, 0.37)]


def test_last_of_repeated_candidates(spark):
    rows = spark.createDataFrame([("vector", 1, 0.1, "a", 1), ("vector", 1, 0.7, "b", 2), ("graph", 1, 0.4, "c", 3)], "source string, id long, score double, text string, at long")
    assert sorted((r["source"], r["text"]) for r in R.last_of_each(rows, "at").collect()) == [("graph", "c"), ("vector", "b")]


def test_fusion_of_the_fixture(spark):
    rows = spark.createDataFrame([("vector", "v1", 0.9, ""), ("graph", "g1", 0.4, ""), ("symbol", "s1", 0.7, "")], "source string, id string, score double, text string")
    assert R.fuse(rows, {"vector": 0.2, "graph": 0.5, "symbol": 0.3}).orderBy("rank").first()["source"] == "graph"


def test_pooling_and_model_input(spark):
    import numpy as np

    from lodestar.operators import embedders as E

    assert E.mean_pool(np.array([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]), np.array([1, 1, 0])).tolist() == [2.0, 3.0]
    assert E.mean_pool(np.ones((2, 3)), np.zeros(2)).tolist() == [0.0, 0.0, 0.0]
    r = spark.range(1).select(T.model_ids(F.lit("the authentication x"), {"the": 5}, 6).alias("i"), E.semantic(F.lit("auth x"), 48, path="/no/model").alias("v")).first()
    assert r["i"] == [101, 5, 100, 100, 100, 102] and len(r["v"]) == 48 and 0.9 < sum(x * x for x in r["v"]) < 1.1


def test_wiki_links_and_a_shown_map(spark):
    from lodestar.operators import graph as G

    files = spark.createDataFrame([("src/core.ts",), ("src/util.ts",), ("src/none.ts",)], "file string")
    symbols = spark.createDataFrame([("src/util.ts", "parseAll"), ("src/none.ts", "abc")], "file string, name string")
    pages = spark.createDataFrame([("a.md", "about parseall and abc"), ("core-notes.md", "x"), ("z-core.md", "core")], "page string, content string")
    assert {r["file"]: r["wiki"] for r in G.wiki_links(files, symbols, pages).collect()} == {"src/core.ts": "core-notes.md", "src/util.ts": "a.md"}
    row = spark.createDataFrame([("a.ts", 0.12345, "w.md", [("f", "function", 3, 0.1), ("C", "class", 9, 0.02)])], "file string, rank double, wiki string, symbols array<struct<name:string,kind:string,start_line:int,rank:double>>")
    shown = G.shown_map(row)
    assert "a.ts (score: 12.35)\n   wiki: w.md\n   ƒ f [L3]\n   © C [L9]\n\n" in shown and G.shown_map(row.limit(0)) == "No symbols found to map."


def test_include_globs():
    assert REPO.include_globs(["a/x.ts"]) == ["a/x.ts"] and "gen/**/*.py" in REPO.include_globs(["gen"]) and "gen/**/*.md" in REPO.include_globs(["gen/**"])
