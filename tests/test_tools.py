"""The tools on a small repository, from its index to a workspace."""

import json
import os
import subprocess

import pytest

from lodestar import tools
from lodestar.operators import indexing as I
from lodestar.sources import repository as REPO

FILES = {
    "src/service.ts": "import { helloWorld } from './hello';\nexport class Service extends Base implements Runner {\n  run(name: string) {\n    return helloWorld(name);\n  }\n}\n",
    "src/hello.ts": "export function helloWorld(name: string) {\n  return greet(name);\n}\nfunction greet(name: string) {\n  return name;\n}\n",
    "README.md": "# Title\n\n## Part\ntext\n", "conf.yml": "a: 1\nb: 2\n", "node_modules/x.js": "function no() {}\n", "gen/made.py": "def made():\n    return made()\n", "notes.txt": "no\n",
}


def git(at, *args):
    subprocess.run(["git", "-C", str(at), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def tree(at, files):
    for name, text in files.items():
        os.makedirs(os.path.dirname(f"{at}/{name}"), exist_ok=True)
        with open(f"{at}/{name}", "w") as f:
            f.write(text)
    if not os.path.exists(f"{at}/.git"):
        git(at, "init", "-q")
    git(at, "add", "-A")
    git(at, "commit", "-qm", "x", "--allow-empty")


@pytest.fixture(scope="module")
def repo(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("repo"))
    tree(at, FILES | {".gitignore": "gen/\n/.lodestar/\n", ".aiinclude": "gen/**\n"})
    assert tools.call(spark, "index", path=at, overwrite=True)["ok"]
    return at


def ask(spark, verb, at, /, **given):
    out = tools.call(spark, verb, path=at, **given)
    assert out["ok"], out
    return out


def test_index_and_search(spark, repo):
    meta = ask(spark, "get_repo", repo)["meta"]
    assert meta["languages"] == ["markdown", "python", "ts", "yaml"] and meta["dim"] == 256 and meta["refs_added"] == 9
    assert ask(spark, "check_index", repo)["index"]["ok"] and ask(spark, "check_index", repo)["index"]["warnings"] == []
    names = lambda out: {r["symbol"] for r in out["rows"]}
    assert names(ask(spark, "search_symbols", repo, query="hello", case_insensitive=True, lang="all")) == {"helloWorld"}
    assert names(ask(spark, "search_symbols", repo, query="gr*t")) == {"greet"}
    assert [r["file"] for r in ask(spark, "query_files", repo, pattern="*.ts", lang="all")["rows"]] == ["src/hello.ts", "src/service.ts"]
    hits = ask(spark, "semantic_search", repo, query="greet name", topk=3)["hits"]
    assert len(hits) == 3 and "src/hello.ts:4:greet" in hits[0]["refs"] and hits[0]["score"] >= hits[1]["score"]


def test_graph_verbs(spark, repo):
    rows = lambda verb, /, **k: ask(spark, verb, repo, **k)["rows"]
    assert [r["name"] for r in rows("graph_find", prefix="SERV", lang="ts")] == ["Service"]
    assert {r["name"] for r in rows("graph_children", id="src/hello.ts", as_file=True)} == {"helloWorld", "greet"}
    assert {r["from_name"] for r in rows("graph_callers", name="greet")} == {"helloWorld"} and {r["ref_kind"] for r in rows("graph_refs", name="helloworld")} == {"call"}
    assert {r["callee_name"] for r in rows("graph_callees", name="run")} == {"helloWorld"}
    down = rows("graph_chain", name="run", max_depth=2)
    assert [(r["caller_name"], r["callee_name"], r["depth"]) for r in down] == [("run", "helloWorld", 1), ("helloWorld", "greet", 2)]
    up = rows("graph_chain", name="greet", direction="upstream", lang="all", max_depth=2)
    assert {(r["caller_name"], r["depth"]) for r in up} == {("helloWorld", 1), ("run", 2)}
    assert ask(spark, "graph_query", repo, query="select name from ast_symbol where name = :n", params={"n": "run"})["rows"] == [{"name": "run"}]
    made = ask(spark, "repo_map", repo, max_files=2)
    assert len(made["files"]) == 2 and "ƒ" in made["formatted"]


def test_files(spark, repo):
    assert ask(spark, "list_files", repo, pattern="src/*")["files"] == ["src/hello.ts", "src/service.ts"]
    assert ask(spark, "read_file", repo, file="src/hello.ts", start_line=4, end_line=4)["text"] == "     4→function greet(name: string) {"
    assert tools.call(spark, "read_file", path=repo, file="../x")["error"]["code"] == "HANDLER_ERROR"


@pytest.mark.parametrize("name, given, code", [("nothing", {}, "TOOL_NOT_FOUND"), ("search_symbols", {}, "VALIDATION_ERROR"), ("search_symbols", {"query": "x", "limit": 0}, "VALIDATION_ERROR"), ("graph_find", {"prefix": "a", "lang": "cobol"}, "VALIDATION_ERROR"), ("check_index", {"odd": 1}, "VALIDATION_ERROR")])
def test_refusals(spark, name, given, code):
    assert tools.call(spark, name, path="/nowhere", **given)["error"]["code"] == code


def test_pack_and_unpack(spark, repo):
    archive = ask(spark, "pack_index", repo)["archive"]
    first = open(archive, "rb").read()
    assert open(ask(spark, "pack_index", repo)["archive"], "rb").read() == first
    ask(spark, "unpack_index", repo)
    assert ask(spark, "check_index", repo)["index"]["ok"]
    with open(archive, "wb") as f:
        f.write(b"broken")
    assert not tools.call(spark, "unpack_index", path=repo)["ok"] and ask(spark, "check_index", repo)["index"]["ok"]


def test_update_is_a_rebuild(spark, repo, tmp_path):
    at = str(tmp_path / "r")
    tree(at, FILES | {".gitignore": "/.lodestar/\n"})
    ask(spark, "rebuild_index", at)
    git(at, "mv", "src/hello.ts", "src/moved.ts")
    with open(f"{at}/src/service.ts", "a") as f:
        f.write("export function added() { return helloWorld('x'); }\n")
    os.remove(f"{at}/conf.yml")
    git(at, "add", "-A")
    done = ask(spark, "update_index", at, staged=True)
    assert done["processed"] == 3
    load = lambda n: sorted(map(str, REPO.load(spark, f"{at}/{REPO.INDEX_FOLDER}/index", n).drop("lang").collect()))
    after = {n: load(n) for n in REPO.TABLES if n != "chunks"}
    git(at, "commit", "-qm", "y")
    ask(spark, "rebuild_index", at)
    for n, rows in after.items():
        assert rows == load(n), n


def test_rows_are_added_once(spark, repo):
    n = REPO.load(spark, f"{repo}/{REPO.INDEX_FOLDER}/index", "refs").count()
    ask(spark, "index", repo)
    assert REPO.load(spark, f"{repo}/{REPO.INDEX_FOLDER}/index", "refs").count() == n


def test_workspace(spark, tmp_path):
    manifests = str(tmp_path / ".repo/manifests")
    os.makedirs(manifests)
    for name in ("project-a", "project-b"):
        tree(str(tmp_path / name), {"src/Main.java": f"class {name.replace('-', '').title()} {{\n  void greet() {{\n  }}\n}}\n"})
    xml = f'<manifest><remote name="o" fetch="{tmp_path}/"/><default remote="o"/><project name="project-a" path="project-a"/><project name="project-b" path="project-b"/></manifest>'
    rows = I.query_workspace(spark, manifests, xml, "GREET").collect()
    assert [(r["project"]["path"], r["project"]["source"], r["symbol"]) for r in rows] == [("project-a", "workspace", "greet"), ("project-b", "workspace", "greet")]
    assert I.query_workspace(spark, manifests, xml, "projectb", 1).first()["project"]["name"] == "project-b"
    os.rename(tmp_path / "project-b", tmp_path / "origin-b")
    moved = xml.replace('name="project-b" path', 'name="origin-b" path')
    assert {r["project"]["source"] for r in I.query_workspace(spark, manifests, moved, "greet").collect()} == {"workspace", "cloned"}
    assert {r["project"]["source"] for r in I.query_workspace(spark, manifests, moved, "greet").collect()} == {"workspace", "cache"}


def test_graph_as_json(spark, repo, tmp_path):
    at = f"{repo}/{REPO.INDEX_FOLDER}/index"
    t = {n: REPO.load(spark, at, n) for n in ("ast_symbol", "ast_contains")}
    REPO.export_graph(t, str(tmp_path / "j"))
    back = REPO.import_graph(spark, str(tmp_path / "j"), {n: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) for n, df in t.items()})
    for n in t:
        assert sorted(map(str, back[n].collect())) == sorted(map(str, t[n].collect()))


def test_warnings_and_metadata(spark, tmp_path):
    root = str(tmp_path / "i")
    assert REPO.check_index(root)["problems"][0] == "missing_metadata"
    REPO.write_meta(root, languages=["ts"], commit_hash="a" * 40)
    assert REPO.write_meta(root, languages=["go"])["languages"] == ["go", "ts"]
    tree(str(tmp_path / "t"), {"a.py": "x = 1\n"})
    assert REPO.check_index(root, [], str(tmp_path / "t"))["warnings"][0].startswith("commit_mismatch:aaaaaaa:")
    assert json.load(open(f"{root}/meta.json"))["index_schema_version"] == REPO.SCHEMA_VERSION
    assert REPO.track_archive(str(tmp_path / "t"), "*.gz") in (True, False)
