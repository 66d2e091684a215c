"""The engine's commands as tools with named parameters, defaults and JSON results; python -m lodestar calls them.

A tool returns {"ok": true, ...} or {"ok": false, "error": {"name", "message", "code"}} with the codes
TOOL_NOT_FOUND, VALIDATION_ERROR and HANDLER_ERROR.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import graph as G
from .operators import indexing as I
from .operators import search as S
from .sources import repository as REPO

LANGUAGES = ["auto", "all", *T.PREFERRED]


class Refused(ValueError):
    """A parameter that a tool doesn't take."""


@dataclass(frozen=True)
class Tool:
    run: Callable
    defaults: dict


TOOLS: dict[str, Tool] = {}


def tool(name: str, /, **defaults):
    """Register a tool; a default of ... must be given by the caller."""

    def add(f):
        TOOLS[name] = Tool(f, {"path": ...} | defaults)
        return f

    return add


def checked(name: str, given: dict) -> dict:
    defaults = TOOLS[name].defaults
    if unknown := sorted(set(given) - set(defaults)):
        raise Refused(f"unknown parameters: {', '.join(unknown)}")
    args = defaults | given
    if missing := sorted(k for k, v in args.items() if v is ...):
        raise Refused(f"missing parameters: {', '.join(missing)}")
    for k, v in args.items():
        want = defaults[k]
        if isinstance(want, bool) and not isinstance(v, bool) or isinstance(want, int) and not isinstance(want, bool) and (not isinstance(v, int) or v < (1 if k in ("limit", "dim", "max_depth") else 0)):
            raise Refused(f"{k}: {v!r}")
    if args.get("lang", "auto") not in LANGUAGES:
        raise Refused(f"lang: {args['lang']!r}")
    if args.get("mode") not in (None, "substring", "prefix", "wildcard", "regex", "fuzzy"):
        raise Refused(f"mode: {args['mode']!r}")
    return args


def call(spark: SparkSession, name: str, /, **given) -> dict:
    """The result of a tool, or what went wrong."""
    if name not in TOOLS:
        return _error("ToolNotFound", f"no tool {name!r}", "TOOL_NOT_FOUND")
    try:
        args = checked(name, given)
    except Refused as e:
        return _error("Refused", str(e), "VALIDATION_ERROR")
    try:
        return {"ok": True} | TOOLS[name].run(spark, **args)
    except Exception as e:  # noqa: BLE001 - a tool's failure is its result
        return _error(type(e).__name__, str(e), "HANDLER_ERROR")


def _error(name: str, message: str, code: str) -> dict:
    return {"ok": False, "error": {"name": name, "message": message, "code": code}}


def _rows(df: DataFrame) -> list[dict]:
    """Rows of a limited result."""
    return [json.loads(r) for r in df.toJSON().collect()]


def _root(path: str) -> str:
    return f"{path}/{REPO.INDEX_FOLDER}/index"


def _langs(path: str, selector: str) -> list[str]:
    return S.select_languages((REPO.read_meta(_root(path)) or {}).get("languages", []), selector)


def _lang(path: str, selector: str) -> str | None:
    return None if selector == "all" else next(iter(_langs(path, selector)), None)


@tool("index", dim=256, overwrite=False)
def index(spark, path, dim, overwrite):
    return {"meta": I.build(spark, path, _root(path), dim, overwrite)}


@tool("rebuild_index", dim=256, overwrite=True)
def rebuild_index(spark, path, dim, overwrite):
    return index(spark, path, dim, overwrite)


@tool("update_index", staged=False)
def update_index(spark, path, staged):
    return I.update(spark, path, _root(path), staged)


@tool("search_symbols", query=..., mode=None, case_insensitive=False, limit=50, max_candidates=1000, lang="auto")
def search_symbols(spark, path, query, mode, case_insensitive, limit, max_candidates, lang):
    rows = REPO.load(spark, _root(path), "refs", _langs(path, lang))
    rows = rows.filter(S.coarse(F.col("symbol"), query, mode, case_insensitive))
    near = S.cap_per(rows, "lang", ["symbol", "ref_id"], max_candidates)
    return {"rows": _rows(S.search_symbols(near, query, mode, case_insensitive, limit, ["symbol", "file", "start_line", "ref_id"]))}


@tool("query_files", pattern=..., mode=None, case_insensitive=False, limit=50, lang="auto")
def query_files(spark, path, pattern, mode, case_insensitive, limit, lang):
    files = REPO.load(spark, _root(path), "refs", _langs(path, lang)).select("file", "lang").distinct()
    return {"rows": _rows(S.search_files(files, pattern, mode, case_insensitive, limit))}


@tool("semantic_search", query=..., topk=10, lang="all", with_refs=True)
def semantic_search(spark, path, query, topk, lang, with_refs):
    meta = REPO.read_meta(_root(path)) or {}
    hits = S.semantic_search(REPO.load(spark, _root(path), "chunks"), query, topk, _langs(path, lang), meta.get("dim", 256))
    if with_refs:
        refs = REPO.load(spark, _root(path), "refs").withColumn("ref", F.concat_ws(":", "file", "start_line", "symbol"))
        hits = S.attach(hits, refs, ["lang", "content_hash"], ["file", "start_line", "ref_id"], "ref")
    return {"hits": _rows(hits.orderBy(F.col("score").desc(), "lang", "content_hash"))}


@tool("repo_map", max_files=20, max_symbols=5, depth=5, max_nodes=5000, wiki="")
def repo_map(spark, path, max_files, max_symbols, depth, max_nodes, wiki):
    pages = REPO.wiki_pages(spark, wiki) if wiki else None
    made = G.repo_map(I.graph(spark, _root(path)), max_files, max_symbols, depth, max_nodes, pages)
    return {"files": _rows(made), "formatted": G.shown_map(made)}


@tool("graph_query", query=..., params=None)
def graph_query(spark, path, query, params):
    out = I.graph(spark, _root(path)).sql(spark, query, **(params or {}))
    return {"headers": out.columns, "rows": _rows(out)}


@tool("graph_find", prefix=..., lang="auto", limit=50)
def graph_find(spark, path, prefix, lang, limit):
    return {"rows": _rows(G.find(I.graph(spark, _root(path)), prefix, _lang(path, lang), limit))}


@tool("graph_children", id=..., as_file=False, limit=200)
def graph_children(spark, path, id, as_file, limit):
    g = I.graph(spark, _root(path))
    if as_file:
        id = spark.range(1).select(T.file_id(F.lit(id)).alias("i")).first()["i"]
    return {"rows": _rows(G.children(g, id, limit))}


@tool("graph_refs", name=..., lang="auto", limit=200)
def graph_refs(spark, path, name, lang, limit):
    return {"rows": _rows(G.references(I.graph(spark, _root(path)), name, _lang(path, lang), limit))}


@tool("graph_callers", name=..., lang="auto", limit=200)
def graph_callers(spark, path, name, lang, limit):
    return {"rows": _rows(G.callers(I.graph(spark, _root(path)), name, _lang(path, lang), limit))}


@tool("graph_callees", name=..., limit=200)
def graph_callees(spark, path, name, limit):
    return {"rows": _rows(G.callees(I.graph(spark, _root(path)), name, limit))}


@tool("graph_chain", name=..., lang="auto", direction="downstream", max_depth=3, min_name_len=1, limit=500)
def graph_chain(spark, path, name, lang, direction, max_depth, min_name_len, limit):
    g = I.graph(spark, _root(path))
    langs = _langs(path, lang)
    found = None
    for one in langs:
        part = G.chain(g, name, one, max_depth, direction == "upstream", min_name_len)
        found = part if found is None else found.union(part)
    return {"rows": _rows(G.first_rows(found, limit, "depth", "caller_id", "callee_id")) if found is not None else []}


@tool("check_index")
def check_index(spark, path):
    return {"index": REPO.check_index(_root(path), REPO.TABLES, path)}


@tool("get_repo")
def get_repo(spark, path):
    return {"root": path, "index": _root(path), "head": REPO.head(path), "meta": REPO.read_meta(_root(path))}


@tool("pack_index", lfs=False)
def pack_index(spark, path, lfs):
    archive = REPO.pack(_root(path), f"{_root(path)}.tar.gz")
    return {"archive": archive, "tracked": REPO.track_archive(path, f"{REPO.INDEX_FOLDER}/*.tar.gz") if lfs else False}


@tool("unpack_index")
def unpack_index(spark, path):
    return {"index": REPO.unpack(f"{_root(path)}.tar.gz", _root(path))}


@tool("list_files", pattern="**/*", limit=500)
def list_files(spark, path, pattern, limit):
    return {"files": [r["file"] for r in REPO.list_files(REPO.scan(spark, path), pattern, limit).collect()]}


@tool("read_file", file=..., start_line=1, end_line=200)
def read_file(spark, path, file, start_line, end_line):
    return {"file": file, "text": "\n".join(r["shown"] for r in REPO.read_lines(REPO.scan(spark, path), file, start_line, end_line).collect())}


@tool("query_workspace", manifest=..., keyword=..., limit=200)
def query_workspace(spark, path, manifest, keyword, limit):
    with open(manifest, encoding="utf-8") as f:
        return {"rows": _rows(I.query_workspace(spark, path, f.read(), keyword, limit))}
