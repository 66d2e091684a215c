"""An index of a source tree: built, kept up to date, and asked across the projects of a workspace."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import cut
from ..sources import repository as REPO
from ..streaming import changes as CH
from . import parsing as P
from .graph import Graph

#: Relations by the column that holds a symbol's or file's id, where a file's rows aren't told by its name.
OWNED = {"ast_contains": ("parent_id", "child_id"), "ast_extends_name": ("sub_id",), "ast_implements_name": ("sub_id",)}


def build(spark: SparkSession, tree: str, root: str | None = None, dim: int = 256, overwrite: bool = True, fallback: str = "text-only", bits: int = 8) -> dict:
    """The index of a tree in root: nine tables and the metadata, which is returned. Without overwrite rows are added: chunks by content, refs by id."""
    root = root or f"{tree}/{REPO.INDEX_FOLDER}"
    old = REPO.read_meta(root)
    dim = dim if overwrite or not old else old.get("dim", dim)
    tables = P.index_rows(cut(P.parse_sources(REPO.scan_tree(spark, tree), fallback)), dim, bits)
    write(spark, tables, root, overwrite or old is None)
    counts = {r["lang"]: (r["chunks"], r["refs"]) for r in added(tables).collect()}  # a row a language
    return REPO.write_meta(root, dim=dim, languages=sorted(counts), commit_hash=REPO.head(tree), scan_root=tree, chunks_added=sum(c for c, _ in counts.values()), refs_added=sum(r for _, r in counts.values()))


def added(tables: dict[str, DataFrame]) -> DataFrame:
    """lang, chunks, refs: what tables bring."""
    count = lambda t, name: tables[t].groupBy("lang").agg(F.count(F.lit(1)).alias(name))
    return count("chunks", "chunks").join(count("refs", "refs"), "lang", "full").na.fill(0)


#: What tells the rows of each table apart.
KEYS = {"chunks": ["lang", "content_hash"], "refs": ["lang", "ref_id"], "ast_file": ["file_id"], "ast_symbol": ["ref_id"]}


def write(spark: SparkSession, tables: dict[str, DataFrame], root: str, overwrite: bool) -> None:
    if overwrite:
        REPO.save(tables, root)
        return
    for name, new in tables.items():
        stored = REPO.load(spark, root, name)
        keys = KEYS.get(name, new.columns)
        REPO.save({name: new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").select(*new.columns)}, root, "append")


def graph(spark: SparkSession, root: str) -> Graph:
    load = lambda n: REPO.load(spark, root, n)
    return Graph(load("ast_symbol"), load("ast_file"), load("ast_contains"), load("ast_ref_name"), load("ast_call_name"))


def updated(tables: dict[str, DataFrame], changed: DataFrame, new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The index's tables after a batch of changes (status, path, old_path); new: the tables of the changed files' contents.

    Rows of touched files go: by file, or by the ids of their symbols and files. Chunks stay, and new ones are added."""
    gone = CH.touched(changed)
    ids = tables["ast_symbol"].join(gone, "file").select(F.col("ref_id").alias("id")).union(gone.select(T.file_id(F.col("file"))))
    out = {}
    for name, old in tables.items():
        if name == "chunks":
            out[name] = old.unionByName(CH.missing_chunks(new[name], old).select(*old.columns))
            continue
        kept = old.join(gone, "file", "left_anti") if "file" in old.columns else old
        for column in OWNED.get(name, ()):
            kept = kept.join(ids.select(F.col("id").alias(column)), column, "left_anti")
        out[name] = kept.select(*old.columns).unionByName(new[name].select(*old.columns))
    return out


def update(spark: SparkSession, tree: str, root: str | None = None, staged: bool = False, batch: DataFrame | None = None) -> dict:
    """The index of a tree after its changes, or a batch of them; returns what was processed and added by language."""
    root = root or f"{tree}/{REPO.INDEX_FOLDER}"
    changed = cut(batch if batch is not None else REPO.changes(spark, tree, staged))
    rule, meta = REPO.rules(tree), REPO.read_meta(root) or {}
    wanted = changed.filter(REPO.wanted(F.col("path"), rule["ai_ignore"], rule["include"], rule["vcs_ignore"]) | (F.col("status") == "D"))
    new = P.index_rows(cut(P.parse_sources(REPO.contents(spark, tree, wanted, staged))), meta.get("dim", 256))
    old = {name: REPO.load(spark, root, name).select(*new[name].columns) for name in REPO.TABLES}
    after = {name: cut(df) for name, df in updated(old, changed, new).items()}
    REPO.save(after, root)
    counts = [r.asDict() for r in added(new).orderBy("lang").collect()]
    REPO.write_meta(root, languages=[c["lang"] for c in counts], commit_hash=meta.get("commit_hash"))
    return {"processed": changed.count(), "added": counts}


def ready(spark: SparkSession, tree: str) -> str:
    """present, unpacked or built: how a tree came by an index that is whole."""
    root = f"{tree}/{REPO.INDEX_FOLDER}/index"
    if os.path.isdir(root):
        how = "present"
    elif os.path.exists(f"{root}.tar.gz"):
        REPO.unpack(f"{root}.tar.gz", root)
        how = "unpacked"
    else:
        how = "built"
    if how == "built" or not REPO.check_index(root, REPO.TABLES)["ok"]:
        build(spark, tree, root)
        how = how if how == "unpacked" and REPO.check_index(root)["ok"] else "built"
    return how


def query_workspace(spark: SparkSession, manifest_root: str, xml: str, keyword: str, limit: int = 200) -> DataFrame:
    """project, lang and a ref's columns of symbols that hold keyword, in the order of the manifest's projects, at most limit."""
    projects = REPO.manifest_projects(spark.createDataFrame([(xml,)], "xml string")).collect()  # a row a project
    out = None
    like = "%" + T.like_escaped(keyword) + "%"
    for pos, p in enumerate(projects):
        folder, kind = REPO.acquire(manifest_root, p["name"], p["path"], p["url"], p["revision"])
        ready(spark, folder)
        found = REPO.load(spark, f"{folder}/{REPO.INDEX_FOLDER}/index", "refs").filter(F.col("symbol").ilike(like))
        project = F.struct(F.lit(p["name"]).alias("name"), F.lit(p["path"]).alias("path"), F.lit(folder).alias("root"), F.lit(kind).alias("source"))
        found = found.select(F.lit(pos).alias("_at"), project.alias("project"), *REFS)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "project struct<name:string,path:string,root:string,source:string>, lang string, ref_id string, file string, symbol string, kind string, signature string, start_line int, end_line int")
    return out.orderBy("_at", "lang", "file", "start_line", "ref_id").limit(limit).drop("_at")


REFS = ["lang", "ref_id", "file", "symbol", "kind", "signature", "start_line", "end_line"]
