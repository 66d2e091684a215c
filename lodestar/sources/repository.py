"""Sources and sinks: source trees, ignore rules, manifests, index tables and archives."""

from __future__ import annotations

import gzip
import json
import os
import re
import shutil
import subprocess
import tarfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: What a scan takes, and folders that it leaves out.
EXTENSIONS = ["ts", "tsx", "js", "jsx", "java", "c", "h", "go", "py", "rs", "md", "mdx", "yml", "yaml"]
EXCLUDED = ["node_modules", ".git", ".repo", "dist", "target", "build", ".gradle"]
#: Where an index lives below its tree; never scanned.
INDEX_FOLDER = ".lodestar"
SCHEMA_VERSION = 3
TABLES = ["chunks", "refs", "ast_file", "ast_symbol", "ast_contains", "ast_extends_name", "ast_implements_name", "ast_ref_name", "ast_call_name"]


def scan(spark: SparkSession, root: str) -> DataFrame:
    """file (below root), content, size of the source files in a tree."""
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)
    below = F.regexp_replace(F.col("_metadata.file_path"), r"^\w+:/*(?=/)", "")
    prefix = root.rstrip("/") + "/"
    rows = raw.select(F.substr(below, F.instr(below, F.lit(prefix)) + len(prefix)).alias("file"), F.col("value").alias("content"), F.col("_metadata.file_size").alias("size"))
    return rows.filter(~excluded(F.col("file")))


def excluded(file: Column) -> Column:
    return file.rlike("(^|/)(" + "|".join(map(re.escape, [*EXCLUDED, INDEX_FOLDER])) + ")/")


def read_patterns(content: str, negated: bool = False) -> list[str]:
    """The patterns of an ignore file: without blanks and comments, a leading slash, and (unless negated) ! lines."""
    out = []
    for line in map(str.strip, content.splitlines()):
        if not line or line.startswith("#") or line.startswith("!") and not negated:
            continue
        line = line.lstrip("!").removeprefix("/")
        out.append(f"{line}**" if line.endswith("/") else line)
    return out


def any_of(file: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit |= file.rlike(T.glob_regex(p))
    return hit


def wanted(file: Column, ai_ignore: list[str], include: list[str], vcs_ignore: list[str]) -> Column:
    """The first rule that holds: ignored for AI, included, ignored by version control, else wanted."""
    return F.when(any_of(file, ai_ignore), False).when(any_of(file, include), True).when(any_of(file, vcs_ignore), False).otherwise(True)


def include_globs(patterns: list[str]) -> list[str]:
    """Globs of what include patterns bring in: a folder means its files of known suffixes."""
    ends, out = tuple(f".{e}" for e in EXTENSIONS), []
    for p in patterns:
        base = f"{p}/*" if p.endswith("**") else p if p.endswith(ends) else f"{p.rstrip('/')}/**/*"
        out += [base] if base.endswith(ends) else [f"{base}.{e}" for e in EXTENSIONS]
    return out


def selected(files: DataFrame, ai_ignore: list[str], vcs_ignore: list[str], include: list[str]) -> DataFrame:
    """What a full index takes of files (file, ...): those no rule ignores, and those that include patterns bring back from version control's."""
    kept = files.filter(~excluded(F.col("file")) & ~any_of(F.col("file"), ai_ignore))
    normal, back = kept.filter(~any_of(F.col("file"), vcs_ignore)), kept.filter(any_of(F.col("file"), include_globs(include)))
    return normal.union(back).dropDuplicates(["file"])


def rules(root: str, names: tuple[str, str, str] = (".aiignore", ".gitignore", ".aiinclude")) -> dict[str, list[str]]:
    """ai_ignore, vcs_ignore, include of a tree, from the files of these names in its root."""
    read = lambda n: open(f"{root}/{n}", encoding="utf-8").read() if os.path.exists(f"{root}/{n}") else ""
    return {"ai_ignore": read_patterns(read(names[0])), "vcs_ignore": read_patterns(read(names[1])), "include": read_patterns(read(names[2]), negated=True)}


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """file, content, size of what a full index of a tree takes."""
    return selected(scan(spark, root), **rules(root))


def _git(root: str, *args: str) -> str | None:
    """What git prints; None where it fails or isn't there."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace", check=False)
    except OSError:
        return None
    return done.stdout if done.returncode == 0 else None


def head(root: str) -> str | None:
    got = _git(root, "rev-parse", "HEAD")
    return got.strip() if got else None


CHANGES = "status string, path string, old_path string"


def changes(spark: SparkSession, root: str, staged: bool = False) -> DataFrame:
    """status, path, old_path of a tree's changes, staged ones or those of the work tree, sorted."""
    raw = _git(root, "diff", *(["--cached"] if staged else []), "--name-status", "-z", "--find-renames") or ""
    return spark.createDataFrame(parse_changes(raw), CHANGES)


def contents(spark: SparkSession, root: str, changed: DataFrame, staged: bool = False) -> DataFrame:
    """file, content of changed files that aren't deleted, as staged or in the work tree; unreadable ones are left out. A batch of changes is small."""
    out = []
    for r in changed.filter("status <> 'D'").select("path").distinct().collect():
        if staged:
            text = _git(root, "show", f":{r['path']}")
        else:
            try:
                text = open(f"{root}/{r['path']}", encoding="utf-8", errors="replace").read()
            except OSError:
                text = None
        if text is not None:
            out.append((r["path"], text))
    return spark.createDataFrame(out, "file string, content string")


def parse_changes(raw: str) -> list[tuple[str, str, str | None]]:
    """(status, path, old path) from a name-status listing with NUL separators, sorted."""
    parts, out, i = raw.split("\0"), [], 0
    while i < len(parts) - 1:
        status = parts[i][:1]
        if status == "R":
            out.append(("R", parts[i + 2], parts[i + 1]))
            i += 3
        else:
            if status in "AMD":
                out.append((status, parts[i + 1], None))
            i += 2
    return sorted(out, key=lambda x: (x[0], x[2] or "", x[1]))


def attributes(element: Column) -> Column:
    """map of an XML element's attributes."""
    keys = F.regexp_extract_all(element, F.lit(r'(\w+)\s*=\s*"([^"]*)"'), F.lit(1))
    return F.map_from_arrays(keys, F.regexp_extract_all(element, F.lit(r'(\w+)\s*=\s*"([^"]*)"'), F.lit(2)))


def manifest_projects(xml: DataFrame) -> DataFrame:
    """name, path, revision, fetch, url of the projects of manifests (column xml)."""
    elements = lambda tag, close: F.regexp_extract_all("xml", F.lit(rf"<{tag}\b([^>]*?){close}"), F.lit(1))
    m = xml.select(F.transform(elements("remote", "/>"), attributes).alias("remotes"), F.try_element_at(F.transform(elements("default", "/>"), attributes), F.lit(-1)).alias("def"), F.explode(F.transform(elements("project", "/?>"), attributes)).alias("p"))
    m = m.filter(F.col("p")["name"].isNotNull())
    remote = F.coalesce(F.col("p")["remote"], F.col("def")["remote"])
    fetch = F.try_element_at(F.filter("remotes", lambda r: r["name"] == remote), F.lit(-1))["fetch"]
    out = m.select(F.col("p")["name"].alias("name"), F.coalesce(F.col("p")["path"], F.col("p")["name"]).alias("path"), F.coalesce(F.col("p")["revision"], F.col("def")["revision"]).alias("revision"), fetch.alias("fetch"))
    return out.withColumn("url", clone_url(F.col("fetch"), F.col("name")))


def clone_url(fetch: Column, name: Column) -> Column:
    base = F.trim(fetch)
    slashed = F.when(base.endswith("/"), F.concat(base, name)).otherwise(F.concat(base, F.lit("/"), name))
    return F.when(base.contains("://") | ~base.contains(":"), slashed).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), name))


def save(tables: dict[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """Tables as Parquet, those with a language in a folder each."""
    for name, df in tables.items():
        w = df.write.mode(mode)
        (w.partitionBy("lang") if name in ("chunks", "refs") else w).parquet(f"{root}/{name}")


def load(spark: SparkSession, root: str, name: str, langs: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{root}/{name}")
    return df.filter(F.col("lang").isin(langs)) if langs else df


def read_meta(root: str) -> dict | None:
    try:
        with open(f"{root}/meta.json") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


def write_meta(root: str, **values) -> dict:
    """The index's metadata with values; languages are added to those known."""
    old = read_meta(root) or {}
    new = old | values | {"index_schema_version": SCHEMA_VERSION}
    if "languages" in values:
        new["languages"] = sorted({*old.get("languages", []), *values["languages"]})
    os.makedirs(root, exist_ok=True)
    with open(f"{root}/meta.json", "w") as f:
        json.dump(new, f, sort_keys=True)
    return new


def check_index(root: str, expected: list[str] = ("chunks", "refs"), tree: str | None = None) -> dict:
    """Whether an index folder has its metadata, version and tables; warnings where it is of another commit than the tree's."""
    problems, warnings, meta = [], [], read_meta(root)
    found = sorted(x for x in (os.listdir(root) if os.path.isdir(root) else []) if x in TABLES)
    if meta is None:
        problems.append("missing_metadata")
    elif meta.get("index_schema_version") != SCHEMA_VERSION:
        problems.append(f"schema_version_mismatch:{meta.get('index_schema_version')}")
    problems += [f"missing_table:{t}" for t in expected if t not in found]
    for lang in (meta or {}).get("languages", []):
        problems += [f"missing_table:{t}/{lang}" for t in ("chunks", "refs") if t in found and not os.path.isdir(f"{root}/{t}/lang={lang}")]
    commit = head(tree) if tree else None
    if meta and commit and meta.get("commit_hash") != commit:
        warnings.append(f"commit_mismatch:{meta['commit_hash'][:7]}:{commit[:7]}" if meta.get("commit_hash") else "commit_not_recorded")
    return {"ok": not problems, "problems": problems, "warnings": warnings, "expected": list(expected), "found": found, "hint": "" if not problems else "rebuild the index"}


def export_graph(tables: dict[str, DataFrame], root: str) -> None:
    """The graph's relations as JSON lines."""
    for name, df in tables.items():
        if name.startswith("ast_"):
            df.write.mode("overwrite").json(f"{root}/{name}")


def import_graph(spark: SparkSession, root: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Relations of exported JSON lines; schemas: a DDL for each."""
    return {name: spark.read.schema(ddl).json(f"{root}/{name}") for name, ddl in schemas.items()}


def track_archive(root: str, pattern: str) -> bool:
    """Whether large-file storage tracks a pattern now; nothing happens where it isn't installed."""
    return _git(root, "lfs", "version") is not None and _git(root, "lfs", "track", pattern) is not None


def pack(root: str, archive: str) -> str:
    """A tar.gz of a folder whose bytes depend on its content only; members go through one at a time."""
    with open(archive, "wb") as out, gzip.GzipFile(fileobj=out, mode="wb", mtime=0, filename="") as z, tarfile.open(fileobj=z, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for folder, names, files in os.walk(root):
            names.sort()
            for f in sorted(files):
                path = os.path.join(folder, f)
                info = tarfile.TarInfo(os.path.relpath(path, root))
                info.size = os.path.getsize(path)
                with open(path, "rb") as data:
                    tar.addfile(info, data)
    return archive


def unpack(archive: str, root: str) -> str:
    """The folder replaced by an archive's content, once that is there as a whole."""
    beside = f"{root.rstrip('/')}-{uuid.uuid4().hex}"
    try:
        with tarfile.open(archive) as tar:
            tar.extractall(beside, filter="data")
        shutil.rmtree(root, ignore_errors=True)
        os.rename(beside, root)
    finally:
        shutil.rmtree(beside, ignore_errors=True)
    return root


def acquire(manifest_root: str, name: str, path: str, fetch: str | None = None, revision: str | None = None) -> tuple[str, str]:
    """(folder, workspace, cache or cloned) of a manifest's project: beside the manifests, in their cache, or cloned into it."""
    workspace = os.path.dirname(os.path.dirname(os.path.abspath(manifest_root)))
    segment = re.sub(r"[^a-zA-Z0-9._-]+", "_", path or name)[:120]
    cache = f"{manifest_root}/{INDEX_FOLDER}/workspace-cache/{segment}"
    for folder, kind in ((f"{workspace}/{path}", "workspace"), (cache, "cache")):
        if os.path.exists(f"{folder}/.git"):
            break
    else:
        if not fetch:
            raise ValueError(f"no remote for project {name}")
        os.makedirs(os.path.dirname(cache), exist_ok=True)
        folder, kind = cache, "cloned"
        if _git(os.path.dirname(cache), "clone", "--quiet", fetch, cache) is None:
            raise ValueError(f"project {name} can't be cloned from {fetch}")
    if revision and _git(folder, "checkout", "--quiet", revision) is None:
        _git(folder, "checkout", "--quiet", "-f", f"origin/{revision}")
    return folder, kind


def wiki_pages(spark: SparkSession, folder: str) -> DataFrame:
    """page, content (in lower case) of a folder's Markdown pages but its index."""
    raw = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(folder)
    page = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)
    return raw.select(page.alias("page"), F.lower("value").alias("content")).filter("page <> 'index.md'")


def list_files(files: DataFrame, pattern: str = "**/*", limit: int = 500) -> DataFrame:
    return files.select("file").filter(F.col("file").rlike(T.glob_regex(pattern)) & ~excluded(F.col("file"))).distinct().orderBy("file").limit(limit)


def read_lines(files: DataFrame, file: str, start: int = 1, end: int = 200) -> DataFrame:
    """line, shown: numbered lines start to end (from 1) of one file. Paths out of the tree are refused."""
    if file.startswith("/") or ".." in file.split("/"):
        raise ValueError("path escapes the repository")
    rows = files.filter(F.col("file") == file).select(F.posexplode(F.split("content", r"\r?\n")).alias("at", "text")).withColumn("line", F.col("at") + 1)
    return rows.filter(F.col("line").between(start, end)).select("line", F.concat(F.lpad(F.col("line").cast("string"), 6, " "), F.lit("→"), "text").alias("shown")).orderBy("line")
