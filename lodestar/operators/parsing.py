"""Rows from texts: lines, sections, keys, chunks, scopes, and symbols of source files."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..lineage import cut
from . import syntax as X

LINE = r"\r?\n"
#: What a header line of Markdown and a key line of YAML are.
HEADER, KEY = r"^(#{1,6})\s+(.+?)\s*#*\s*$", r"^\s*([A-Za-z0-9_.-]+)\s*:"
LARGE_BYTES, LARGE_CHARS = 1_000_000, 10_000


def gated(content: Column, size: Column) -> Column:
    """The content, or its beginning for large files."""
    return F.when(size > LARGE_BYTES, F.substring(content, 1, LARGE_CHARS)).otherwise(content)


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """file, line (from 1), text."""
    return files.select("file", F.posexplode(F.split(content, LINE)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def markdown_sections(lines_: DataFrame) -> DataFrame:
    """file, name, level, start_line, end_line, parent_line of ATX headers; a file's headers are few, so they meet by file."""
    last = lines_.groupBy("file").agg(F.max("line").alias("last"))
    h = lines_.filter(F.col("text").rlike(HEADER)).select("file", "line", F.length(F.regexp_extract("text", HEADER, 1)).alias("level"), F.regexp_extract("text", HEADER, 2).alias("name"))
    by = Window.partitionBy("file").orderBy("line")
    later, earlier = by.rowsBetween(1, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, -1)
    # there are six levels, so six running minima and maxima say where a section ends and which one is around it
    at = lambda n: F.when(F.col("level") == n, F.col("line"))
    h = h.withColumns({f"_next{n}": F.min(at(n)).over(later) for n in range(1, 7)} | {f"_last{n}": F.max(at(n)).over(earlier) for n in range(1, 7)})
    inside = lambda name, keep: F.array(*(F.when(keep(F.lit(n)), F.col(f"{name}{n}")) for n in range(1, 7)))
    end = F.array_min(inside("_next", lambda n: n <= F.col("level"))) - 1
    # the nearest earlier header of a lower level is open: anything that closed it would be nearer and lower
    parent = F.array_max(inside("_last", lambda n: n < F.col("level")))
    out = h.select("file", "name", "level", F.col("line").alias("start_line"), end.alias("end"), parent.alias("parent_line"))
    return out.join(last, "file").select("file", "name", "level", "start_line", F.coalesce("end", "last").alias("end_line"), "parent_line")


def yaml_keys(lines_: DataFrame) -> DataFrame:
    """file, name, start_line, end_line of key lines; comments, blanks and list items are none."""
    last = lines_.groupBy("file").agg(F.max("line").alias("last"))
    trimmed = F.trim("text")
    k = lines_.filter((trimmed != "") & ~trimmed.startswith("#") & ~trimmed.startswith("-") & F.col("text").rlike(KEY)).select("file", "line", F.regexp_extract("text", KEY, 1).alias("name"))
    nxt = F.lead("line").over(Window.partitionBy("file").orderBy("line"))
    out = k.withColumn("next", nxt).join(last, "file")
    return out.select("file", "name", F.col("line").alias("start_line"), F.greatest("line", F.coalesce(F.col("next") - 1, "last")).alias("end_line"))


def chunk_lines(max_chunk: int) -> int:
    return max(50, min(500, max_chunk // 10))


def line_chunks(files: DataFrame, content: str = "content", max_chunk: int = 1000) -> DataFrame:
    """Fallback chunks of clamp(max_chunk / 10, 50, 500) lines: file, start_line, end_line."""
    step = chunk_lines(max_chunk)
    n = F.size(F.split(content, LINE))
    out = files.select("file", n.alias("n")).select("file", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step))).alias("at"))
    return out.select("file", (F.col("at") + 1).alias("start_line"), F.least(F.col("at") + step, F.col("n")).alias("end_line"))


def assign_scopes(refs: DataFrame, scopes: DataFrame) -> DataFrame:
    """refs (file, ref, line) with owner: the least span (file, ref_id, start_line, end_line, pos) around the line; null if none.

    The file is an equality key, so the range is only a residual; minima are pre-aggregated."""
    inside = refs.join(scopes, "file").filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    owner = inside.groupBy("file", "ref", "line").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "pos", "ref_id"))["ref_id"].alias("owner"))
    return refs.join(owner, ["file", "ref", "line"], "left")


def fragments(lines_: DataFrame, covered: DataFrame, min_tokens: int = 50) -> DataFrame:
    """Maximal runs of lines outside the covered ones (file, line), with at least min_tokens: file, start_line, end_line, tokens."""
    free = lines_.join(covered.select("file", "line"), ["file", "line"], "left_anti")
    island = F.col("line") - F.row_number().over(Window.partitionBy("file").orderBy("line"))
    runs = free.withColumn("island", island).groupBy("file", "island").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.sum(T.token_count(F.col("text"))).alias("tokens"))
    return runs.filter(F.col("tokens") >= min_tokens).drop("island")


def split_lines(counts: list[int], max_tokens: int, back: int) -> Iterator[tuple[int, int, int]]:
    """(first line, last line, tokens) of runs of lines, from 1, of up to max_tokens; each begins back lines before the last one's end."""
    start = total = 0
    for i, c in enumerate(counts):
        if total + c > max_tokens and i > start:
            yield start + 1, i, total
            start = max(start + 1, i - back)
            total = sum(counts[start:i])
        total += c
    yield start + 1, len(counts), total


def forced_split(files: DataFrame, content: str = "content", max_tokens: int = 512, overlap_tokens: int = 32) -> DataFrame:
    """file, part, start_line, end_line, tokens: runs of lines up to max_tokens, each beginning some lines before the last one's end."""
    back = -(-overlap_tokens // 10)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, text in zip(pdf["file"], pdf[content]):
                counts = [len(x.split()) for x in re.split(LINE, text or "")]
                out += [(file, part, *run) for part, run in enumerate(split_lines(counts, max_tokens, back))]
            yield pd.DataFrame(out, columns=["file", "part", "start_line", "end_line", "tokens"])

    return files.select("file", content).mapInPandas(run, "file string, part int, start_line int, end_line int, tokens long")


# -- symbols of source files

SYMBOLS = "file string, lang string, row string, pos int, name string, kind string, signature string, start_line int, end_line int, holder int, line int, col int, extends array<string>, implements array<string>, ref_id string, content_hash string, up string"
_ARROW = pa.schema([(n, {"string": pa.string(), "int": pa.int32()}.get(t, pa.list_(pa.string()))) for n, t in (c.split() for c in SYMBOLS.split(", "))])

#: Declarations by language: kind and pattern with group 1 as the name, tried in order on each line.
DECLARED = {
    "java": [("class", r"^\s*(?:[\w@]+\s+)*?(?:class|interface|enum|record|@interface)\s+(\w+)"), ("method", r"^\s+(?!return|new|else|throw)(?:[\w<>\[\],.@]+\s+)*(?!if|for|while|switch|catch)(\w+)\s*\([^;{]*\)\s*(?:throws\s+[\w,\s.]+)?\{"),
             ("field", r"^\s+(?!return|throw|package|import|else|case)(?:(?:private|public|protected|static|final|volatile|transient)\s+)*[\w<>\[\],.]+\s+(\w+)\s*(?:=[^=].*)?;")],
    "go": [("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("class", r"^\s*type\s+(\w+)")],
    "rust": [("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)"), ("class", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)"), ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)")],
    "c": [("class", r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*\{"), ("function", r"^(?!\s*(?:if|for|while|switch|return|else|typedef|struct)\b)[\w\*\s]+?\b(\w+)\s*\([^;]*\)\s*\{")],
}
NOT_CALLED = set("if for while switch catch return function def class fn func match sizeof typeof super new elif except with assert and or not in lambda".split())
#: Names of types by language, where they aren't called.
TYPES = {"go": r"\b(?:[A-Z]\w*)\b(?!\s*\()", "rust": r"\b(?:[A-Z]\w*)\b(?!\s*[(!])", "c": r"\b(?:[A-Z]\w*|\w+_t)\b(?!\s*\()"}
#: What follows extends and implements in a declaration's head.
EXTENDS, IMPLEMENTS = r"\bextends\s+([A-Za-z0-9_$.<>\[\]]+)", r"\bimplements\s+([A-Za-z0-9_$. ,<>\[\]]+)"
#: Folders whose YAML files without keys are documents.
CONFIG_FOLDERS = ["/.github/workflows/", "/.circleci/", "/.gitlab/", "/.buildkite/"]

Found = tuple[str, str, str, str, int, int, int | None, int, int, list[str], list[str]]


def symbol(name: str, kind: str, signature: str, start: int, end: int, holder: int | None = None, extends: tuple = (), implements: tuple = ()) -> Found:
    return "symbol", name, kind, signature, start, end, holder, start, 1, list(extends), list(implements)


def reference(name: str, kind: str, line: int, col: int) -> Found:
    return "ref", name, kind, "", 0, 0, None, line, col, [], []


def heritage(head: str) -> tuple[list[str], list[str]]:
    """The name after extends, and those after implements, cut at commas outside of <...>."""
    ext, imp, depth, parts = re.search(EXTENDS, head), re.search(IMPLEMENTS, head), 0, [""]
    for c in imp[1] if imp else "":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    return [ext[1]] if ext else [], [p.strip() for p in parts if p.strip()]


def parse_python(content: str) -> list[Found]:
    """Definitions and calls. Broken files raise."""
    out: list[Found] = []
    count = 0

    def walk(node: ast.AST, owner: int | None, in_class: bool) -> None:
        nonlocal count
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
                source = ast.get_source_segment(content, child) or ""
                out.append(symbol(child.name, kind, source.split(":", 1)[0].strip(), child.lineno, child.end_lineno, owner))
                count += 1
                walk(child, count - 1, kind == "class")
                continue
            if isinstance(child, ast.Call) and isinstance(child.func, (ast.Name, ast.Attribute)):
                f = child.func
                name, line, at = (f.id, f.lineno, f.col_offset) if isinstance(f, ast.Name) else (f.attr, f.end_lineno, f.end_col_offset - len(f.attr))
                out.append(reference(name, "call", line, at + 1))
            walk(child, owner, False)

    walk(ast.parse(content), None, False)
    return out


_SEEN = {"call_expression", "new_expression", "type_identifier", "function_declaration", "method_definition", "class_declaration", "interface_declaration", "type_alias_declaration", "variable_declarator", "export_specifier"}


def _seen(root: X.Node) -> list[tuple[X.Node, int, bool]]:
    """The nodes that may be symbols or references, in order, with the place of the one around each, or -1, and whether they are exported."""
    out: list[tuple[X.Node, int, bool]] = []

    def visit(n: X.Node, around: int, exported: bool) -> None:
        if n.type in _SEEN:
            out.append((n, around, exported))
            around = len(out) - 1
        for c in n.children:
            visit(c, around, n.type == "export_statement" or exported and n.type in ("lexical_declaration", "variable_declaration"))

    visit(root, -1, False)
    return out


def parse_script(content: str, reader: X.Reader | None = None) -> list[Found]:
    """Definitions, exports, tests and references of JavaScript and TypeScript, by its syntax tree. Broken files raise."""
    source, out, count = X.Source(content), [], 0
    shape = (reader or X.Reader()).read(content)

    def name_of(n: X.Node | None) -> str:
        if n is not None and n.type == "member_expression":
            n = n.fields["property"]
        return source.of(n) if n is not None and n.type in ("identifier", "property_identifier") else ""

    def add(n: X.Node, owner: int | None, name: str, kind: str, signature: str, **more) -> int:
        nonlocal count
        out.append(symbol(name, kind, signature, source.place(n.start)[0], source.place(max(n.start, n.end - 1))[0], owner, **more))
        count += 1
        return count - 1

    owners: list[int | None] = []  # of what is inside of each node
    for n, around, exported in shape.once("seen", lambda: _seen(shape.root)):
        f, owner = n.fields, owners[around] if around >= 0 else None
        inside = owner
        if n.type in ("call_expression", "new_expression"):
            target = f.get("function") or f.get("constructor")
            if name := name_of(target):
                out.append(reference(name, "new" if n.type == "new_expression" else "call", *source.place(target.start)))
            args = f["arguments"].kids() if "arguments" in f and f["arguments"].type == "arguments" else []
            if n.type == "call_expression" and name in ("test", "describe") and args and args[0].type in ("string", "template_string"):
                if title := source.of(args[0])[1:-1].strip():
                    add(n, owner, title, "test", f'{name}("{title}", ...)')
        elif n.type == "type_identifier":
            out.append(reference(source.of(n), "type", *source.place(n.start)))
        elif n.type in ("function_declaration", "method_definition") and "name" in f:
            inside = add(n, owner, source.of(f["name"]), "method" if n.type == "method_definition" else "function", source.of(n).split("{")[0].strip())
        elif n.type in ("class_declaration", "interface_declaration") and "name" in f:
            kind = n.type.split("_")[0]
            ext, imp = heritage(source.of(n).split("{")[0].strip())
            at = add(n, owner, source.of(f["name"]), kind, f"{kind} {source.of(f['name'])}", extends=tuple(ext), implements=tuple(imp))
            inside = at if kind == "class" else owner
        elif n.type == "type_alias_declaration":
            add(n, owner, source.of(f["name"]), "type", f"type {source.of(f['name'])} = ...")
        elif n.type == "variable_declarator" and "value" in f:
            if f["value"].type in ("arrow_function", "function_expression"):
                inside = add(n, owner, source.of(f["name"]), "function", source.of(n).split("=>")[0].strip() + " => ...")
            elif exported:
                add(n, owner, source.of(f["name"]), "variable", source.of(n).split("=")[0].strip())
        elif n.type == "export_specifier":
            add(n, owner, source.of(f["name"]), "export", f"export {{ {source.of(f['name'])} }}")
        owners.append(inside)
    return out


def parse_braces(content: str, lang: str) -> list[Found]:
    """The same by line patterns and brace depth, for languages with braces. Near to a grammar, not one."""
    rules = [(k, re.compile(p)) for k, p in DECLARED[lang]]
    out, rows, count = [], re.split(LINE, content), 0
    bare = [re.sub(r"//.*$|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]*`", "", r) for r in rows]
    open_: list[tuple[str, int, int]] = []  # kind, last line, position

    def last_line(i: int) -> int:
        """Where a declaration that begins on line i ends: with its braces, or without any at its semicolon; a type's without any on its line there."""
        depth, seen = 0, False
        for j in range(i, len(bare)):
            depth += bare[j].count("{") - bare[j].count("}")
            seen |= "{" in bare[j]
            if depth <= 0 and (seen or ";" in bare[j]) or not seen and lang == "go" and not bare[j].rstrip().endswith((",", "(")):
                return j
        return len(bare) - 1 if depth else i

    for i, row in enumerate(bare):
        open_ = [o for o in open_ if o[1] >= i]
        hit = next(((k, m) for k, p in rules if (m := p.match(row))), None)
        if hit and hit[0] == "field" and (not open_ or open_[-1][0] != "class"):
            hit = None
        if hit:
            kind, name = hit[0], hit[1][1]
            end = i if kind == "field" else last_line(i)
            owner = open_[-1] if open_ else None
            if kind == "function" and owner and owner[0] == "class":
                kind = "method"
            head = row.split("{")[0].split(";")[0].strip() if lang == "java" else row.split("{")[0].strip()
            ext, imp = heritage(head) if kind == "class" and lang == "java" else ([], [])
            if kind == "class" and lang == "java":
                head = next((f"{w} {name}" for w in ("interface", "enum", "record", "class") if re.search(rf"\b{w}\s+{name}\b", row)), head)
            out.append(symbol(name, kind, head, i + 1, end + 1, owner[2] if owner else None, tuple(ext), tuple(imp)))
            if kind != "field":
                open_.append((kind, end, count))
            count += 1
        for m in re.finditer(r"(\bnew\s+)?([A-Za-z_]\w*)\s*\(", row):
            if m[2] not in NOT_CALLED and not (hit and m.start(2) == hit[1].start(1)):
                out.append(reference(m[2], "new" if m[1] else "call", i + 1, m.start(2) + 1))
        for m in re.finditer(TYPES[lang], row) if lang in TYPES else ():
            if not (hit and m.start() == hit[1].start(1)):
                out.append(reference(m[0], "type", i + 1, m.start() + 1))
    return out


def parse_markdown(content: str) -> list[Found]:
    """Sections of headers, with the path of those around them as signature."""
    rows = re.split(LINE, content)
    heads = [(i, len(m[1]), m[2].strip()) for i, row in enumerate(rows) if (m := re.match(HEADER, row)) and m[2].strip()]
    ends, later = {}, []
    for i, level, _ in reversed(heads):  # the next header of no greater level ends a section
        later = [x for x in later if x[1] <= level]
        ends[i] = later[-1][0] if later else len(rows)
        later = [x for x in later if x[1] < level] + [(i, level)]
    open_, out = [], []
    for i, level, name in heads:
        open_ = [o for o in open_ if o[0] < level]
        path = [*(open_[-1][2] if open_ else []), name]
        out.append(symbol(name, "section", " > ".join(path), i + 1, ends[i], open_[-1][1] if open_ else None))
        open_.append((level, len(out) - 1, path))
    return out


def parse_yaml(content: str, file: str) -> list[Found]:
    """Keys, each up to the next one; without any a document in a folder of configurations, else a node."""
    rows, keys = re.split(LINE, content), []
    for i, row in enumerate(rows):
        if row.strip() and not row.strip().startswith(("#", "-")) and (m := re.match(KEY, row)):
            keys.append((m[1], i + 1))
    if not keys:
        name = file.rpartition("/")[2]
        return [symbol(name, "document" if any(c in f"/{file}" for c in CONFIG_FOLDERS) else "node", name, 1, max(1, len(rows)))]
    ends = [k[1] - 1 for k in keys[1:]] + [len(rows)]
    return [symbol(name, "node", name, start, max(start, end)) for (name, start), end in zip(keys, ends)]


def parse_file(file: str, lang: str, content: str, reader: X.Reader | None = None) -> list[Found]:
    """By language; nothing for files that can't be parsed."""
    try:
        if lang == "python":
            return parse_python(content)
        if lang == "ts":
            return parse_script(content, reader)
        if lang == "markdown":
            return parse_markdown(content)
        return parse_yaml(content, file) if lang == "yaml" else parse_braces(content, lang)
    except (SyntaxError, ValueError, RecursionError):
        return []


def parse_sources(files: DataFrame, fallback: str = "text-only", max_chunk: int = 1000) -> DataFrame:
    """Symbols and references of files (file, content, and size if known: of large files only the beginning is read).

    A file that gives none becomes one document (text-only), documents of some lines (line-chunk) or nothing (skip)."""
    files = files.withColumn("content", gated(F.col("content"), F.col("size"))) if "size" in files.columns else files

    def found_in(file: str, lang: str, content: str, reader: X.Reader) -> list[Found]:
        found = parse_file(file, lang, content, reader)
        if found or fallback not in ("text-only", "line-chunk"):
            return found
        n, name = len(re.split(LINE, content)), file.rpartition("/")[2]
        if fallback == "text-only":
            return [symbol(name, "document", name, 1, n)]
        step = chunk_lines(max_chunk)
        return [symbol(f"{name}:{a + 1}-{min(n, a + step)}", "document", f"{name}:{a + 1}-{min(n, a + step)}", a + 1, min(n, a + step)) for a in range(0, n, step)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = X.Reader()
        for b in batches:
            out: list[tuple] = []
            for file, lang, content in zip(*(b.column(c) for c in ("file", "lang", "content"))):
                file, lang = file.as_py(), lang.as_py()
                out += _identified(file, lang, found_in(file, lang, content.as_py() or "", reader))
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return files.withColumn("file", T.posix(F.col("file"))).withColumn("lang", T.infer_lang(F.col("file"))).select("file", "lang", "content").mapInArrow(run, SYMBOLS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def _identified(file: str, lang: str, found: list[Found]) -> list[tuple]:
    """A file's rows with their ids: of symbols their own, their text's and in up what holds them (a symbol or the file); of references in
    up the function or method around them, the shortest one, or the file. All of it is in the file, so no rows need to meet for it."""
    ids: list[tuple[str, str]] = []
    spans: list[tuple[int, int, int, int, str]] = []
    for f in found:
        if f[0] == "symbol":
            _, name, kind, signature, start, end = f[:6]
            text = _sha(f"file:{file}\nkind:{kind}\nname:{name}\nsignature:{signature}")
            ids.append((_sha(f"{file}:{name}:{kind}:{start}:{end}:{text}"), text))
            if kind in ("function", "method"):
                spans.append((end - start, len(ids) - 1, start, end, ids[-1][0]))
    whole, out, pos = _sha(f"file:{file}"), [], -1
    spans.sort()
    for f in found:
        if f[0] == "symbol":
            pos += 1
            out.append((file, lang, "symbol", pos, *f[1:], *ids[pos], ids[f[6]][0] if f[6] is not None else whole))
        else:
            out.append((file, lang, "ref", None, *f[1:], None, None, next((s[4] for s in spans if s[2] <= f[7] <= s[3]), whole)))
    return out


def index_rows(parsed: DataFrame, dim: int = 256, bits: int = 8) -> dict[str, DataFrame]:
    """The nine tables of an index from parsed rows: chunks with their codes, refs, and the seven relations of the graph."""
    s = parsed.filter("row = 'symbol'")
    owned = parsed.filter("row = 'ref'").select(F.col("up").alias("from_id"), F.col("lang").alias("from_lang"), "name", F.col("kind").alias("ref_kind"), "file", "line", "col").distinct()
    names = lambda c: s.filter("kind = 'class'").select(F.col("ref_id").alias("sub_id"), F.explode(c).alias("name")).distinct()
    chunks = s.select("lang", "content_hash", T.chunk_text(F.col("file"), F.col("kind"), F.col("name"), F.col("signature")).alias("text")).dropDuplicates(["lang", "content_hash"])
    chunks = chunks.withColumn("v", V.hashed(F.col("text"), dim)).withColumn("c", V.quantise(F.col("v"), bits))
    return {
        "chunks": chunks.select("lang", "content_hash", "text", F.lit(dim).alias("dim"), F.col("c.scale").alias("scale"), V.to_base64(F.col("c.q")).alias("qvec_b64")),
        "refs": s.select("lang", "ref_id", "content_hash", "file", F.col("name").alias("symbol"), "kind", "signature", "start_line", "end_line").dropDuplicates(["ref_id"]),
        "ast_file": parsed.select(T.file_id(F.col("file")).alias("file_id"), "file", "lang").distinct(),
        "ast_symbol": s.select("ref_id", "file", "lang", "name", "kind", "signature", "start_line", "end_line").dropDuplicates(["ref_id"]),
        "ast_contains": s.select(F.col("up").alias("parent_id"), F.col("ref_id").alias("child_id")).distinct(),
        "ast_extends_name": names("extends").withColumnRenamed("name", "super_name"),
        "ast_implements_name": names("implements").withColumnRenamed("name", "iface_name"),
        "ast_ref_name": owned,
        "ast_call_name": owned.filter("ref_kind in ('call', 'new')").select(F.col("from_id").alias("caller_id"), F.col("from_lang").alias("caller_lang"), F.col("name").alias("callee_name"), "file", "line", "col"),
    }


def structural_hashes(nodes: DataFrame, rounds: int = 2) -> DataFrame:
    """Weisfeiler-Lehman rounds over a forest (id, parent, at, type): id, depth from 1, hash after the last round.

    A first hash is of the type, the children's types in order and the depth; a round's of the type, its number and the children's hashes, sorted."""
    depth = nodes.filter("parent is null").select("id", F.lit(1).alias("depth"))
    found, level = depth, depth
    while True:
        level = cut(nodes.join(level.select(F.col("id").alias("parent"), (F.col("depth") + 1).alias("depth")), "parent").select("id", "depth"))
        if level.isEmpty():
            break
        found = found.union(level)
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "type"))), lambda x: x["type"]), ",").alias("kids"))
    state = nodes.join(found, "id").join(kids, "id", "left")
    state = cut(state.select("id", "parent", "type", "depth", T.sha(F.concat_ws("|", "type", F.coalesce("kids", F.lit("")), F.col("depth").cast("string"))).alias("hash")))
    for i in range(max(1, rounds)):
        below = state.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("hash")), "|").alias("below"))
        state = state.join(below, "id", "left").select("id", "parent", "type", "depth", T.sha(F.concat_ws("|", "type", F.lit(str(i)), "below")).alias("hash"))
    return state.select("id", "depth", "hash")


def structural_embedding(nodes: DataFrame, dim: int = 256, rounds: int = 2) -> DataFrame:
    """tree, vector of each tree of a forest (id, tree, parent, at, type): signed counts of its nodes' hashes, half a count for each depth, unit length."""
    h = structural_hashes(nodes, rounds).join(nodes.select("id", "tree"), "id")
    sign = F.when(F.conv(F.substring("hash", 1, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    by_hash = h.select("tree", (T.u32(F.col("hash")) % dim).cast("int").alias("bucket"), sign.alias("value"))
    by_depth = h.select("tree", (F.col("depth") * 7 % dim).cast("int").alias("bucket"), F.lit(0.5).alias("value"))
    return V.vectors(by_hash.union(by_depth), "tree", dim)
