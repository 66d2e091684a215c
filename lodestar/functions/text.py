"""Column functions over names, paths and texts. All of them run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File suffixes by language, the first match wins; anything else is ts.
SUFFIXES = [("markdown", (".md", ".mdx")), ("yaml", (".yml", ".yaml")), ("java", (".java",)), ("c", (".c", ".h")), ("go", (".go",)), ("python", (".py",)), ("rust", (".rs",))]
#: The order in which an automatic language choice looks for an available one.
PREFERRED = ["java", "ts", "python", "go", "rust", "c", "markdown", "yaml"]
#: Words that may precede a symbol's name in a query, by kind.
KEYWORDS = [
    r"(?:class|interface|type|enum|struct|trait)\s+",
    r"(?:function|method|def|func|fn|async\s+function|export\s+function|export\s+async\s+function)\s+",
    r"(?:const|let|var|val|export\s+const|export\s+let|export\s+var)\s+",
    r"(?:public|private|protected|static|readonly|abstract)\s+",
]
#: What defines a name in a chunk's text.
DEFINED = [r"function\s+(\w+)", r"class\s+(\w+)", r"(?<!\w)(\w++)\s*+\([^)]*+\)\s*+\{"]  # the last one never looks at a word twice
#: Ids that begin, end and stand for unknown words in a model's input.
BEGIN, END, UNKNOWN = 101, 102, 100


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and _, in order, with repeats."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t != "")).cast("long")


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def u32(digest: Column) -> Column:
    """The first 32 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def chunk_text(file: Column, kind: Column, name: Column, signature: Column) -> Column:
    return F.concat(F.lit("file:"), file, F.lit("\nkind:"), kind, F.lit("\nname:"), name, F.lit("\nsignature:"), signature)


def ref_id(file: Column, name: Column, kind: Column, start: Column, end: Column, content_hash: Column) -> Column:
    return sha(F.concat_ws(":", file, name, kind, start.cast("string"), end.cast("string"), content_hash))


def file_id(path: Column) -> Column:
    return sha(F.concat(F.lit("file:"), posix(path)))


def module_id(name: Column) -> Column:
    return sha(F.concat(F.lit("module:"), name))


def infer_lang(path: Column) -> Column:
    out = F.lit("ts")
    for lang, suffixes in reversed(SUFFIXES):
        hit = F.lit(False)
        for s in suffixes:
            hit |= path.endswith(s)
        out = F.when(hit, F.lit(lang)).otherwise(out)
    return out


def subword(tokens_: Column, longer_than: int, step: int) -> Column:
    """Tokens longer than a bound, cut in two pieces of step characters and the rest."""
    cut = lambda t: F.when(F.length(t) > longer_than, F.array(F.substring(t, 1, step), F.substring(t, step + 1, step), F.substr(t, F.lit(2 * step + 1)))).otherwise(F.array(t))
    return F.flatten(F.transform(tokens_, cut))


def definition_names(content: Column) -> Column:
    """Distinct names that follow function or class, or stand before (...) {."""
    found = lambda c: F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in DEFINED))
    return F.array_distinct(F.transform(F.array(content), found)[0])  # the content is worked out once


def model_ids(text: Column, vocabulary: dict[str, int], longest: int = 256) -> Column:
    """array<int>: the ids of a model's input, from begin to end; tokens above 8 characters go in pieces of 4, 4 and the rest."""
    known = F.create_map(*[x for k, v in vocabulary.items() for x in (F.lit(k), F.lit(v))]) if vocabulary else F.create_map().cast("map<string,int>")
    ids = F.transform(subword(tokens(text), 8, 4), lambda t: F.coalesce(F.try_element_at(known, t), F.lit(UNKNOWN)))
    return F.concat(F.array(F.lit(BEGIN)), F.slice(ids, 1, longest - 2), F.array(F.lit(END)))


def strip_keywords(query: str) -> str:
    """A query without up to five leading language keywords."""
    rules = [re.compile(k, re.I) for k in KEYWORDS]
    query = query.strip()
    for _ in range(5):
        hit = next((m for r in rules if (m := r.match(query))), None)
        if hit is None:
            break
        query = query[hit.end() :].strip()
    return query


def coarse_token(query: str) -> str:
    """The first of the longest runs of identifier characters."""
    return max(re.findall(r"[A-Za-z0-9_$.]+", query), key=len, default="")


def fuzzy_score(hay: Column, needle: str, normalise: bool = True) -> Column:
    """Greedy subsequence score: 2 for a match right after the last one, else 1; -1 if something is missing, 0 for no needle."""
    if normalise:
        needle = re.sub(r"[^a-z0-9_$.]", "", needle.lower())
        hay = F.regexp_replace(F.lower(hay), r"[^a-z0-9_$.]", "")
    if not needle:
        return F.lit(0)
    want = F.array(*map(F.lit, needle))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("score"), F.lit(-2).alias("last"), F.lit(0).alias("at"))

    def step(a: Column, c: Column) -> Column:
        hit = (a["at"] < len(needle)) & (F.element_at(want, F.least(a["at"] + 1, F.lit(len(needle)))) == c)
        gain = F.when(a["last"] == a["i"] - 1, 2).otherwise(1)
        return F.struct((a["i"] + 1).alias("i"), F.when(hit, a["score"] + gain).otherwise(a["score"]).alias("score"), F.when(hit, a["i"]).otherwise(a["last"]).alias("last"), F.when(hit, a["at"] + 1).otherwise(a["at"]).alias("at"))

    end = F.aggregate(F.filter(F.split(hay, ""), lambda c: c != ""), start, step)
    return F.when(end["at"] == len(needle), end["score"]).otherwise(F.lit(-1))


def glob_regex(pattern: str) -> str:
    """A path glob: ** crosses folders, * and ? don't."""
    out = []
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", pattern):
        out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part)))
    return "^" + "".join(out) + "$"


def wildcard_regex(pattern: str) -> str:
    """A name wildcard: * is any run and ? any character, both across folders."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def like_escaped(text: str) -> str:
    """text for LIKE, where it means itself."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def like_pattern(pattern: str) -> str:
    """A name wildcard as a LIKE pattern."""
    return "".join({"*": "%", "?": "_"}.get(c, like_escaped(c)) for c in pattern)
