"""Symbol search over source trees: definitions by line patterns per language, with the extent of their blocks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "sql": "sql", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "md": "markdown"}
#: Kinds that stand behind definitions of code in results, by rank; fixed values.
LATER_KINDS = {"key": 2, "section": 2, "heading": 3}
MIN_PART = 3

_I = r"^(?P<indent>\s*)"
_PATTERNS: dict[str, list[tuple[str, str]]] = {
    "rust": [("function", _I + r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(?P<name>\w+)"), *[(k, _I + rf"(?:pub(?:\([^)]*\))?\s+)?{w}\s+(?P<name>\w+)") for k, w in (("struct", "struct"), ("union", "union"), ("enum", "enum"), ("trait", "trait"), ("type", "type"), ("module", "mod"), ("const", "(?:const|static)"))], ("macro", _I + r"macro_rules!\s*(?P<name>\w+)"), ("impl", _I + r"impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)")],
    "python": [("function", _I + r"(?:async\s+)?def\s+(?P<name>\w+)"), ("class", _I + r"class\s+(?P<name>\w+)"), ("const", r"^(?P<indent>)(?P<name>[A-Z][A-Z0-9_]+)\s*(?::[^=]+)?=")],
    "javascript": [("function", _I + r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)"), ("class", _I + r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)"), ("interface", _I + r"(?:export\s+)?interface\s+(?P<name>\w+)"), ("enum", _I + r"(?:export\s+)?(?:const\s+)?enum\s+(?P<name>\w+)"), ("type", _I + r"(?:export\s+)?type\s+(?P<name>\w+)\s*[=<]"), ("variable", _I + r"(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*[=:]"), ("method", r"^(?P<indent>\s+)(?:async\s+|static\s+)*(?P<name>(?!(?:if|for|while|switch|catch|function|return)\b)[\w$]+)\([^)]*\)\s*(?::[^{]+)?\{")],
    "go": [("function", _I + r"func\s+(?P<name>\w+)"), ("method", _I + r"func\s+\(\s*\w+\s+\*?(?P<scope>\w+)[^)]*\)\s*(?P<name>\w+)"), ("struct", _I + r"type\s+(?P<name>\w+)\s+struct"), ("interface", _I + r"type\s+(?P<name>\w+)\s+interface"), ("type", _I + r"type\s+(?P<name>\w+)\s+(?!struct|interface)"), ("const", _I + r"(?:const|var)\s+(?P<name>\w+)")],
    "sql": [(k, _I + rf"(?i:create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|unique\s+|virtual\s+)*{k}\s+(?:if\s+not\s+exists\s+)?)[\"`]?(?P<name>[\w.]+)") for k in ("table", "view", "index", "function", "trigger")],
    "toml": [("section", _I + r"\[\[?(?P<name>[^\]]+)\]\]?"), ("key", _I + r"(?P<name>[\w.-]+)\s*=")],
    "yaml": [("key", _I + r"(?:- )?(?P<name>[\w.-]+):(?:\s|$)")],
    "markdown": [("heading", r"^(?P<indent>) {0,3}#{1,6}\s+(?P<name>.+?)\s*#*\s*$")],
}
_PATTERNS["typescript"] = _PATTERNS["javascript"]
_COMPILED = {k: [(kind, re.compile(p)) for kind, p in v] for k, v in _PATTERNS.items()}


#: Lines that belong to the definition below them.
_ABOVE = {"rust": re.compile(r"\s*(?:///|#\[)"), "python": re.compile(r"\s*@"), "go": re.compile(r"//"), "javascript": re.compile(r"\s*(?:/\*\*|\*|@)"), "typescript": re.compile(r"\s*(?:/\*\*|\*|@)"), "sql": re.compile(r"\s*--")}


def _braces_end(lines: list[str], at: int) -> int:
    depth, seen = 0, False
    for k in range(at, len(lines)):
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'|//.*$", "", lines[k])
        depth += bare.count("{") - bare.count("}")
        seen |= "{" in bare
        if (seen and depth <= 0) or (not seen and bare.rstrip().endswith(";")):
            return k
    return len(lines) - 1 if seen else at


def _indent_end(lines: list[str], at: int) -> int:
    own, last = len(lines[at]) - len(lines[at].lstrip()), at
    for k in range(at + 1, len(lines)):
        if lines[k].strip():
            if len(lines[k]) - len(lines[k].lstrip()) <= own and not lines[k].lstrip().startswith((")", "]", "}")):
                break
            last = k
    return last


def definitions(path: str, text: str) -> Iterator[tuple]:
    """(path, language, kind, name, scope, line, end_line, snippet, from_line) of a file's definitions; lines from 1. from_line is where the
    documentation and attributes directly above begin. An impl block is listed under the type it is for."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower())
    if language is None:
        return
    if language == "json":
        yield from _json_keys(path, text)
        return
    lines = text.split("\n")
    open_: list[tuple[str, int]] = []
    fenced = False
    for at, line in enumerate(lines):
        if language == "markdown" and line.lstrip().startswith("```"):
            fenced = not fenced
        if fenced:
            continue
        for kind, pattern in _COMPILED[language]:
            m = pattern.match(line)
            if not m:
                continue
            open_ = [o for o in open_ if o[1] >= at]
            if language in ("python", "yaml"):
                end = _indent_end(lines, at)
            elif language in ("rust", "javascript", "typescript", "go"):
                end = _braces_end(lines, at)
            elif language == "sql":
                end = next((k for k in range(at, len(lines)) if lines[k].rstrip().endswith(";")), len(lines) - 1)
            else:
                end = next((k - 1 for k in range(at + 1, len(lines)) if _COMPILED[language][0][1].match(lines[k])), len(lines) - 1) if kind in ("section", "heading") else at
            scope = m.groupdict().get("scope") or "::".join(o[0] for o in open_)
            real = "method" if kind == "function" and scope and language in ("rust", "python") else kind
            above = at
            while above and _ABOVE.get(language) and _ABOVE[language].match(lines[above - 1]):
                above -= 1
            yield path, language, real, m["name"], scope, at + 1, end + 1, line.strip()[:200], above + 1
            if kind in ("impl", "union", "class", "struct", "trait", "module", "interface", "enum", "function", "section", "heading") or language == "yaml":
                open_.append((m["name"], end if language != "markdown" else -1))
            break


def _json_keys(path: str, text: str) -> Iterator[tuple]:
    try:
        data = json.loads(text)
    except ValueError:
        return
    if isinstance(data, dict):
        lines = text.split("\n")
        for key in data:
            at = next((k for k, x in enumerate(lines) if f'"{key}"' in x), 0)
            yield path, "json", "key", key, "", at + 1, at + 1, lines[at].strip()[:200], at + 1


_SHAPE = "path string, language string, kind string, name string, scope string, line int, end_line int, snippet string, from_line int"


def extract(files: DataFrame) -> DataFrame:
    """Definitions of files (path, content), file by file in parallel."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _SHAPE.split(", ")]
        for frame in frames:
            yield pd.DataFrame([d for p, t in zip(frame["path"], frame["content"]) if t for d in definitions(p, t)], columns=columns)

    return files.select("path", "content").mapInPandas(run, _SHAPE)


#: What parts a scope from a name, in the order tried, and whether both sides must be like identifiers.
_PARTED = (("::", False, False), ("#", False, True), (".", True, True))
_IDENTIFIER = re.compile(r"[\w$-]+")


def asked(query: str) -> tuple[str, str]:
    """(name, scope) of a query, parted at the last sign of the first kind that fits: a :: always does, a # before an identifier, a dot only between
    identifiers, so that a heading like "10. Code index" stays whole. The scope is in lower case with dots."""
    text = query.strip()
    for sign, scope_too, name_too in _PARTED:
        scope, found, name = text.rpartition(sign)
        if found and (not name_too or scope and _IDENTIFIER.fullmatch(name)) and (not scope_too or all(map(_IDENTIFIER.fullmatch, scope.split(".")))):
            return name.strip(), scope.strip().removeprefix("::").replace("::", ".").replace("#", ".").lower()
    return text, ""


def find(symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Definitions that a query names, best first: exact, then any case, then containing it (MIN_PART letters or more), code before keys and sections before
    headings, by path and line. What asked() takes for a scope must end the definition's, in any case; if no definition fits it, it counts for nothing and
    scope_ignored tells so. matched is the number of all that fit, truncated whether there are more than are shown."""
    name, scope = asked(query)
    if not name:
        return symbols.limit(0).withColumns({"tier": F.lit(0), "scope_ignored": F.lit(False), "matched": F.lit(0).cast("bigint"), "truncated": F.lit(False)})
    low = F.lower("name")
    tier = F.when(F.col("name") == name, 0).when(low == name.lower(), 1)
    if len(name) >= MIN_PART:
        tier = tier.when(F.contains(low, F.lit(name.lower())), 2)
    hits = symbols.withColumn("tier", tier).where("tier is not null")
    ignored = False
    if scope:
        have = F.lower(F.replace("scope", F.lit("::"), F.lit(".")))
        fits: Column = (have == scope) | have.endswith("." + scope)
        ignored = hits.where(fits).isEmpty()
        hits = hits if ignored else hits.where(fits)
    rank = F.lit(1)
    for kind, place in LATER_KINDS.items():
        rank = F.when(F.col("kind") == kind, place).otherwise(rank)
    matched = hits.agg(F.count("*").alias("matched"))
    shown = hits.withColumn("scope_ignored", F.lit(ignored)).orderBy("tier", rank, "path", "line").limit(limit)
    return shown.crossJoin(F.broadcast(matched)).withColumn("truncated", F.col("matched") > limit)  # matched is one row
