"""Go source text: its declarations, imports, comments and complexity."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECLARATION = "node_id bigint, name string, kind string, visibility string, function_length bigint, cyclomatic_complexity bigint"
FILE = "node_id bigint, imports bigint, stdlib_imports bigint, external_imports bigint, internal_imports bigint, comment_ratio double"

_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])*'", re.S)
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_FUNC = re.compile(r"^func\s*(\([^)]*\)\s*)?([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\(", re.M)
_GROUP = re.compile(r"^(type|const|var)\s*\(", re.M)
_SINGLE = re.compile(r"^(type|const|var)\s+([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)([^\n]*)", re.M)
_SPEC = re.compile(r"^\s*([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)([^\n]*)")
_BRANCH = re.compile(r"\b(?:if|for|case)\b|&&|\|\|")
_IMPORT = re.compile(r"^import\s*(?:\((.*?)\)|([^\n]*))", re.M | re.S)
_QUOTED = re.compile(r"\"([^\"\n]+)\"|`([^`\n]+)`")


def _blank(text: str) -> str:
    """text with comments and literals blanked out, line ends kept."""
    return _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _close(code: str, at: int, opening: str, closing: str) -> int:
    """The place after the bracket that closes the one at a place; the end of the code if none does."""
    depth = 0
    for m in re.compile(f"[{re.escape(opening + closing)}]").finditer(code, at):
        depth += 1 if m.group() == opening else -1
        if depth == 0:
            return m.end()
    return len(code)


def _visibility(name: str) -> str:
    return "public" if name[:1].isupper() else "private"


def _type_kind(rest: str) -> str:
    word = re.match(r"\s*(?:\[[^\]]*\]\s*)?(struct|interface)\b", rest)
    return word.group(1) if word else "type"


def declarations(text: str) -> list[tuple[str, str, str, int | None, int | None]]:
    """(name, kind, visibility, function length, complexity) of each declared name at the top level."""
    code = _blank(text.replace("\r\n", "\n"))
    out = []
    for m in _FUNC.finditer(code):
        params = _close(code, m.end() - 1, "(", ")")
        line_end = code.find("\n", params)
        brace = code.find("{", params, len(code) if line_end < 0 else line_end + 1)
        end = _close(code, brace, "{", "}") if brace >= 0 else params
        body = code[brace:end] if brace >= 0 else ""
        out.append((m.group(2), "method" if m.group(1) else "function", _visibility(m.group(2)), code.count("\n", m.start(), end) + 1, 1 + len(_BRANCH.findall(body))))
    kinds = {"const": "constant", "var": "variable"}

    def spec(word: str, names: str, rest: str) -> None:
        for name in names.split(","):
            if (name := name.strip()) != "_":
                out.append((name, _type_kind(rest) if word == "type" else kinds[word], _visibility(name), None, None))

    for m in _GROUP.finditer(code):
        inner, depth = code[m.end() : _close(code, m.end() - 1, "(", ")") - 1], 0
        for line in inner.split("\n"):
            if depth == 0 and (s := _SPEC.match(line)):
                spec(m.group(1), s.group(1), s.group(2))
            depth += sum(line.count(c) for c in "({[") - sum(line.count(c) for c in ")}]")
    for m in _SINGLE.finditer(code):
        spec(m.group(1), m.group(2), m.group(3))
    return out


def import_counts(text: str, module: str | None = None) -> tuple[int, int, int, int]:
    """(all, stdlib, external, internal) imports: no dot in the first element: stdlib; the module's own: internal."""
    paths = [a or b for m in _IMPORT.finditer(_COMMENT.sub(" ", text)) for a, b in _QUOTED.findall(m.group(1) or m.group(2) or "")]
    internal = sum(bool(module) and (p == module or p.startswith(f"{module}/")) for p in paths)
    stdlib = sum("." not in p.split("/")[0] and not (module and (p == module or p.startswith(f"{module}/"))) for p in paths)
    return len(paths), stdlib, len(paths) - stdlib - internal, internal


def comment_share(text: str) -> float:
    """Lines that a comment covers among the lines that aren't blank."""
    lines = text.replace("\r\n", "\n").split("\n")
    filled = sum(bool(line.strip()) for line in lines)
    covered: set[int] = set()
    joined = "\n".join(lines)
    for m in _SKIP.finditer(joined):
        if m.group().startswith(("//", "/*")):
            first = joined.count("\n", 0, m.start())
            covered.update(range(first, first + m.group().count("\n") + 1))
    return len(covered) / filled if filled else 0.0


def go_declarations(sources: DataFrame) -> DataFrame:
    """DECLARATION rows of Go files (node_id, content); NULL texts give none."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in DECLARATION.split(", ")]
        for batch in batches:
            rows = [(i, *d) for i, t in zip(batch["node_id"], batch["content"]) for d in declarations(t)]
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"function_length": "Int64", "cyclomatic_complexity": "Int64"})

    return sources.select("node_id", "content").where("content IS NOT NULL").mapInPandas(scan, DECLARATION)


def go_files(sources: DataFrame) -> DataFrame:
    """FILE rows of Go files (node_id, content, module); module may be NULL."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in FILE.split(", ")]
        for batch in batches:
            rows = [(i, *import_counts(t, m), comment_share(t)) for i, t, m in zip(batch["node_id"], batch["content"], batch["module"])]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return sources.select("node_id", "content", F.col("module").cast("string").alias("module")).where("content IS NOT NULL").mapInPandas(scan, FILE)
