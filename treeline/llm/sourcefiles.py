"""Source files that nobody wrote by hand for their repository: generated, minified, third-party, or data saved as code.

Each text is lexed by the rules of its language (comments, strings, regular expressions, numbers, words, signs), printed
again in canonical layout (one statement or bracket a line, one space between words) and compared with the layout it came in:
* extreme expansion, many canonical lines for one original line: minified;
* perfect uniformity, nearly all canonical lines being repetitions of the same few lines but for their numbers: generated;
* literal dominance, most of the code being strings and numbers: data saved as code. So are files that are binary under a
  source extension, by their flag or by the control characters in their text.
Third-party copies look like hand-written code, so no layout tells them. They are told by where they lie (a directory for
foreign packages with a package directory in it), by the notice at their head (a foreign copyright, an upstream address), or
by being the same code as a file so told. Files without text are judged by their path alone.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.session import materialise

# Extensions of source code, directories and names by convention.
SOURCE_EXTENSIONS = ("go", "js", "ts", "py", "java", "c", "h", "css", "rs")
FOREIGN_DIRECTORIES = ("vendor", "third_party", "third-party", "thirdparty", "node_modules", "bower_components", "Pods", "site-packages", "external", "deps", "bundled")
GENERATED_DIRECTORIES = ("generated", "gen", "autogen")
BUNDLE_DIRECTORIES = ("dist", "static", "assets", "public", "build", "out")
GENERATED_NAME = r"(?:\.(?:generated|gen|pb|pb-c|tab|g|designer)\.\w+|_(?:gen|generated|pb|pb2|pb2_grpc|string)\.\w+|(?:Grpc|OuterClass)\.java)$|^zz_generated\."
MINIFIED_NAME = r"[.-]min\.(?:js|css)$"
HASHED_NAME = r"-[0-9a-f]{6,}\.(?:js|css)$"

# The lexical rules by family of languages. Longer rules stand before shorter ones; newlines are lexemes of their own.
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"?"
_TRIPLE = r"\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)"
_NUMBERS = r"(?P<number>(?<![\w$.])(?:0[xX][0-9a-fA-F_]+|0[bBoO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[a-zA-Z%]*)"
_REST = r"(?P<line>\n\s*)|(?P<blob>[A-Za-z0-9+/]{60,}={0,2})|" + _NUMBERS + r"|(?P<word>[^\W\d][\w$]*)|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<sign>[-+*/%=<>!&|^~?:.,@\#$\;]|[^\s\w])"
_SLASHES = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
_REGEX = r"(?P<before>[=(,:;!&|?{}\[+\n]\s*|\b(?:return|typeof|case|in|of)\s+)(?P<regex>/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*)"
_FAMILIES = {
    "c": rf"{_SLASHES}|(?P<directive>^[ \t]*\#(?:\\\n|[^\n])*)|(?P<string>(?:u8|[LuUR])?{_QUOTED}|'(?:\\[^\n]{{1,9}}?|[^'\\\n])'){'|'}{_REST}",
    "java": rf"{_SLASHES}|(?P<string>{_TRIPLE}|{_QUOTED}|'(?:\\[^\n]{{1,6}}?|[^'\\\n])')|{_REST}",
    "go": rf"{_SLASHES}|(?P<string>`[^`]*`?|{_QUOTED}|'(?:\\[^\n]{{1,9}}?|[^'\\\n])')|{_REST}",
    "rs": rf"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>b?r(?P<hashes>\#*)\".*?\"(?P=hashes)|b?{_QUOTED}|b?'(?:\\[^\n]{{1,9}}?|[^'\\\n])')|(?P<lifetime>'[^\W\d]\w*)|{_REST}",
    "js": rf"{_SLASHES}|(?P<string>`(?:\\.|[^`\\])*`?|{_QUOTED}|'(?:\\.|[^'\\\n])*'?)|{_REGEX}|(?P<private>\#[^\W\d]\w*)|{_REST}",
    "py": rf"(?P<comment>\#[^\n]*)|(?P<string>[bBrRuUfF]{{0,2}}(?:{_TRIPLE}|'''(?:\\.|[^\\])*?(?:'''|\Z)|{_QUOTED}|'(?:\\.|[^'\\\n])*'?))|{_REST}",
    "css": rf"(?P<comment>/\*.*?(?:\*/|\Z))|(?P<string>{_QUOTED}|'(?:\\.|[^'\\\n])*'?|\burl\([^)\n]*\))|(?P<colour>\#[0-9a-fA-F]{{3,8}}\b)|{_REST}",
}
_LEXERS = {k: re.compile(v, re.S | re.M) for k, v in _FAMILIES.items()}
_LEXERS |= {"h": _LEXERS["c"], "ts": _LEXERS["js"]}
_SAME = {"hashes": "string", "blob": "string", "colour": "number", "lifetime": "word", "private": "word"}
# Languages whose statements a line end closes.
_LINE_ENDS = frozenset(("go", "js", "ts", "py"))
# Signs after which a word needs no space, and those after which a statement goes on in the next line.
_TIGHT = frozenset("-+*/%=<>!&|^~?:.,@#$;([{\\")
_GOES_ON = frozenset(",.+-*/=&|?:<(")
_DIGITS = re.compile(r"\d+")
_CONTROL = re.compile("[\x00-\x08\x0e-\x1a\ufffd]")
_TOLD = re.compile(r"\w")
_HEAD = re.compile(r"\A\s*((?:(?://|\#(?!include|define|!)|--|\*)[^\n]*\n?\s*|/\*.*?\*/\s*)+)", re.S)
_GENERATOR = re.compile(r"\bgenerated (?:by|from|with|using|code|file|source)\b|\bauto-?generated\b|@generated\b|do not (?:edit|modify)|automatically (?:created|generated|produced) (?:by|from)|changes will be lost", re.I)
_SOURCE = re.compile(r"^\W*(?:source: \S+/\S+\.\w+|line \d+ \"[^\"]+\")\W*$", re.M)
_FOREIGN = re.compile(r"\bvendored from\b|\bcopied (?:verbatim )?from\b|\bcopied verbatim\b|\bimported without modification\b|^\W*upstream: \S+://|\bv\d+\.\d+(?:\.\d+)?\s+(?:--|-|–)\s+https?://", re.I | re.M)
_HOLDER = re.compile(r"copyright (?:\(c\) )?(?:\d{4}(?:-\d{4})? )?(?:by )?the (\w+) authors", re.I)


@dataclass(frozen=True)
class Limits:
    """expansion: canonical lines a line; uniform: share of lines that repeat; literal: share of code characters; control:
    share of control and replacement characters in any stretch."""

    expansion: float = 3.0
    uniform: float = 0.7
    literal: float = 0.5
    control: float = 0.1
    min_repeats: int = 5


def lexemes(text: str, extension: str) -> list[tuple[str, str]]:
    """(kind, lexeme) of a text without its comments; kinds: string, number, word, sign, open, close, line, directive."""
    text = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("#!"):
        text = text.partition("\n")[2]
    out: list[tuple[str, str]] = []
    for m in _LEXERS.get(extension, _LEXERS["c"]).finditer(text):
        kind = m.lastgroup
        if kind == "regex":  # its rule has taken what stands before it, too
            before = m.group("before")
            if sign := before.strip():
                out.append(("word" if sign[0].isalpha() else "open" if sign in "({[" else "close" if sign == "}" else "sign", sign))
            if "\n" in before:
                out.append(("line", "\n"))
            out.append(("string", m.group("regex")))
        elif kind != "comment":
            out.append((_SAME.get(kind, kind), m.group()))
    return out


def printed(found: list[tuple[str, str]], extension: str) -> list[str]:
    """The lexemes in canonical layout: a line for each statement, opening and closing brace, without indentation."""
    lines: list[str] = []
    line = ""
    inside = 0  # brackets that are open and no block
    stack: list[bool] = []  # of each open bracket whether it is a block
    by_line, brace_free = extension in _LINE_ENDS, extension == "py"
    for kind, lexeme in found:
        if kind == "word" or kind == "string" or kind == "number":
            line += " " + lexeme if line and line[-1] not in _TIGHT else lexeme
        elif kind == "sign":
            if lexeme == ";" and not inside:
                if line:
                    lines.append(line)
                    line = ""
            else:
                line += lexeme
        elif kind == "line":
            if by_line and line and not inside and (brace_free or line[-1] not in _GOES_ON):
                lines.append(line)
                line = ""
        elif kind == "open":
            line += lexeme
            block = lexeme == "{" and not inside
            stack.append(block)
            if block:
                lines.append(line)
                line = ""
            else:
                inside += 1
        elif kind == "close":
            if stack and not stack.pop():
                inside -= 1
                line += lexeme
            elif inside:
                line += lexeme
            else:
                if line:
                    lines.append(line)
                    line = ""
                lines.append(lexeme)
        else:  # a directive of the preprocessor
            if line:
                lines.append(line)
                line = ""
            lines.append(" ".join(lexeme.split()))
    if line:
        lines.append(line)
    return lines


def layout(text: str, extension: str) -> tuple[float, float, float, int, list[str]]:
    """(expansion, uniformity, literal share, repeated lines, canonical lines) of a text."""
    found = lexemes(text, extension)
    size = literal = original = 0
    filled = False  # whether the original line has code; strings may go over several
    for kind, x in found:
        if kind == "line":
            original += filled
            filled = False
            continue
        filled = True
        size += len(x)
        if kind == "string" or kind == "number":
            literal += len(x)
            if "\n" in x:
                original += x.count("\n")
    lines = printed(found, extension)
    forms = Counter(_DIGITS.sub("0", "\n".join(lines)).split("\n"))
    telling = [(f, n) for f, n in forms.items() if len(f) > 3 and _TOLD.search(f)]
    repeats = sum(n for _, n in telling if n > 2) if any(n > 2 and "0" in f for f, n in telling) else 0
    return len(lines) / max(1, original + filled), repeats / max(1, sum(n for _, n in telling)), literal / max(1, size), repeats, lines


def notice(text: str, repo: str | None) -> str | None:
    """generated or third-party by the comment at the head of the text; None if it says neither."""
    head = _HEAD.match(text.lstrip("﻿").replace("\r\n", "\n"))
    if not head:
        return None
    said = head.group(1)
    holders = {h.lower() for h in _HOLDER.findall(said)}
    if _FOREIGN.search(said) or (repo and holders and repo.lower() not in holders):
        return "third-party"
    if _GENERATOR.search(said) or _SOURCE.search(said):
        return "generated"
    return None


def judge(text: str | None, extension: str, repo: str | None, limits: Limits = Limits()) -> str | None:
    """Why a text isn't hand-written (minified, generated, data, third-party), or None."""
    return examined(text, extension, repo, limits)[0]


def examined(text: str | None, extension: str, repo: str | None, limits: Limits = Limits()) -> tuple[str | None, int | None]:
    """(judge, key of the code without comments and layout; None if there is none)."""
    if not isinstance(text, str) or not text or text.isspace():
        return None, None
    # binary data may begin anywhere, so the worst stretch of 4,096 characters counts
    places = [m.start() for m in _CONTROL.finditer(text)]
    many = int(limits.control * min(len(text), 4096))
    if any(last - first < 4096 for first, last in zip(places, places[many:])):
        return "data", None
    expansion, uniform, literal, repeats, lines = layout(text, extension)
    key = int.from_bytes(_digest("\n".join(lines)), "little", signed=True) if lines else None
    if literal >= limits.literal:
        return "data", key
    if expansion >= limits.expansion and uniform < limits.uniform:
        return "minified", key
    if uniform >= limits.uniform and repeats >= limits.min_repeats:
        return "generated", key
    return notice(text, repo), key


def source_extension(extension: Column, name: Column) -> Column:
    """The extension in lower case, without dots and blanks; taken from the name where it is NULL."""
    plain = F.lower(F.regexp_replace(F.coalesce(extension, F.regexp_extract(name, r"\.([^.]*)$", 1)), r"[\s.]+", ""))
    return F.when(plain != "", plain)


def _segment(names: tuple[str, ...]) -> str:
    return "(?:" + "|".join(re.escape(n) for n in names) + ")"


def foreign_path(path: Column) -> Column:
    """Whether a path (below its repository's root) lies in a package of a directory for foreign packages."""
    return path.rlike(rf"^[^/]+/(?:.*/)?{_segment(FOREIGN_DIRECTORIES)}/[^/]+/.+")


def generated_path(path: Column, name: Column) -> Column:
    by_bundle = path.rlike(rf"/{_segment(BUNDLE_DIRECTORIES)}/") & name.rlike(HASHED_NAME)
    return name.rlike(GENERATED_NAME) | name.rlike(MINIFIED_NAME) | by_bundle | path.rlike(rf"^[^/]+/(?:.*/)?{_segment(GENERATED_DIRECTORIES)}/")


def judged_files(nodes: DataFrame, contents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(node_id, reason) of every source file; reason NULL: hand-written as far as can be told.

    Re-scanned rows of a node count once (the latest, NULLs last). Files without text, or with an empty one, are judged by
    path. NULL paths and names count as empty. A text whose code equals that of a third-party file elsewhere is a copy too,
    however short; the comparison shuffles 8-byte hashes of the texts, never pairs of equal ones, and spreads each hash over
    several tasks, since short texts are often the same.
    """
    seen = F.struct(F.col("scanned_at"), F.col("extension"), F.col("is_binary").cast("int"))
    files = (
        nodes.where("node_kind = 'file' AND node_id IS NOT NULL")
        .groupBy("node_id")
        .agg(*(F.max_by(F.coalesce(F.col(c), F.lit("")), seen).alias(c) for c in ("repo_slug", "node_path", "node_name")), F.max("extension").alias("extension"), F.max("is_binary").alias("is_binary"))
        .withColumn("extension", source_extension(F.col("extension"), F.col("node_name")))
        .where(F.col("extension").isin(*SOURCE_EXTENSIONS))
    )
    texts = contents.where("node_id IS NOT NULL").groupBy("node_id").agg(F.max("content").alias("content"))

    @F.pandas_udf("struct<reason: string, sameness: bigint>")
    def by_text(text: pd.Series, extension: pd.Series, repo: pd.Series) -> pd.DataFrame:
        found = [examined(t, e, r, limits) for t, e, r in zip(text, extension, repo)]
        return pd.DataFrame({"reason": [r for r, _ in found], "sameness": pd.array([k for _, k in found], dtype="Int64")})

    judged = files.join(texts, "node_id", "left").withColumn("t", by_text("content", "extension", "repo_slug"))
    blank = F.trim(F.coalesce(F.col("content"), F.lit(""))) == ""
    by_path = F.when(F.col("is_binary"), "data").when(foreign_path(F.col("node_path")), "third-party").when(blank & generated_path(F.col("node_path"), F.col("node_name")), "generated")
    own = materialise(judged.select("node_id", F.coalesce(by_path, F.col("t.reason")).alias("reason"), F.col("t.sameness").alias("sameness")))
    salts = 16
    copies = own.where("reason = 'third-party' AND sameness IS NOT NULL").select("sameness").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asking = own.where("reason IS NULL AND sameness IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("node_id"), F.lit(salts)).cast("int"))
    asking = asking.join(copies.withColumn("copied", F.lit("third-party")), ["sameness", "salt"], "left")
    told = own.where("reason IS NOT NULL OR sameness IS NULL").select("node_id", "reason")
    return told.unionByName(asking.select("node_id", F.col("copied").alias("reason")))


def _digest(text: str) -> bytes:
    import xxhash

    return xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass"))
