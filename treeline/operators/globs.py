"""Ordered include and exclude globs, subtree pruning, and classification by the first glob that matches."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.operators.tree import prefixes

_order = count()


class BadPattern(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    pattern: str
    include: bool
    index: int = field(default_factory=lambda: next(_order), compare=False)

    def __post_init__(self):
        to_regex(self.pattern)

    @property
    def mode(self) -> str:
        return "include" if self.include else "exclude"


def parse_rule(text: str) -> Rule:
    """A leading ! excludes; anything else includes."""
    if not text:
        raise BadPattern("empty filter")
    return Rule(text[1:], False) if text.startswith("!") else Rule(text, True)


def merge_rules(config: Sequence[Rule], include: Sequence[Rule], exclude: Sequence[Rule]) -> list[Rule]:
    """The configured rules first, then the others in the order they were made."""
    return [*config, *sorted([*include, *exclude], key=lambda r: r.index)]


def to_regex(pattern: str) -> str:
    """A glob as a regular expression for whole paths: ** only as a whole segment spans segments; [..] and {a,b} are known."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        whole = i == 0 or pattern[i - 1] == "/"
        if whole and pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif whole and pattern[i:] == "**":
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 2 if pattern.startswith("**", i) else 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise BadPattern(pattern)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
            i += 1
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
            i += 1
        elif c == "," and depth:
            out.append("|")
            i += 1
        elif c == "\\":
            if i + 1 == len(pattern):
                raise BadPattern(pattern)
            out.append(re.escape(pattern[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    if depth or not pattern:
        raise BadPattern(pattern)
    regex = "".join(out)
    if regex.startswith("/"):
        return f"^{regex}$"
    return f"^{regex}$" if pattern.startswith("**/") else f"^(?:[^/]+/)*{regex}$"


def matches(path: Column, pattern: str) -> Column:
    """Unanchored patterns match at any depth; a leading / or **/ anchors."""
    return path.rlike(to_regex(pattern))


def included(path: Column, rules: Sequence[Rule]) -> Column:
    """The first matching rule decides; without one the path is included."""
    out = F.lit(True)
    for r in reversed(rules):
        out = F.when(matches(path, r.pattern), F.lit(r.include)).otherwise(out)
    return out


def kept(relative_path: Column, rules: Sequence[Rule]) -> Column:
    """Whether a path and every directory above it is included: an excluded directory takes all below it along."""
    return F.forall(prefixes(relative_path), lambda p: included(p, rules))


def classify(path: Column, classes: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The name of the first class with a pattern that matches; NULL if there is none."""
    out = F.lit(None).cast("string")
    for name, patterns in reversed(classes):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | matches(path, p)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out
