"""Metric expressions: [filter.]metric[.aggregation], parsed, resolved against the registry and typed."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from treeline.plans.registry import CLASSIFICATION, DIRECTORY, FILE, MEASURE, QUANTITY, Metric, Registry

# The aggregation verbs.
NUMERIC_VERBS = ("sum", "min", "max", "mean", "count", "range")
TEXT_VERBS = ("mode", "distinct")
VERBS = NUMERIC_VERBS + TEXT_VERBS

_SEGMENT = re.compile(r"[a-z][a-z0-9-]*")


class ExpressionError(ValueError):
    """An expression that can't be parsed or resolved."""


class UnknownMetric(ExpressionError):
    pass


class BadFilter(ExpressionError):
    pass


class BadAggregation(ExpressionError):
    pass


@dataclass(frozen=True)
class Expression:
    base: str
    filter: str = ""
    aggregation: str = ""

    def __str__(self) -> str:
        return ".".join(s for s in (self.filter, self.base, self.aggregation) if s)

    @property
    def stored_name(self) -> str:
        """The file-level column that holds the filtered metric."""
        return ".".join(s for s in (self.filter, self.base) if s)


@dataclass(frozen=True)
class Resolved:
    expression: Expression
    metric: Metric
    target: str
    kind: str

    @property
    def name(self) -> str:
        return str(self.expression)


def parse(text: str) -> Expression:
    """At most three segments. Two are metric.verb if the second is a verb, else filter.metric."""
    parts = text.split(".")
    for p in parts:
        if not _SEGMENT.fullmatch(p):
            raise ExpressionError(f"bad segment {p!r} in {text!r}")
    match parts:
        case [base]:
            return Expression(base)
        case [base, verb] if verb in VERBS:
            return Expression(base, "", verb)
        case [flt, base]:
            return Expression(base, flt)
        case [flt, base, verb]:
            if verb not in VERBS:
                raise BadAggregation(f"{verb!r} in {text!r}")
            return Expression(base, flt, verb)
    raise ExpressionError(f"too many segments in {text!r}")


def result_kind(metric: Metric, aggregation: str) -> str:
    return {"": metric.kind, "mean": MEASURE, "count": QUANTITY, "distinct": QUANTITY, "mode": CLASSIFICATION}.get(aggregation, metric.kind)


def resolve(expression: Expression | str, registry: Registry, target: str = FILE) -> Resolved:
    """The metric and the kind of an expression reported at a level; a typed error if it has none there."""
    e = parse(expression) if isinstance(expression, str) else expression
    metric = registry.get(e.base)
    if metric is None:
        raise UnknownMetric(e.base)
    if e.filter and e.filter not in metric.filters:
        raise BadFilter(f"{e.base} has no filter {e.filter}; it has {', '.join(metric.filters) or 'none'}")
    if not e.aggregation:
        if metric.level != target:
            raise BadAggregation(f"{e} is a {metric.level} metric and needs an aggregation")
        return Resolved(e, metric, target, metric.kind)
    if e.aggregation not in metric.aggregations:
        raise BadAggregation(f"{e.base} has no {e.aggregation}; it has {', '.join(metric.aggregations) or 'none'}")
    if metric.level == DIRECTORY or (metric.level == FILE and target == FILE):
        raise BadAggregation(f"{e.base} is already at its level")
    return Resolved(e, metric, target, result_kind(metric, e.aggregation))


def check(expression: Expression | str, registry: Registry) -> Resolved:
    """Resolve at file level if there is no aggregation, else at directory level."""
    e = parse(expression) if isinstance(expression, str) else expression
    return resolve(e, registry, DIRECTORY if e.aggregation else FILE)


def valid_expressions(registry: Registry) -> list[Expression]:
    """Every expression that some level can report, in order of its text."""
    found = []
    for m in registry.all():
        for f in ("", *m.filters):
            if m.level == FILE:
                found.append(Expression(m.name, f))
            found += [Expression(m.name, f, a) for a in m.aggregations]
    return sorted(found, key=str)


@dataclass(frozen=True)
class Request:
    """What a view asks for: metrics to load as they are, and expressions to roll up."""

    loads: tuple[str, ...]
    rollups: tuple[Resolved, ...]

    @property
    def levels(self) -> set[str]:
        """The fact tables that must be read."""
        return {FILE for _ in self.loads} | {r.metric.level for r in self.rollups}


def classify(requested: Iterable[str], registry: Registry) -> Request:
    """Split what is asked for, each once and in order, into loads and roll-ups; a roll-up loads its base metric too."""
    loads: dict[str, None] = {}
    rollups: dict[str, Resolved] = {}
    for text in requested:
        if not text:
            continue
        r = check(text, registry)
        if r.metric.level == FILE:
            loads[r.expression.stored_name] = None
        if r.expression.aggregation:
            rollups[r.name] = r
    return Request(tuple(loads), tuple(rollups.values()))


def loader_levels(needs: dict[str, set[str]]) -> list[list[str]]:
    """Loaders in levels, each level needing only earlier ones; a cycle or an unknown need raises ValueError."""
    from graphlib import CycleError, TopologicalSorter

    unknown = set().union(*needs.values(), set()) - needs.keys()
    if unknown:
        raise ValueError(f"nobody provides {', '.join(sorted(unknown))}")
    order = TopologicalSorter(needs)
    try:
        order.prepare()
    except CycleError as e:
        raise ValueError(f"cycle: {e.args[1]}") from e
    out = []
    while order.is_active():
        ready = sorted(order.get_ready())
        out.append(ready)
        order.done(*ready)
    return out


def default_directory_aggregation(metric: Metric) -> str:
    """The expression that stands for a metric on a directory: sum of quantities, mean of measures, else mode; "" if unsupported."""
    verb = {QUANTITY: "sum", MEASURE: "mean"}.get(metric.kind, "mode")
    return f"{metric.name}.{verb}" if verb in metric.aggregations else ""


def numeric_role(expression: str, registry: Registry) -> Resolved:
    """Resolve for a role that needs numbers (a size, a position)."""
    r = check(expression, registry)
    if r.kind == CLASSIFICATION:
        raise ExpressionError(f"{expression} isn't numeric")
    return r

