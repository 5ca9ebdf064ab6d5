"""The catalogue of base metrics: name, kind, level, filters, aggregations, palette."""

from __future__ import annotations

from dataclasses import dataclass, field

QUANTITY, MEASURE, CLASSIFICATION = "quantity", "measure", "classification"
FILE, DECLARATION, COMMIT, DIRECTORY = "file", "declaration", "commit", "directory"
NUMERIC_FULL = ("sum", "min", "max", "mean")
EXTREMES = ("min", "max")


@dataclass(frozen=True)
class Metric:
    """One base metric. decl_kinds limits the declarations it counts; None means all of them."""

    name: str
    kind: str
    level: str
    aggregations: tuple[str, ...] = ()
    filters: tuple[str, ...] = ()
    palette: str = "neutral"
    decl_kinds: tuple[str, ...] | None = None
    patterns: tuple[tuple[str, str], ...] = field(default=(), compare=False)


class DuplicateMetric(ValueError):
    pass


class Registry:
    """Metrics by name; a name can be registered once."""

    def __init__(self, metrics: tuple[Metric, ...] = ()):
        self._by_name: dict[str, Metric] = {}
        for m in metrics:
            self.register(m)

    def register(self, metric: Metric) -> Metric:
        if metric.name in self._by_name:
            raise DuplicateMetric(metric.name)
        self._by_name[metric.name] = metric
        return metric

    def get(self, name: str) -> Metric | None:
        return self._by_name.get(name)

    def names(self) -> list[str]:
        return sorted(self._by_name)

    def all(self) -> list[Metric]:
        return [self._by_name[n] for n in self.names()]

    def at_level(self, level: str) -> list[Metric]:
        return [m for m in self.all() if m.level == level]

    def copy(self) -> "Registry":
        return Registry(tuple(self._by_name.values()))


# The base metrics.
PUBLIC_PRIVATE = ("public", "private")
BASE_METRICS = (
    Metric("file-size", QUANTITY, FILE, NUMERIC_FULL),
    Metric("file-lines", QUANTITY, FILE, NUMERIC_FULL),
    Metric("file-type", CLASSIFICATION, FILE, ("mode", "distinct"), palette="categorization"),
    Metric("file-age", QUANTITY, FILE, NUMERIC_FULL, palette="temperature"),
    Metric("file-freshness", QUANTITY, FILE, NUMERIC_FULL, palette="temperature"),
    Metric("author-count", QUANTITY, FILE, NUMERIC_FULL, palette="good-bad"),
    Metric("commit-count", QUANTITY, FILE, NUMERIC_FULL, palette="temperature"),
    Metric("total-lines-added", QUANTITY, FILE, NUMERIC_FULL, palette="temperature"),
    Metric("total-lines-removed", QUANTITY, FILE, NUMERIC_FULL, palette="temperature"),
    Metric("commit-density", MEASURE, FILE, EXTREMES, palette="temperature"),
    Metric("lines-added", QUANTITY, COMMIT, NUMERIC_FULL, palette="temperature"),
    Metric("lines-removed", QUANTITY, COMMIT, NUMERIC_FULL, palette="temperature"),
    Metric("lines-changed", QUANTITY, COMMIT, NUMERIC_FULL, palette="temperature"),
    Metric("initial-developer", CLASSIFICATION, FILE, ("mode",), palette="categorization"),
    Metric("current-maintainer", CLASSIFICATION, FILE, ("mode",), palette="categorization"),
    Metric("code-owner", CLASSIFICATION, FILE, ("mode",), palette="categorization"),
    Metric("significant-contributor-count", QUANTITY, FILE, NUMERIC_FULL, palette="good-bad"),
    Metric("bus-factor", QUANTITY, FILE, NUMERIC_FULL, palette="good-bad"),
    Metric("ownership-dominance", MEASURE, FILE, EXTREMES, palette="temperature"),
    Metric("contributor-entropy", MEASURE, FILE, EXTREMES, palette="good-bad"),
    Metric("orphan-risk", MEASURE, FILE, EXTREMES, palette="temperature"),
    Metric("knowledge-handoff", MEASURE, FILE, EXTREMES, palette="temperature"),
    Metric("types", QUANTITY, DECLARATION, ("count",), PUBLIC_PRIVATE, decl_kinds=("type", "struct", "interface")),
    Metric("interfaces", QUANTITY, DECLARATION, ("count",), PUBLIC_PRIVATE, decl_kinds=("interface",)),
    Metric("structs", QUANTITY, DECLARATION, ("count",), PUBLIC_PRIVATE, decl_kinds=("struct",)),
    Metric("functions", QUANTITY, DECLARATION, ("count",), PUBLIC_PRIVATE, decl_kinds=("function",)),
    Metric("methods", QUANTITY, DECLARATION, ("count",), PUBLIC_PRIVATE, decl_kinds=("method",)),
    Metric("constants", QUANTITY, DECLARATION, ("count",), PUBLIC_PRIVATE, decl_kinds=("constant",)),
    Metric("variables", QUANTITY, DECLARATION, ("count",), PUBLIC_PRIVATE, decl_kinds=("variable",)),
    Metric("declarations", QUANTITY, DECLARATION, ("count",), PUBLIC_PRIVATE),
    Metric("imports", QUANTITY, FILE, NUMERIC_FULL, ("stdlib", "external", "internal")),
    Metric("cyclomatic-complexity", QUANTITY, DECLARATION, NUMERIC_FULL, PUBLIC_PRIVATE, decl_kinds=("function", "method")),
    Metric("function-length", QUANTITY, DECLARATION, NUMERIC_FULL, PUBLIC_PRIVATE, decl_kinds=("function", "method")),
    Metric("comment-ratio", MEASURE, FILE, ("min", "max", "mean")),
)


def base_registry() -> Registry:
    return Registry(BASE_METRICS)


def kind_of(name: str, registry: Registry | None = None) -> str:
    """The kind of a metric or of one of its filtered forms (stdlib.imports); user-named ones are classifications."""
    registry = registry or base_registry()
    m = registry.get(name)
    if m is None and "." in name:
        lead, _, base = name.partition(".")
        m = registry.get(base)
        if m is not None and lead not in m.filters:
            m = None
    return m.kind if m else CLASSIFICATION


def names_by_kind(registry: Registry | None = None) -> dict[str, list[str]]:
    """Every name, filtered forms included, under its kind."""
    registry = registry or base_registry()
    out: dict[str, list[str]] = {QUANTITY: [], MEASURE: [], CLASSIFICATION: []}
    for m in registry.all():
        out[m.kind] += [m.name, *(f"{f}.{m.name}" for f in m.filters)]
    return out
