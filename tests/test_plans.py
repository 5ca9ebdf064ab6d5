import pytest

from treeline.plans import expr
from treeline.plans.registry import DIRECTORY, FILE, DuplicateMetric, Metric, base_registry, kind_of

REG = base_registry()


@pytest.mark.parametrize("text,parts", [("file-size", ("file-size", "", "")), ("file-size.sum", ("file-size", "", "sum")), ("public.types", ("types", "public", "")), ("public.types.count", ("types", "public", "count"))])
def test_parse(text, parts):
    e = expr.parse(text)
    assert (e.base, e.filter, e.aggregation) == parts and str(e) == text


@pytest.mark.parametrize("text", ["", "a.b.c.d", "File", "1a", "a..b", "public.types.total", "a b"])
def test_parse_errors(text):
    with pytest.raises(expr.ExpressionError):
        expr.parse(text)


def test_resolve_errors():
    for text, error in (("nothing", expr.UnknownMetric), ("public.file-size", expr.BadFilter), ("file-type.sum", expr.BadAggregation), ("types", expr.BadAggregation)):
        with pytest.raises(error):
            expr.check(text, REG)
    with pytest.raises(expr.BadAggregation):
        expr.resolve("file-size.sum", REG, FILE)
    assert expr.resolve("declarations.count", REG, FILE).kind == "quantity"


def test_kinds_and_catalogue():
    kinds = {t: expr.check(t, REG).kind for t in ("file-size.mean", "file-size.max", "file-type.mode", "file-type.distinct", "comment-ratio.max", "types.count")}
    assert kinds == {"file-size.mean": "measure", "file-size.max": "quantity", "file-type.mode": "classification", "file-type.distinct": "quantity", "comment-ratio.max": "measure", "types.count": "quantity"}
    every = expr.valid_expressions(REG)
    assert len(every) == 158 and sum(not e.aggregation for e in every) == 24
    assert all(expr.check(e, REG) for e in every)
    assert len(REG.names()) == 34


def test_request_and_loaders():
    r = expr.classify(["file-size", "file-size.sum", "file-size", "stdlib.imports.max", "types.count", ""], REG)
    assert r.loads == ("file-size", "stdlib.imports") and [x.name for x in r.rollups] == ["file-size.sum", "stdlib.imports.max", "types.count"]
    assert r.levels == {"file", "declaration"}
    assert expr.loader_levels({"c": {"a", "b"}, "a": set(), "b": {"a"}, "d": set()}) == [["a", "d"], ["b"], ["c"]]
    with pytest.raises(ValueError):
        expr.loader_levels({"a": {"b"}, "b": {"a"}})
    with pytest.raises(ValueError):
        expr.loader_levels({"a": {"x"}})


def test_registry():
    reg = REG.copy()
    reg.register(Metric("layer", "classification", FILE))
    with pytest.raises(DuplicateMetric):
        reg.register(Metric("layer", "classification", FILE))
    assert kind_of("stdlib.imports") == "quantity" and kind_of("layer") == "classification" and kind_of("odd.imports") == "classification"
    assert expr.default_directory_aggregation(REG.get("file-size")) == "file-size.sum"
    assert expr.default_directory_aggregation(REG.get("bus-factor")) == "bus-factor.sum"
    assert expr.default_directory_aggregation(REG.get("commit-density")) == ""
    with pytest.raises(expr.ExpressionError):
        expr.numeric_role("file-type", REG)
    assert expr.resolve("types.count", REG, DIRECTORY).target == DIRECTORY
