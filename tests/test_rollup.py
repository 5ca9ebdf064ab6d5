"""The golden tree: seeded values for every metric, rolled up by every valid expression."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from treeline.operators import rollup, tree
from treeline.plans.expr import check, resolve, valid_expressions
from treeline.plans.registry import CLASSIFICATION, COMMIT, DECLARATION, FILE, MEASURE, QUANTITY, base_registry

REG = base_registry()
FILES = ("root/a.go", "root/b.go", "root/sub/c.go", "root/sub/deep/d.go")
DECLS = (("PublicType", "type", "public"), ("privateType", "type", "private"), ("PublicFunc", "function", "public"), ("privateFunc", "function", "private"), ("PublicMethod", "method", "public"), ("privateConst", "constant", "private"))


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) & (2**64 - 1)
    return h


def value(m, node, flt=""):
    h = fnv(f"{m.name}|{node}" + (f"|{flt}" if flt else ""))
    return {QUANTITY: h % 1000 + 1, MEASURE: (h % 10000) / 100, CLASSIFICATION: ("alpha", "beta", "gamma", "delta")[h % 4]}[m.kind]


@pytest.fixture(scope="module")
def facts(spark):
    types = {QUANTITY: "bigint", MEASURE: "double", CLASSIFICATION: "string"}
    file_metrics = [(m, f) for m in REG.at_level(FILE) for f in ("", *m.filters)]
    rows = [(p.rsplit("/", 1)[0], p, *(value(m, p, f) for m, f in file_metrics)) for p in FILES]
    schema = "dir string, file_path string, " + ", ".join(f"`{f + '.' if f else ''}{m.name}` {types[m.kind]}" for m, f in file_metrics)
    decl_metrics = REG.at_level(DECLARATION)
    decls = [(p.rsplit("/", 1)[0], p, k, v, *(value(m, f"{p}/{n}") for m in decl_metrics)) for p in FILES for n, k, v in DECLS]
    decl_schema = "dir string, file_path string, kind string, visibility string, " + ", ".join(f"`{m.name}` {types[m.kind]}" for m in decl_metrics)
    commit_metrics = REG.at_level(COMMIT)
    commits = [(p.rsplit("/", 1)[0], p, *(value(m, f"{p}/commit/{i}") for m in commit_metrics)) for p in FILES for i in (0, 1)]
    commit_schema = "dir string, file_path string, " + ", ".join(f"`{m.name}` {types[m.kind]}" for m in commit_metrics)
    return {FILE: spark.createDataFrame(rows, schema), DECLARATION: spark.createDataFrame(decls, decl_schema), COMMIT: spark.createDataFrame(commits, commit_schema)}


GOLDEN = {
    "author-count.mean": (572.25, 450, 526),
    "bus-factor.sum": (1429, 1048, 901),
    "code-owner.mode": ("delta", "delta", "delta"),
    "comment-ratio.mean": (54.9725, 54.41, 26.69),
    "file-type.distinct": (3, 1, 1),
    "initial-developer.mode": ("beta", "beta", "beta"),
    "cyclomatic-complexity.mean": (526.416667, 591, 505),
    "function-length.sum": (7269, 2658, 1221),
    "private.function-length.max": (950, 320, 320),
    "public.cyclomatic-complexity.mean": (502.5, 596.5, 672.5),
    "declarations.count": (24, 12, 6),
    "public.types.count": (4, 2, 1),
    "stdlib.imports.sum": (851, 596, 491),
    "lines-changed.mean": (556.5, 561.5, 644.5),
    "lines-removed.min": (14, 14, 14),
    "total-lines-removed.mean": (620.25, 882, 804),
    "types.count": (8, 4, 2),
}


def test_every_expression_at_directories(facts):
    wanted = [check(e, REG) for e in valid_expressions(REG) if e.aggregation]
    assert len(wanted) == 134
    out = {r.node_path: r for r in rollup.rollup(facts, wanted).collect()}
    assert set(out) == {"root", "root/sub", "root/sub/deep"}
    present = [r.name for r in wanted if out["root"][r.name] is not None]
    assert len(present) == 123
    absent = {r.name for r in wanted} - set(present)
    assert absent == {f"{p}{n}.count" for n in ("interfaces", "structs", "variables") for p in ("", "public.", "private.")} | {"public.constants.count", "private.methods.count"}
    for name, values in GOLDEN.items():
        got = [out[p][name] for p in ("root", "root/sub", "root/sub/deep")]
        assert [round(g, 6) if isinstance(g, float) else g for g in got] == list(values), name


def test_declarations_at_files(facts):
    names = ["function-length.mean", "private.cyclomatic-complexity.sum", "public.functions.count", "interfaces.count", "types.count"]
    wanted = [resolve(n, REG, FILE) for n in names]
    row = rollup.rollup(facts, wanted, FILE).where("node_path = 'root/a.go'").first()
    assert [round(row["function-length.mean"], 6), *(row[n] for n in names[1:])] == [814.666667, 849, 1, None, 2]


def test_empty_and_null(spark, facts):
    wanted = [check("file-size.sum", REG), check("file-type.mode", REG)]
    assert rollup.rollup({FILE: facts[FILE].limit(0)}, wanted).count() == 0
    rows = spark.createDataFrame([("r/x", None, None), ("r/y", 3, "b"), ("r/y", 4, "a")], "dir string, `file-size` bigint, `file-type` string")
    got = {r.node_path: (r["file-size.sum"], r["file-type.mode"]) for r in rollup.rollup({FILE: rows}, wanted).collect()}
    assert got == {"r": (7, "a"), "r/y": (7, "a")}


def test_random_trees_against_recursion(spark):
    r = random.Random(4)
    dirs = ["t"]
    for i in range(40):
        dirs.append(f"{r.choice(dirs)}/d{i}")
    files = [(d, f"{d}/f{i}", r.randrange(-5, 100) if r.random() < 0.9 else None, r.choice("xyz")) for i in range(300) for d in [r.choice(dirs)]]
    df = spark.createDataFrame(files, "dir string, file_path string, `file-size` bigint, `file-type` string")
    wanted = [resolve(e, REG, "directory") for e in ("file-size.sum", "file-size.min", "file-size.mean", "file-type.mode", "file-type.distinct")]
    got = {x.node_path: x for x in rollup.rollup({FILE: df}, wanted).collect()}
    floor = {x.node_path: x.total for x in rollup.size_with_floor(df.withColumnRenamed("file-size", "s"), "s").collect()}
    for d in dirs:
        below = [f for f in files if f[0] == d or f[0].startswith(d + "/")]
        sizes = [f[2] for f in below if f[2] is not None]
        if not below:
            assert d not in got
            continue
        assert got[d]["file-size.sum"] == (sum(sizes) if sizes else None)
        assert got[d]["file-size.min"] == (min(sizes) if sizes else None)
        kinds = Counter(f[3] for f in below)
        assert got[d]["file-type.mode"] == min(kinds, key=lambda k: (-kinds[k], k)) and got[d]["file-type.distinct"] == len(kinds)
        assert floor[d] == sum(1 if f[2] is None or f[2] <= 0 else f[2] for f in below)


def test_tree_operators(spark):
    rows = [("t", None, "t", "dir", 0), ("t/a", "t", "a", "dir", 1), ("t/a/e", "t/a", "e", "dir", 2), ("t/a/f.go", "t/a", "f.go", "file", 2), ("t/g.md", "t", "g.md", "file", 1), ("t/b", "t", "b", "dir", 1)]
    df = spark.createDataFrame([(i, *r, i == 5) for i, r in enumerate(rows)], "node_id bigint, node_path string, parent_path string, node_name string, node_kind string, tree_depth int, is_binary boolean")
    counts = {r.node_path: (r.direct_files, r.all_files, r.all_dirs) for r in tree.tree_counts(df).collect()}
    assert counts == {"t": (1, 2, 1), "t/a": (1, 1, 0)}
    leaves = {r.node_path: (r.leaf_count, r.max_depth) for r in tree.leaf_counts(df).collect()}
    assert leaves == {"t": (2, 2), "t/a": (1, 1), "t/a/e": (1, 0), "t/b": (1, 0)}
    assert tree.closure(df).count() == 1 + 2 + 3 + 3 + 2 + 2
    with pytest.raises(ValueError):
        tree.require_files(df.where("node_kind = 'dir'"))
    texts = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\nb",), ("\n\n",)], "t string")
    assert [r[0] for r in texts.select(tree.line_count(F.col("t"))).collect()] == [0, 1, 1, 2, 2]
