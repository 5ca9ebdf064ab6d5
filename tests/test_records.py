import json
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeline.functions import values as V
from treeline.operators import nested, sessions, skew, wide
from treeline.queries import records

VALUES = "entry_id bigint, node_path string, metric string, metric_kind string, raw_value string, loaded_at timestamp, q string, kind string"


def cells(spark, rows):
    t0 = datetime(2025, 1, 1)
    data = [(i, *r[:2], None, r[2], None if r[3] is None else t0 + timedelta(hours=r[3]), "x", "y") for i, r in enumerate(rows)]
    w, kinds = wide.wide_table(wide.metric_cells(spark.createDataFrame(data, VALUES)), "node_path")
    return {(r.node_path, r.metric): r.cell_value for r in wide.melt_cells(w, "node_path", kinds).collect()}, w, kinds


def test_wide_values_and_ties(spark):
    got, w, kinds = cells(
        spark,
        [
            ("a", "file-size", "1,234", 1),
            ("a", "FileSize", "n/a", 2),
            ("a", " file_size ", "7.5", 3),
            ("a", "stdlib.imports", "34e2", 1),
            ("a", "Comment Ratio", "0,5", 1),
            ("a", "commentRatio", "516e-3", 2),
            ("b", "risk tier", "  high  ", 1),
            ("b", "RISK-TIER", "low", 1),
            ("b", "risk-tier", "none", None),
            ("b", "file-lines", "<9>", 1),
            (None, "file-size", "1", 1),
            ("c", "file-size", "", 1),
            ("c", None, "1", 1),
            ("d", "file-size", "3", None),
            ("e", "file-type", "x" * 100_000, 1),
        ],
    )
    assert got == {
        ("a", "file-size"): "1234",
        ("a", "stdlib.imports"): "3400",
        ("a", "comment-ratio"): "0.516",
        ("b", "risk-tier"): "low",
        ("d", "file-size"): "3",
        ("e", "file-type"): "x" * 100_000,
    }
    assert kinds["risk-tier"] == "classification" and dict(w.dtypes)["file-size"] == "bigint"
    assert w.count() == 4


def test_wide_empty(spark):
    got, w, kinds = cells(spark, [])
    assert got == {} and w.columns == ["node_path"] and w.count() == 0


def test_wide_clash_and_bound(spark):
    with pytest.raises(ValueError):
        wide.wide_table(wide.metric_cells(spark.createDataFrame([(1, "a", "entity", None, "x", None, "", "")], VALUES)), "entity")
    rows = wide.metric_cells(spark.createDataFrame([(i, "a", f"m{i}x", None, "v", None, "", "") for i in range(5)], VALUES))
    with pytest.raises(ValueError):
        wide.wide_table(rows, "node_path", max_columns=3)


def test_wide_dense_tables_agree(spark):
    rows = [(f"p{i}", m, str(i), 1) for i in range(60) for m in (["file-size", "imports"] if i % 3 else ["file-size", "layer"])]
    got, w, _ = cells(spark, rows)
    assert len(got) == 120 and w.count() == 60


def test_sets_are_merged_into_few_groups(spark):
    r = random.Random(4)
    names = [f"m{k:02d}x" for k in range(14)]
    rows = [(f"p{i}", m, f"{m}{i}", 1) for i in range(400) for m in r.sample(names, r.randrange(1, 9))] + [(f"q{i}", "file-size", "7", 1) for i in range(50)]
    df = wide.metric_cells(spark.createDataFrame([(i, *x[:2], None, x[2], None, "x", "y") for i, x in enumerate(rows)], VALUES))
    known = wide.characteristic_sets(wide.latest_cells(df))
    tree = wide.merged_sets(known, 9, 100)
    leaves = tree.leaves()
    assert len(leaves) == 9 and sorted(g.number for g in leaves) == list(range(9)) and sum(g.n for g in leaves) == 450
    placed = known.select("sig", tree.place(F.col("sig")).alias("g")).collect()
    for g in leaves:
        sets = [x.sig for x in placed if x.g == g.number]
        assert len(sets) == g.n and set(g.columns) == set().union(*sets)
    one = wide.merged_sets(known, 1, 100)
    nulls = [sum(g.n * len(g.columns) - sum(g.columns.values()) for g in t.leaves()) for t in (one, tree)]
    assert nulls[1] < nulls[0]
    for most in (1, 3, 40):
        w, kinds = wide.wide_table(df, "node_path", max_tables=most)
        got = {(x.node_path, x.metric): x.cell_value for x in wide.melt_cells(w, "node_path", kinds).collect()}
        assert got == {(p, m): v for p, m, v, _ in rows} and w.count() == 450


@pytest.mark.parametrize("text,whole,dec", [("1,234", 1234, 1.234), ("+20", 20, 20.0), ("12.0", 12, 12.0), ("1.2.3", None, None), ("45..48", None, None), ("1e2", 100, 100.0), ("1,23,456", None, None), ("NaN", None, None), ("9" * 30, None, 1e30), (" 5\t", 5, 5.0), ("0.971", None, 0.971), ("inf", None, None), ("12abc", None, None)])
def test_numbers(spark, text, whole, dec):
    r = spark.createDataFrame([(text,)], "t string").select(V.whole_number(F.col("t")).alias("w"), V.decimal_number(F.col("t")).alias("d")).first()
    assert r.w == whole and (r.d == pytest.approx(dec) if dec is not None else r.d is None)


def test_distinct_counts_heavy(spark):
    random.seed(1)
    rows = [("hot", f"v{i % 700}", i) for i in range(4000)] + [(f"k{random.randrange(300)}", f"v{random.randrange(9)}", i) for i in range(4000)] + [(None, "x", 0), ("nulls", None, 0)] * 3
    expected = defaultdict(set)
    for k, v, _ in rows:
        if k is not None:
            expected[k] |= {v} - {None}
    df = spark.createDataFrame(rows, "key string, value string, n_distinct bigint")
    assert "hot" in {r.key for r in skew.heavy_keys(df.where("key is not null"), ["key"]).collect()}
    others = defaultdict(set)
    for k, _, n in rows:
        others[k].add(n)
    got = {r.key: (r.n_value, r.n_n_distinct) for r in skew.distinct_counts(df, ["key"], ["value", "n_distinct"]).collect()}
    assert got == {k: (len(v), len(others[k])) for k, v in expected.items()}
    assert skew.distinct_counts(df.limit(0), ["key"], ["value"]).count() == 0
    with pytest.raises(ValueError):
        skew.heavy_keys(df, ["key"], 0.00001)


def brute_sessions(times, threshold):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= threshold:
            out[-1][1] = t
            out[-1][2] += 1
        else:
            out.append([t, t, 1])
    return sorted(map(tuple, out))


def cut(rows, threshold):
    return sorted((r[3], r[4], r[5]) for r in rows if r[1] <= threshold and (r[2] is None or r[2] > threshold))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=60), st.integers(1, 12), st.integers(0, 20))
def test_gap_tree_in_chunks(times, chunk, threshold):
    t, n = np.unique(np.array(times), return_counts=True)
    closed, open_items = [], []
    for a in range(0, len(t), chunk):
        s = t[a : a + chunk]
        for r in sessions.gap_tree(s, s, n[a : a + chunk], np.ones(len(s), bool), "e", whole=False):
            (closed if r[6] else open_items).append(r)
    open_items.sort(key=lambda r: r[3])
    col = lambda i: np.array([r[i] for r in open_items])
    closed += sessions.gap_tree(col(3), col(4), col(5), col(7).astype(bool), "e", whole=True)
    assert cut(closed, threshold) == brute_sessions(times, threshold)


def test_equal_gaps_leave_a_short_spine():
    t = np.arange(0, 60_000, 10)
    rows = sessions.gap_tree(t, t, np.ones(len(t), int), np.ones(len(t), bool), "e", whole=False)
    assert sum(not r[6] for r in rows) <= 4


def test_an_entity_is_cut_into_chunks_by_rows():
    r = random.Random(12)
    times = sorted(r.sample(range(3000), 200))
    frame = pd.DataFrame({"entity": ["e"] * 200 + ["f"], "started": [*times, 5], "ended": [*times, 5], "n": 1, "leaf": True})
    out = pd.concat(list(sessions._chunk(iter([frame[k : k + 7] for k in range(0, 201, 7)]), most=20)))
    mine = out[out["entity"] == "e"]
    assert len(mine[~mine["final"].astype(bool)]) > 20  # several chunks, each with a spine of its own
    merged = pd.concat([mine[mine["final"].astype(bool)], sessions._merge(("e",), mine[~mine["final"].astype(bool)])])
    rows = [(e, g, None if pd.isna(p) else p, a, b, n) for e, g, p, a, b, n in merged.iloc[:, :6].itertuples(index=False)]
    for threshold in (0, 3, 9, 30):
        assert cut(rows, threshold) == brute_sessions(times, threshold)


def test_sessions_spark(spark):
    random.seed(3)
    rows = [(random.choice(["hot"] * 5 + ["b", "c", None]), None if random.random() < 0.05 else random.randrange(5_000), "x") for _ in range(3000)]
    by = defaultdict(list)
    for e, t, _ in rows:
        if e is not None and t is not None:
            by[e].append(t)
    tree = sessions.session_tree(spark.createDataFrame(rows, "who string, at bigint, started string"), "who", "at")
    for threshold in (0, 2, 5, 40):
        got = sorted((r.entity, r.started, r.ended, r.n) for r in sessions.sessions(tree, threshold).collect())
        assert got == sorted((e, *s) for e, ts in by.items() for s in brute_sessions(ts, threshold))
    assert sessions.session_tree(spark.createDataFrame([], "who string, at bigint"), "who", "at").count() == 0


def brute_tree(top):
    out = []

    def walk(node, above, kind):
        name = node.get("name") or (node.get("path") or "").rsplit("/", 1)[-1]
        path = name if above is None else above + "/" + name
        out.append((path, above or "", kind))
        for key, k in (("directories", "dir"), ("files", "file")):
            value = node.get(key)
            for x in [value] if isinstance(value, dict) else value or []:
                if isinstance(x, dict):
                    walk(x, path, k)

    walk(top, None, "dir")
    return out


def test_nested_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/export_payloads.parquet").collect()
    expected = set()
    for r in rows:
        try:
            top = json.loads(r.payload).get("root")
        except ValueError:
            continue
        if top:
            expected |= {(r.export_id, *x) for x in brute_tree(top)}
    got = records.p5_found(spark, sf_dir).collect()
    assert len(got) == len(expected) and {(r.export_id, r.node_path, r.parent_path, r.node_kind) for r in got} == expected


def test_nested_tables_and_edges(spark):
    doc = {"root": {"name": "r", "owner": {"id": 7, "team": {"x": "y"}}, "quantities": {"a": 1}, "directories": {"path": "/q/d", "files": [None, {"name": "f", "measures": None}]}, "files": None}}
    deep = {"name": "n"}
    for _ in range(400):
        deep = {"name": "n", "directories": [deep]}
    data = [("1", json.dumps(doc), "z"), ("2", "{bad", "z"), ("3", None, "z"), ("4", '{"root": null}', "z"), ("5", "[]", "z"), (None, json.dumps(doc), "z"), ("6", "", "z"), ("7", json.dumps({"root": deep}), "z")]
    rows, columns = nested.shred(spark.createDataFrame(data, "id string, payload string, doc string"), "id", "payload", nested.EXPORT_SHAPE)
    assert set(columns["directories"]) == {"name", "path", "owner.id", "owner.team.x"}
    dirs = nested.table_of(rows, columns, "directories").where("doc = '1'").orderBy("row_no").collect()
    assert [(r.label_path, r.parent_path, r["owner.id"]) for r in dirs] == [("r", "", 7), ("r/d", "r", None)]
    file = nested.table_of(rows, columns, "files").first()
    assert (file.label_path, file.parent_element) == ("r/d/f", "directories") and file.parent_no == dirs[1].row_no
    q = nested.table_of(rows, columns, "quantities").first()
    assert (q.key, q.value, q.parent_no) == ("a", 1, dirs[0].row_no)
    assert rows.where("doc = '7'").count() == 401
    assert {r.doc for r in rows.select("doc").distinct().collect()} == {"1", "7"}
    empty, cols = nested.shred(spark.createDataFrame([], "id string, payload string"), "id", "payload", nested.EXPORT_SHAPE)
    assert empty.count() == 0 and cols == {}


@pytest.mark.parametrize("name", sorted(records.QUERIES))
def test_queries_without_rows_and_with_nulls(spark, bare_tables, name):
    assert [records.QUERIES[name](spark, d).count() for d in bare_tables] == [0, 0]
