import json
import math
import os
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.functions import gosource
from treeline.operators import authorship, bucketing, export, globs, history, layout, scatter, timebuckets
from treeline.sources import files
from treeline.streaming import activity


@pytest.mark.parametrize(
    "pattern,path,hit",
    [("*.go", "a/b.go", True), ("*.go", "b.go", True), ("*.go", "b.gox", False), ("/a", "a", False), ("src/**", "src/a/b", True), ("src/**", "x/src/a", True), ("**/x", "x", True), ("**/x", "a/b/x", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("[ab].go", "b.go", True), ("[!ab].go", "b.go", False), ("*.{js,ts}", "q/x.ts", True), (".*", ".git", True), ("a.b", "axb", False), ("a/*/c", "a/b/c", True), ("a/*/c", "a/b/d/c", False)],
)
def test_globs(spark, pattern, path, hit):
    assert spark.createDataFrame([(path,)], "p string").select(globs.matches(F.col("p"), pattern)).first()[0] is hit


def test_rules(spark):
    rules = globs.merge_rules([globs.parse_rule("!.*")], [globs.parse_rule(".config"), globs.parse_rule("*.go")], [globs.parse_rule("!*")])
    assert [r.mode for r in rules] == ["exclude", "include", "include", "exclude"]
    paths = spark.createDataFrame([("a.go",), (".x",), ("d/a.go",), ("b.md",)], "p string")
    assert [r[0] for r in paths.select(globs.included(F.col("p"), rules)).collect()] == [True, False, True, False]
    assert [r[0] for r in paths.select(globs.kept(F.col("p"), rules)).collect()] == [True, False, False, False]
    for bad in ("", "[a", "{a", "a\\"):
        with pytest.raises(globs.BadPattern):
            globs.Rule(bad, True)
    kinds = globs.classify(F.col("p"), (("go", ("*.go",)), ("doc", ("*.md", "*.go"))))
    assert [r[0] for r in paths.select(kinds).collect()] == ["go", None, "go", "doc"]


BASE = datetime(2025, 1, 1)


def us(t):
    return int(t.replace(tzinfo=timezone.utc).timestamp() * 1_000_000)


def owners(spark, rows, active, head, s):
    df = spark.createDataFrame([("f", e, us(t), w) for e, t, w in rows], "node string, email string, at_us bigint, w bigint")
    la = spark.createDataFrame([(e, us(t)) for e, t in active], "email string, last_us bigint")
    return authorship.metrics(authorship.author_records(df, us(head), s), la, us(head), s).first()


def test_authorship_hand_case(spark):
    head = BASE + timedelta(days=100)
    s = authorship.Settings(activity_days=30, recent_days=30)
    r = owners(spark, [("early@x", BASE, 6), ("recent@x", head, 4)], [("early@x", BASE), ("recent@x", head)], head, s)
    assert (r.code_owner, r.initial_developer, r.current_maintainer, r.significant_contributor_count, r.bus_factor) == ("early@x", "early@x", "recent@x", 2, 1)
    assert r.ownership_dominance == pytest.approx(0.6) and r.contributor_entropy == pytest.approx(0.970950594) and r.orphan_risk == pytest.approx(0.6) and r.knowledge_handoff == 1.0
    one = owners(spark, [("one@x", BASE, 1)], [], head, s)
    assert (one.contributor_entropy, one.bus_factor, one.ownership_dominance, one.orphan_risk) == (0, 1, 1, 1)
    nothing = owners(spark, [("a@x", BASE, 0), ("b@x", head, 0)], [], head, s)
    assert (nothing.code_owner, nothing.bus_factor, nothing.ownership_dominance, nothing.contributor_entropy) == (authorship.UNMAINTAINED, 0, 0, 0)
    tie = owners(spark, [("b@x", BASE, 5), ("a@x", BASE, 5), ("c@x", BASE - timedelta(1), 5)], [], head, s)
    assert tie.code_owner == "c@x"


def test_history(spark):
    rows = [(1, "r", "f", "c1", "A", "a@x", BASE, 1, 0, True, 10, 0), (1, "r", "f", "c1", "A", "a@x", BASE, 1, 0, True, 10, 0), (2, "r", "f", "c2", "B", "b@x", BASE + timedelta(days=61), 1, 0, False, 3, 2), (3, "r", "f", "m", "B", "b@x", None, 2, 0, False, None, None), (4, "r", "g", "m", "B", None, BASE, 2, 0, False, 1, 1), (5, "r", "g", "m", "B", None, BASE, 2, 1, False, 1, 1)]
    df = history.touch_facts(spark.createDataFrame(rows, "touch_id bigint, repo_slug string, file_path string, commit_hash string, author_name string, author_email string, touched_at timestamp, n_parents int, parent_idx int, is_creation boolean, added bigint, removed bigint"))
    assert df.count() == 5
    h = history.file_history(df, F.lit(BASE + timedelta(days=70))).where("file_path = 'f'").first()
    assert (h.file_age, h.file_freshness, h.author_count, h.commit_count, h.total_lines_added, h.total_lines_removed) == (70, 9, 2, 2, 3, 2)
    assert h.commit_density == pytest.approx(2 / (61 / 30.44))
    assert {(r.commit_hash, r.file_path) for r in history.changed_against_all_parents(df).collect()} == {("c1", "f"), ("c2", "f"), ("m", "g")}
    more = [(6, "r", "f", "m2", "A", "a@x", BASE + timedelta(days=65), 2, 1, False, 7, 7), (7, "r", "g", "m3", "A", "a@x", BASE, 2, 0, False, 4, 1), (8, "r", "g", "m3", "A", "a@x", BASE, 2, 1, False, 9, 9)]
    own = history.file_changes(spark.createDataFrame(rows + more, df.schema))
    assert {(r.commit_hash, r.file_path, r.added, r.removed) for r in own.collect()} == {("c1", "f", 10, 0), ("c2", "f", 3, 2), ("m", "g", 1, 1), ("m3", "g", 4, 1)}
    h = {r.file_path: r for r in history.file_history(own, F.lit(BASE + timedelta(days=70))).collect()}
    assert (h["f"].file_freshness, h["f"].commit_count, h["g"].commit_count, h["g"].total_lines_added) == (9, 2, 2, 5)
    with pytest.raises(ValueError):
        history.require_history(df.limit(0))


def test_time_grid(spark):
    def counts(times):
        df = spark.createDataFrame([(t, "x") for t in times], "ts timestamp_ntz, event string")
        return [r.events for r in timebuckets.bucket_counts(df, "ts").orderBy("bucket").collect()]

    assert counts([datetime(2025, 1, 1, 5), datetime(2025, 1, 3, 7)]) == [1, 0, 1]
    assert counts([datetime(2025, 1, 1, 5), datetime(2025, 1, 3)]) == [1, 0]  # the last event lies on the upper edge
    assert counts([datetime(2025, 1, 1)] * 3) == []
    assert counts([]) == []


def test_boundaries_against_brute_force(spark):
    r = random.Random(2)
    for values, steps in (([r.uniform(1, 5000) for _ in range(500)], 9), ([1.0, 1.0, 2.0, 2.0], 5), ([3.0] * 9, 4), ([0.0, -7.5, 12.25], 11), ([5.0], 3)):
        got = bucketing.boundaries(spark.createDataFrame([(v,) for v in values], "v double"), "v", steps).first()
        s = sorted(values)

        def sig(v):
            p = 10 ** (2 - math.ceil(math.log10(abs(v)))) if v else 1
            return math.copysign(math.floor(abs(v * p) + 0.5), v) / p

        want = sorted({sig(s[min(i * len(s) // steps, len(s) - 1)]) for i in range(1, steps)}) if steps > 1 and s[0] != s[-1] else []
        assert got.boundaries == [b for b in want if b > s[0]] and (got.min, got.max, got.n) == (s[0], s[-1], len(s))
    df = spark.createDataFrame([(0.5, [1.0, 2.0]), (1.0, [1.0, 2.0]), (9.0, [1.0, 2.0]), (9.0, [])], "v double, b array<double>")
    assert [x[0] for x in df.select(bucketing.bucket_index(F.col("v"), F.col("b"))).collect()] == [0, 1, 2, 0]
    index = bucketing.bucket_index(F.col("v"), F.col("b"))
    assert [x[0] for x in df.select(bucketing.colour_of(index, F.col("b"), "neutral")).collect()] == ["#000000", "#808080", "#ffffff", "#808080"]
    assert bucketing.palette_for(None) == "neutral" and len(bucketing.colours("good-bad")) == 13
    ink = bucketing.coloured(spark.createDataFrame([("go",), ("zz",)], "c string"), "c", bucketing.category_colours(spark.createDataFrame([("go",)], "c string"), "c"))
    assert {x.c: x.colour for x in ink.collect()} == {"go": "#a6cee3", "zz": "#808080"}


def test_ticks():
    assert scatter.ticks(3, 3) == [3]
    for lo, hi in ((0, 1), (3, 97), (-5, 12), (1e-3, 5e-3), (980, 1020), (1, 100)):
        t = scatter.ticks(lo, hi)
        assert 5 <= len(t) <= 11 and t[0] <= lo and t[-1] >= hi
    assert scatter.ticks(1, 100)[0] == 0
    assert scatter.log_ticks(1, 100_000) == [1, 10, 100, 1000, 10_000, 100_000]
    assert scatter.log_ticks(1, 100) == [1, 2, 5, 10, 20, 50, 100]
    assert len(scatter.log_ticks(3, 4)) == 5
    assert scatter.tick_label(2.5, 0.25) == "2.50" and scatter.tick_label(1234567, 0) == "1.23457e+06"


def test_scatter_checks(spark):
    df = spark.createDataFrame([(1, 2, None), (None, 1, 1), (0, 5, 2)], "x int, y int, s int")
    assert tuple(scatter.skipped(df, "x", "y", "s").first()) == (1, 0, 1, 1)
    assert scatter.dataset(df, "x", "y", "s").count() == 1
    with pytest.raises(ValueError, match="x"):
        scatter.require_positive(df, "x", "y")


def test_squarify_fills_the_box():
    r = random.Random(1)
    for n in (1, 2, 7, 60):
        sizes = [r.uniform(1, 50) for _ in range(n)]
        boxes = layout.squarify(2, 3, 90, 40, sizes)
        assert sum(w * h for *_, w, h in boxes) == pytest.approx(90 * 40)
        for s, (x, y, w, h) in zip(sizes, boxes):
            assert w * h == pytest.approx(s / sum(sizes) * 3600) and x >= 2 - 1e-6 and y >= 3 - 1e-6 and x + w <= 92 + 1e-6 and y + h <= 43 + 1e-6
        for i in range(n):
            for j in range(i):
                a, b = boxes[i], boxes[j]
                assert min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]) < 1e-6 or min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]) < 1e-6


def test_circles_do_not_overlap():
    r = random.Random(2)
    for n in (1, 2, 3, 25):
        radii = [r.uniform(1, 10) for _ in range(n)]
        centres, around = layout.pack_circles(radii)
        for i in range(n):
            assert math.hypot(*centres[i]) + radii[i] <= around + 1e-6
            for j in range(i):
                assert math.dist(centres[i], centres[j]) >= radii[i] + radii[j] - 1e-6


def test_spiral_and_surface(spark):
    assert layout.largest_disc(0, 800, 600, 28) == 4.0 and 0 < layout.largest_disc(365, 800, 600, 28) < layout.largest_disc(30, 800, 600, 28)
    unit = [F.lit(float(v)) for v in (0, 0, 2, 2, 0, 0, 10, 10)]
    focus = layout.gradient_focus(tuple(unit[:4]), tuple(unit[4:]), F.lit(0.25))
    assert tuple(spark.range(1).select(*focus).first()) == (1.0, 1.0)
    assert layout.daily_cadence(1, 800, 600) == 28 and layout.daily_cadence(365, 800, 600) in layout.DAILY_CADENCES
    points = layout.poisson_points(50, 40, 4)
    assert all(math.dist(a, b) >= 4 for i, a in enumerate(points) for b in points[:i]) and len(points) > 60
    obs = [(0.0, 0.0, 1.0), (2.0, 0.0, 3.0), (50.0, 50.0, 9.0)]
    got = {(r.px, r.py): r.value for r in layout.interpolate(spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (20.0, 20.0)], "px double, py double"), spark.createDataFrame(obs, "ox double, oy double, value double"), 3.0).collect()}
    assert got[0.0, 0.0] == 1.0 and got[1.0, 0.0] == pytest.approx(2.0) and got[20.0, 20.0] is None
    band = layout.clip_to_band([(0, 0, 0.0), (4, 0, 4.0), (0, 4, 0.0)], 1, 2)
    assert min(p[2] for p in band) == 1 and max(p[2] for p in band) == 2
    assert layout.support_radius(spark.createDataFrame(obs[:2], "ox double, oy double, value double")).first().radius == 4.0


def test_support_radius_against_brute_force(spark):
    r = random.Random(9)
    clustered = [(c + r.random(), c * r.random()) for c in (0.0, 3.0, 900.0) for _ in range(40)] + [(5000.0, 5000.0)] * 3 + [(0.5, 0.5)] * 5
    for places in (clustered, [(float(2**i), 0.0) for i in range(20)]):
        d = sorted(min(x for q in places if (x := math.hypot(p[0] - q[0], p[1] - q[1])) > 0) for p in places)
        df = spark.createDataFrame([(*p, "x") for p in places] + [(None, 1.0, "x")], "ox double, oy double, d string")
        assert layout.support_radius(df).first().radius == pytest.approx(2 * d[math.ceil(0.9 * len(d)) - 1])
    assert layout.support_radius(df.limit(0)).first().radius is None
    assert layout.support_radius(spark.createDataFrame([(1.0, 1.0)] * 4, "ox double, oy double")).first().radius is None


def test_mesh_is_delaunay():
    r = random.Random(10)
    points = [(r.uniform(0, 100), r.uniform(0, 40)) for _ in range(60)] + [(50.0, 20.0)] * 3
    found = layout.delaunay(points)
    for t in found:
        (ax, ay), (bx, by), (cx, cy) = (points[i] for i in t)
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
        uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
        assert all(math.hypot(x - ux, y - uy) >= math.hypot(ax - ux, ay - uy) - 1e-7 for x, y in points)
    square = [(float(x), float(y)) for x in range(5) for y in range(4)]
    assert sum(layout.polygon_area([square[i] for i in t]) for t in layout.delaunay(square)) == pytest.approx(12.0)
    assert layout.delaunay([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]) == [] and layout.delaunay([]) == []


def test_bands(spark):
    r = random.Random(11)
    rows = [(i, *(r.uniform(0, 10) for _ in range(9))) for i in range(80)] + [(90, 0.0, 0.0, 3.0, 4.0, 0.0, 3.0, 0.0, 4.0, 3.0), (91, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 1.0), (92, 0.0, 0.0, None, 1.0, 0.0, 1.0, 0.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "triangle bigint, x0 double, y0 double, v0 double, x1 double, y1 double, v1 double, x2 double, y2 double, v2 double")
    parts = layout.bands(df, [3.0, 6.5]).collect()
    for row in rows[:80]:
        mine = [p for p in parts if p.triangle == row[0]]
        assert sum(p.area for p in mine) == pytest.approx(layout.polygon_area([tuple(row[1:3]), tuple(row[4:6]), tuple(row[7:9])]))
        assert all((-math.inf, 3.0, 6.5)[p.band] - 1e-9 <= v[2] <= (3.0, 6.5, math.inf)[p.band] + 1e-9 for p in mine for v in p.points)
    assert [(p.band, p.area) for p in parts if p.triangle >= 90] == [(1, 8.0)]
    with pytest.raises(ValueError):
        layout.bands(df, [2.0, 2.0])


def test_small_circles_fill_the_gaps_of_the_first():
    radii = [10.0] * 100 + [0.5] * 3
    centres, _ = layout.pack_circles(radii)
    for a in range(len(radii)):
        for b in range(a):
            assert math.dist(centres[a], centres[b]) >= radii[a] + radii[b] - 1e-6
    assert all(abs(math.dist(centres[k], centres[0]) - 10.5) < 1e-6 for k in range(100, 103))


def test_logarithmic_axis_with_a_zero(spark, monkeypatch):
    from treeline.queries import metrics

    for sizes in ((0, 5, 9), (1, 5, 9), ()):
        df = spark.createDataFrame([(i, x, 1, 1) for i, x in enumerate(sizes)], "node_id bigint, x bigint, y bigint, size bigint")
        monkeypatch.setattr(metrics, "_scatter_rows", lambda spark, d, df=df: df)
        if 0 in sizes:
            with pytest.raises(ValueError, match="x"):
                metrics.s03(spark, "")
        else:
            assert metrics.s03(spark, "").count() == len(sizes)


def test_draw_order_has_every_disc(spark, sf_dir):
    from treeline.queries import metrics

    rows = [(-r.radius, r.label, r.node_id) for r in metrics.s06(spark, sf_dir).collect()]
    assert rows == sorted(rows) and len(rows) > 100
    assert sorted(r[2] for r in rows) == sorted(r.node_id for r in metrics.s04(spark, sf_dir).collect())


def test_layout_tables(spark, sf_dir):
    from treeline.queries import metrics

    boxes = {r.node_path: r for r in metrics.l01(spark, sf_dir).collect()}
    for path, b in boxes.items():
        up = boxes.get(path.rpartition("/")[0])
        if up:
            assert b.x >= up.x - 1e-6 and b.y >= up.y - 1e-6 and b.x + b.w <= up.x + up.w + 1e-6 and b.y + b.h <= up.y + up.h + 1e-6
    sectors = metrics.g03(spark, sf_dir).toPandas()
    ring = sectors[sectors["depth"] == 1]
    roots = sectors[sectors["depth"] == 0]
    assert np.isclose(ring["sweep"].sum(), 2 * math.pi * len(roots), atol=1e-3)
    bubbles = {r.node_path: r for r in metrics.l03(spark, sf_dir).collect()}
    for path, b in bubbles.items():
        up = bubbles.get(path.rpartition("/")[0])
        if up:
            assert math.hypot(b.dx, b.dy) + b.radius <= up.radius + 1e-6
    for r in metrics.e01(spark, sf_dir).collect():
        doc = json.loads(r.document)["root"]
        assert doc["path"] == r.root_path
        seen = []

        def walk(n):
            for f in n.get("files", []):
                seen.append(f["path"])
            for x in n.get("directories", []):
                walk(x)

        walk(doc)
        assert len(seen) == len(set(seen)) == metrics.nodes(spark, sf_dir).where(f"node_kind = 'file' AND repo_slug = '{r.root_path}'").count()


def test_save_document(tmp_path):
    doc = json.dumps({"root": {"name": "r", "files": [{"name": "a", "quantities": {"file-size": 3}}, {"name": "b"}], "empty": []}})
    for name in ("x.json", "x.yaml"):
        export.save_document(doc, str(tmp_path / name))
        assert os.stat(tmp_path / name).st_mode & 0o777 == 0o600
    assert json.loads((tmp_path / "x.json").read_text()) == json.loads(doc)
    assert '"file-size": 3' in (tmp_path / "x.yaml").read_text()
    with pytest.raises(ValueError):
        export.export_format("x.png")


def test_scan(spark, tmp_path):
    top = tmp_path / "proj"
    for name, data in (("a.go", b"x\ny"), ("sub/b c+d.md", b"\xff\xfeh\x00i\x00\n\x00"), ("sub/deep/bin.dat", b"\x00\x01"), (".hidden/x.go", b"1\n"), ("sub/LICENSE", b""), ("sub/wide.bin", b"\xff\xfe\x00\x00a")):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(data)
    rows = {r.node_path: r for r in files.scan(spark, str(top), files.Config().rules(), include_binary=True).collect()}
    got = {p: (r.file_size, r.file_lines, r.extension, r.is_binary) for p, r in rows.items() if r.node_kind == "file"}
    assert got == {"proj/a.go": (3, 2, "go", False), "proj/sub/b c+d.md": (8, 1, "md", False), "proj/sub/deep/bin.dat": (2, None, "dat", True), "proj/sub/LICENSE": (0, 0, "no-extension", False), "proj/sub/wide.bin": (5, None, "bin", True)}
    assert {p for p, r in rows.items() if r.node_kind == "dir"} == {"proj", "proj/sub", "proj/sub/deep"}
    assert files.scan(spark, str(top), files.Config().rules()).where("node_kind = 'file'").count() == 3


def test_mailmap_log_and_config(spark, tmp_path):
    lines = ["# note", "", "Proper <p@x> <Old@x>", "<q@x> <r@x>", "Solo <s@x>", "New N <n@x> Old N <o@x> # why", "nothing"]
    mm = {r.old_email: (r.proper_email, r.proper_name) for r in files.read_mailmap(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert mm == {"old@x": ("p@x", "Proper"), "r@x": ("q@x", ""), "s@x": ("s@x", "Solo"), "o@x": ("n@x", "New N")}
    (tmp_path / "log.txt").write_text("\x01h1\tp1 p2\tAnn\ta@x\t1735689600\n\n3\t1\ta b.go\n-\t-\tx.png\n\x01h2\t\tBob\tb@x\t1735689000\n\n1\t0\ta b.go\n")
    rows = sorted((r.commit_hash, r.file_path, r.added, r.n_parents, r.author_email) for r in files.read_log(spark, str(tmp_path)).collect())
    assert rows == [("h1", "a b.go", 3, 2, "a@x"), ("h1", "x.png", None, 2, "a@x"), ("h2", "a b.go", 1, 0, "b@x")]
    config = files.Config(filters=("!.*", "*.go"), top_k=5)
    files.save_config(config, str(tmp_path / "out-config.json"))
    assert files.load_config(output=str(tmp_path / "out.png")) == config
    assert files.load_config() == files.Config() and config.overridden(top_k=0, width=7).width == 7


GO = '''// Package p
package p

import (
	"fmt"
	"example.com/me/x"
	"github.com/o/r"
)

type Shape interface { Area() int }
type box struct { w, h int }
type Kind int

const (
	One = iota
	two
)

var a, B = 1, "func fake() {"

func Run(n int) int {
	if n > 1 && n < 9 {
		for i := 0; i < n; i++ { fmt.Println("if") }
	}
	return n
}

func (b *box) area() int { return b.w * b.h }
'''


def test_go_source(spark):
    found = {n: (k, v, length, c) for n, k, v, length, c in gosource.declarations(GO)}
    assert found == {"Shape": ("interface", "public", None, None), "box": ("struct", "private", None, None), "Kind": ("type", "public", None, None), "One": ("constant", "public", None, None), "two": ("constant", "private", None, None), "a": ("variable", "private", None, None), "B": ("variable", "public", None, None), "Run": ("function", "public", 6, 4), "area": ("method", "private", 1, 1)}
    assert gosource.import_counts(GO, "example.com/me") == (3, 1, 1, 1)
    assert gosource.comment_share("// a\nx\n\n/* b\nc */\n") == pytest.approx(3 / 4) and gosource.comment_share("") == 0
    df = spark.createDataFrame([(1, GO, None), (2, None, None), (3, "", None)], "node_id bigint, content string, module string")
    assert gosource.go_declarations(df).count() == 9 and gosource.go_files(df).count() == 2


def test_streams(spark, tmp_path):
    src = str(tmp_path / "events")
    base = datetime(2025, 1, 1)
    rows = [("a", base + timedelta(minutes=m)) for m in (0, 10, 100, 105)] + [("b", base + timedelta(minutes=3))]
    spark.createDataFrame(rows, "who string, at timestamp").coalesce(1).write.parquet(src)
    spark.createDataFrame([("a", base + timedelta(days=3))], "who string, at timestamp").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("who string, at timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    for name, out in (("w", activity.windowed_counts(stream, "at", "who", "1 hour")), ("s", activity.session_counts(stream, "at", "who"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c{name}")).start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r.who, r.events) for r in spark.table("s").collect()) == [("a", 2), ("a", 2), ("b", 1)]
    assert sorted((r.who, r.events) for r in spark.table("w").collect()) == [("a", 2), ("a", 2), ("b", 1)]


def test_views(spark, sf_dir):
    from treeline import views
    from treeline.plans.expr import ExpressionError
    from treeline.queries import metrics

    assert views.Spec.parse("file-size , terrain") == views.Spec("file-size", "terrain")
    for bad in ("", "file-size,nope"):
        with pytest.raises(ExpressionError):
            views.Spec.parse(bad)
    nodes = metrics._view_nodes(spark, sf_dir.replace("sf0.01", "sf0.001")).cache()
    n_files = nodes.where("node_kind = 'file'").count()
    shapes = views.render("size-map", nodes, width=800.0, height=600.0)
    assert shapes.columns == list(views.SHAPE) and shapes.where("layer = 20").count() <= n_files
    svg = views.to_svg(shapes, 800, 600)
    assert svg.startswith("<svg") and svg.count("<rect") == shapes.count()
    bubbles = views.bubble_tree(nodes, "file-lines").toPandas()
    assert len(bubbles) == n_files + (bubbles["layer"] == views.STRUCTURE).sum()
    assert (bubbles["x"] - bubbles["r"]).min() > -540 and bubbles["r"].gt(0).all()
    points = views.scatter_plot(nodes.where("node_kind = 'file'"), "file-type", "file-size", "file-lines", log=("file-size",)).toPandas()
    assert points["x"].between(96, 1080).all() and points["colour"].str.match("#[0-9a-f]{6}$").all()
    with pytest.raises(ValueError):
        views.spiral(spark.createDataFrame([(BASE,)], "ts timestamp_ntz"), "ts")
    days = spark.createDataFrame([(datetime(2025, 3, 1),), (datetime(2025, 3, 9),)], "t timestamp_ntz")
    assert [r[0] for r in days.select(views.spiral_labels(F.col("t"))).collect()] == ["Mar", "9"]
    assert views.footer("at $date $time", datetime(2025, 3, 9, 7, 5)) == "at 2025-03-09 07:05:00"
    numbers = spark.createDataFrame([(2.0,), (2.25,)], "v double")
    assert [r[0] for r in numbers.select(views.breakpoint_label(F.col("v"))).collect()] == ["2", "2.3"]
    assert views.legend(nodes.where("node_kind = 'file'"), views.Spec.parse("file-type")).count() > 2
