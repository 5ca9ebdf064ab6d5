"""Queries of the metric operators over the project's own tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline import views
from treeline.functions import gosource
from treeline.operators import authorship, bucketing, export, globs, history, layout, rollup, scatter, timebuckets, tree
from treeline.plans.expr import Resolved, check, resolve, valid_expressions
from treeline.plans.registry import CLASSIFICATION, DIRECTORY, FILE, MEASURE, QUANTITY, Metric, Registry, base_registry
from treeline.queries import metric_sql
from treeline.session import materialise, table

AS_OF = "2025-10-01 00:00:00"
HEAD = "2025-09-01 00:00:00"
SETTINGS = authorship.Settings(activity_days=45, recent_days=30)
RULES = ("!**/vendor", "!*_test.go", "*.go", "!*.py", "!src/**", "docs", "!docs/**/lib")
CLASSES = (("tests", ("*_test.*", "tests/**")), ("docs", ("docs/**", "*.md")), ("go", ("*.go",)), ("web", ("*.{js,ts,css}",)), ("rest", ("**",)))
WIDTH, HEIGHT = 1200.0, 900.0

REGISTRY = base_registry()
#: declared metrics of lineitems as the declarations of an order, and verbs that the base metrics don't offer
GEO = Registry((
    Metric("price", MEASURE, FILE, ("sum", "min", "max", "mean", "count", "range")),
    Metric("priority", CLASSIFICATION, FILE, ("mode", "distinct")),
    Metric("items", QUANTITY, "declaration", ("count",), ("r", "a")),
    Metric("quantity", QUANTITY, "declaration", ("sum", "min", "max", "mean"), ("r", "a")),
))


# facts


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return tree.latest_nodes(table(spark, d, "nodes"))


def file_facts(spark: SparkSession, d: str) -> DataFrame:
    """A row per file: node columns, dir, file-size (bytes), file-lines, file-type; sizes only where there is a text."""
    files = nodes(spark, d).where("node_kind = 'file'")
    texts = table(spark, d, "file_contents").select("node_id", F.octet_length("content").cast("bigint").alias("file-size"), tree.line_count(F.col("content")).alias("lines"))
    lines = F.when(~F.coalesce("is_binary", F.lit(False)), F.col("lines")).alias("file-lines")
    joined = files.join(texts, "node_id", "left")
    return joined.select("*", lines, F.col("parent_path").alias("dir"), tree.file_extension(F.col("node_name")).alias("file-type")).drop("lines")


def touches(spark: SparkSession, d: str) -> DataFrame:
    return history.touch_facts(table(spark, d, "touches"))


def changes(spark: SparkSession, d: str) -> DataFrame:
    """A row per commit and file that it changed against all its parents."""
    return history.file_changes(table(spark, d, "touches"))


def commit_facts(spark: SparkSession, d: str) -> DataFrame:
    """A row per change: dir, lines-added, lines-removed, lines-changed."""
    path = F.concat_ws("/", "repo_slug", "file_path")
    rows = changes(spark, d)
    return rows.select(tree.parent_of(path).alias("dir"), F.col("added").alias("lines-added"), F.col("removed").alias("lines-removed"), (F.col("added") + F.col("removed")).alias("lines-changed"))


def geo_files(spark: SparkSession, d: str) -> DataFrame:
    """Orders as files of root/region/nation/customer."""
    geo = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat_ws("/", F.lit("root"), "r_name", "n_name", F.col("c_custkey").cast("string"))
    orders = table(spark, d, "orders").join(geo.select("c_custkey", path.alias("dir")), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select("dir", "o_orderkey", F.concat_ws("/", "dir", F.col("o_orderkey").cast("string")).alias("file_path"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))


def geo_declarations(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", F.lit("item").alias("kind"), F.lower("l_returnflag").alias("visibility"), F.col("l_quantity").cast("bigint").alias("quantity"))
    return items.join(geo_files(spark, d).select("o_orderkey", "dir", "file_path"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("items", F.lit(1))


def _directory(names: Sequence[str], registry: Registry = REGISTRY) -> list[Resolved]:
    return [resolve(n, registry, DIRECTORY) for n in names]


def _named(df: DataFrame) -> DataFrame:
    """Columns with plain names."""
    return df.select(*(F.col(f"`{c}`").alias(c.replace(".", "_").replace("-", "_")) for c in df.columns))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def _file_rollup(*names: str) -> Callable:
    return lambda spark, d: _named(rollup.rollup({FILE: file_facts(spark, d)}, _directory(names)))


def _geo_rollup(*names: str) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = _named(rollup.rollup({FILE: geo_files(spark, d), "declaration": geo_declarations(spark, d)}, _directory(names, GEO)))
        doubles = [c for c, t in out.dtypes if t == "double"]
        return out.withColumns({c: F.round(F.col(c), 4) for c in doubles})

    return run


# roll-ups


def r11(spark, d):
    names = ["items.count", "r.items.count", "quantity.sum", "quantity.mean", "a.quantity.max"]
    return _rounded(_named(rollup.rollup({"declaration": geo_declarations(spark, d)}, [resolve(n, GEO, FILE) for n in names], FILE)), "quantity_mean")


def r16(spark, d):
    names = ["lines-added.sum", "lines-added.mean", "lines-removed.max", "lines-changed.min", "lines-changed.sum"]
    return _rounded(_named(rollup.rollup({"commit": commit_facts(spark, d)}, _directory(names))), "lines_added_mean")


def r17(spark, d):
    """Every expression over the facts at hand, fused, in long form."""
    wanted = [r for r in (check(e, REGISTRY) for e in valid_expressions(REGISTRY) if e.aggregation) if r.expression.base in ("file-size", "file-lines", "file-type", "lines-added", "lines-removed", "lines-changed")]
    wide = rollup.rollup({FILE: file_facts(spark, d), "commit": commit_facts(spark, d)}, wanted)
    return rollup.long_form(wide, wanted).select("node_path", "metric", "kind", F.coalesce(F.col("q").cast("string"), F.when(F.col("m").isNotNull(), F.format_string("%.6f", "m")), "c").alias("value"))


def r15(spark, d):
    return rollup.size_with_floor(file_facts(spark, d), "file-size")


def r18(spark, d):
    per = file_facts(spark, d).groupBy(F.col("dir").alias("node_path")).agg(F.sum("file-size").alias("s"), F.count("*").alias("n"))
    return per.select("node_path", F.when(F.coalesce("s", F.lit(0)) > 0, F.col("s")).otherwise(F.col("n")).alias("weight"))


# filters


def _below_root(path: Column) -> Column:
    return F.regexp_replace(path, "^[^/]+/", "")


def f01(spark, d):
    rules = [globs.parse_rule(r) for r in RULES]
    files = nodes(spark, d).where("node_kind = 'file'")
    return files.select("node_path", globs.included(_below_root(F.col("node_path")), rules).alias("included"))


def f02(spark, d):
    rules = [globs.parse_rule(r) for r in RULES]
    return nodes(spark, d).where("node_kind = 'file'").where(globs.kept(_below_root(F.col("node_path")), rules)).select("node_path")


def f03(spark, d):
    return nodes(spark, d).where("node_kind = 'file'").select("node_path", globs.classify(_below_root(F.col("node_path")), CLASSES).alias("class"))


def f04(spark, d):
    return file_facts(spark, d).select("node_id", F.col("file-lines").alias("file_lines"), F.col("file-size").alias("file_size"))


def f05(spark, d):
    return nodes(spark, d).where("node_kind = 'file'").select("node_id", tree.file_extension(F.col("node_name")).alias("extension"))


def f06(spark, d):
    return table(spark, d, "file_contents").select("node_id", F.round(tree.comment_ratio(F.col("content")), 6).alias("comment_ratio"))


def f07(spark, d):
    return tree.tree_counts(tree.without_binaries(nodes(spark, d)))


def f09(spark, d):
    return nodes(spark, d).where("node_kind = 'dir'").groupBy("repo_slug", "tree_depth").agg(F.count("*").alias("dirs"))


# history


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def h01(spark, d):
    return _rounded(history.file_history(changes(spark, d), _as_of()), "commit_density")


def h02(spark, d):
    return touches(spark, d).groupBy("repo_slug").agg(F.count_distinct("commit_hash").alias("commits"))


def h03(spark, d):
    """Age and freshness in days."""
    return h01(spark, d).select("repo_slug", "file_path", "file_age", "file_freshness")


def h04(spark, d):
    return h01(spark, d).select("repo_slug", "file_path", "author_count")


def h05(spark, d):
    return h01(spark, d).select("repo_slug", "file_path", "commit_count")


def h06(spark, d):
    return h01(spark, d).select("repo_slug", "file_path", "total_lines_added", "total_lines_removed")


def h07(spark, d):
    return h01(spark, d).select("repo_slug", "file_path", "commit_density")


def _files(spark, d):
    files = nodes(spark, d).where("node_kind = 'file'")
    return files.select("repo_slug", _below_root(F.col("node_path")).alias("file_path"))


def h08(spark, d):
    commits = table(spark, d, "commits").select("repo_slug", "commit_hash", "changed_paths")
    changed = history.touches_of(commits).select("repo_slug", "commit_hash", F.regexp_replace(F.translate("file_path", "\\", "/"), r"^(\./+)+", "").alias("file_path")).distinct()
    return history.tracked(changed, _files(spark, d)).groupBy("repo_slug", "file_path").agg(F.count("*").alias("commits"))


def h09(spark, d):
    return history.tracked(touches(spark, d), _files(spark, d)).groupBy("repo_slug").agg(F.count("*").alias("touches"), F.count_distinct("file_path").alias("files"))


def h10(spark, d):
    return history.changed_against_all_parents(touches(spark, d))


def h11(spark, d):
    ranges = history.time_ranges(touches(spark, d))
    return ranges.select("repo_slug", "file_path", *(F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("earliest", "latest")))


def h12(spark, d):
    return history.overall_range(h11(spark, d))


def h13(spark, d):
    return history.last_active(touches(spark, d)).select("author_email", F.unix_micros(F.col("last_active").cast("timestamp")).alias("last_us"))


def h14(spark, d):
    return history.first_parent_lines(touches(spark, d))


def h15(spark, d):
    rows = history.tracked(touches(spark, d), _files(spark, d))
    return rows.groupBy("repo_slug", "commit_hash").agg(F.array_join(F.array_sort(F.collect_set("file_path")), "|").alias("paths"))


# authorship


def _head_us() -> int:
    from datetime import datetime, timezone

    return int(datetime.fromisoformat(HEAD).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000


def _contributions(spark, d) -> DataFrame:
    return authorship.contributions(changes(spark, d), F.concat_ws("/", "repo_slug", "file_path"))


def _active(spark, d) -> DataFrame:
    return h13(spark, d).select(F.col("author_email").alias("email"), "last_us")


def _authorship(spark, d, directories: bool = False) -> DataFrame:
    records = authorship.directory_records if directories else authorship.author_records
    found = authorship.metrics(records(_contributions(spark, d), _head_us(), SETTINGS), _active(spark, d), _head_us(), SETTINGS)
    return _rounded(found, "ownership_dominance", "contributor_entropy", "orphan_risk", "knowledge_handoff")


METRICS = ("code_owner", "initial_developer", "current_maintainer", "significant_contributor_count", "bus_factor", "ownership_dominance", "contributor_entropy", "orphan_risk", "knowledge_handoff")


def _one_metric(name: str) -> Callable:
    return lambda spark, d: _authorship(spark, d).select("node", name)


def a10(spark, d):
    return _authorship(spark, d, directories=True)


def a11(spark, d):
    return authorship.top_authors(_contributions(spark, d), SETTINGS.top_k)


def a12(spark, d):
    rows = _authorship(spark, d).select("node", "code_owner", "initial_developer", "current_maintainer")
    return authorship.bucket_identities(rows, a11(spark, d), ("code_owner", "initial_developer", "current_maintainer"))


MAILMAP = ("# canonical people", "Build Team <builds@foundry.example> <conveyor@ci.foundry.example>", "<janitor@foundry.example> Janitor <JANITOR@bots.foundry.example> # bot", "Train <train@release.foundry.example>")


def a13(spark, d):
    from treeline.sources.files import read_mailmap

    mm = read_mailmap(spark.createDataFrame([(x,) for x in MAILMAP], "value string"))
    rows = table(spark, d, "commits").select("commit_hash", "author_email", "author_name").distinct()
    out = authorship.apply_mailmap(rows, mm)
    return out.groupBy("author_email", "author_name").agg(F.count_distinct("commit_hash").alias("commits"))


def a14(spark, d):
    ranked = authorship.ranked(authorship.author_records(_contributions(spark, d), _head_us(), SETTINGS))
    return _rounded(ranked.select("node", "email", "weight", "share", F.col("rank").cast("bigint").alias("rank")), "share")


def j01(spark, d):
    return authorship.new_recent_authors(authorship.author_records(_contributions(spark, d), _head_us(), SETTINGS))


def j02(spark, d):
    """The nearest directory at or above each file that holds a Go file, as a module would be found."""
    files = nodes(spark, d)
    marks = files.where("node_kind = 'file'").where(F.lower("node_name").endswith(".go")).groupBy(F.col("parent_path").alias("node_path")).agg(F.min("node_name").alias("module"))
    return tree.nearest_ancestor(files, marks, "module")


# time buckets


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events")


def t01(spark, d):
    return timebuckets.bucket_counts(_events(spark, d), "ts", "daily")


def t02(spark, d):
    return timebuckets.bucket_counts(_events(spark, d), "ts", "hourly")


def t03(spark, d):
    return _rounded(timebuckets.bucket_sums(_events(spark, d), "ts", "user_id", "value", "daily"), "value")


def t04(spark, d):
    return timebuckets.bucket_modes(_events(spark, d), "ts", "event_type", "hourly")


def t05(spark, d):
    """Events cut to whole days, so the last one lies on the upper edge and falls in no bucket."""
    cut = _events(spark, d).select(F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("ts"), "event_id")
    return timebuckets.assigned(cut, "ts", "daily").groupBy("bucket").agg(F.count("*").alias("events"))


def t06(spark, d):
    """Weekly rhythm of the tracked files: the touches of each day, empty days kept."""
    rows = touches(spark, d).where("touched_at IS NOT NULL").select(F.col("touched_at").cast("timestamp_ntz").alias("at"))
    return timebuckets.bucket_counts(rows, "at", "daily")


# buckets and colours


def _sizes(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("category"))


def b01(spark, d):
    return bucketing.boundaries(_sizes(spark, d), "v", 9).select(F.posexplode("boundaries").alias("place", "boundary"), "min", "max", "n")


def _bucketed(spark, d) -> DataFrame:
    rows = _sizes(spark, d)
    bounds = F.broadcast(bucketing.boundaries(rows, "v", 11).select("boundaries"))
    return rows.crossJoin(bounds).withColumn("bucket", bucketing.bucket_index(F.col("v"), F.col("boundaries")))


def b02(spark, d):
    return _bucketed(spark, d).groupBy("bucket").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def b03(spark, d):
    rows = _bucketed(spark, d).withColumn("colour", bucketing.colour_of(F.col("bucket"), F.col("boundaries"), "temperature"))
    return rows.groupBy("bucket", "colour").agg(F.count("*").alias("n"))


def b04(spark, d):
    files = nodes(spark, d).where("node_kind = 'file'").select(tree.file_extension(F.col("node_name")).alias("category"))
    return bucketing.category_colours(files, "category").select("category", F.col("place").cast("bigint").alias("place"), "colour")


def b05(spark, d):
    """File ink: a file without a size counts as 0 in the scale and is coloured as one."""
    rows = file_facts(spark, d).select("node_id", F.coalesce(F.col("file-size").cast("double"), F.lit(0.0)).alias("v"))
    bounds = F.broadcast(bucketing.boundaries(rows, "v", 9).select("boundaries"))
    return rows.crossJoin(bounds).select("node_id", bucketing.colour_of(bucketing.bucket_index(F.col("v"), F.col("boundaries")), F.col("boundaries"), "neutral").alias("colour"))


def b06(spark, d):
    rows = [(p, i, c) for p in sorted(bucketing.PALETTES) for i, c in enumerate(bucketing.colours(p))]
    df = spark.createDataFrame(rows, "palette string, place int, colour string")
    c = F.col("colour")
    return df.select("palette", "place", "colour", F.round(bucketing.luminance(c), 6).alias("luminance"), F.round(bucketing.contrast(c, F.lit("#ffffff")), 6).alias("contrast"), bucketing.text_colour(c).alias("text"), bucketing.darkened(c).alias("border"))


# scatter


def _scatter_rows(spark, d) -> DataFrame:
    facts = file_facts(spark, d).select("node_id", "node_name", "repo_slug", "node_path", F.col("file-size").alias("x"), F.col("file-lines").alias("y"), F.col("file-type").alias("category"))
    seen = history.file_history(changes(spark, d), _as_of()).select(F.concat_ws("/", "repo_slug", "file_path").alias("node_path"), F.col("commit_count").alias("size"))
    return facts.join(seen, "node_path", "left")


def s01(spark, d):
    return scatter.skipped(_scatter_rows(spark, d), "x", "y", "size")


def _with_extent(spark, d) -> DataFrame:
    rows = materialise(scatter.dataset(_scatter_rows(spark, d), "x", "y", "size"))
    ends = scatter.extent(rows, x="x", y="y", size="size").crossJoin(rows.agg(F.count("*").alias("points")))
    return rows.crossJoin(F.broadcast(ends))


def s02(spark, d):
    plot = scatter.plot_area(WIDTH, HEIGHT)
    rows = _with_extent(spark, d)
    x = scatter.across(scatter.linear(F.col("x"), F.col("lo_x"), F.col("hi_x")), plot)
    y = scatter.up(scatter.linear(F.col("y"), F.col("lo_y"), F.col("hi_y")), plot)
    return rows.select("node_id", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


def s03(spark, d):
    plot = scatter.plot_area(WIDTH, HEIGHT)
    rows = scatter.require_positive(_with_extent(spark, d), "x")
    return rows.select("node_id", F.round(scatter.across(scatter.logarithmic(F.col("x"), F.col("lo_x"), F.col("hi_x")), plot), 6).alias("px"))


def s04(spark, d):
    plot = scatter.plot_area(WIDTH, HEIGHT)
    largest = scatter.largest_radius(scatter.slot(plot.w, F.col("points")), scatter.slot(plot.h, F.col("points")))
    return _with_extent(spark, d).select("node_id", F.round(scatter.radius(F.col("size"), F.col("lo_size"), F.col("hi_size"), largest), 6).alias("radius"))


def s05(spark, d):
    plot = scatter.plot_area(WIDTH, HEIGHT)
    return _rounded(scatter.bands(_scatter_rows(spark, d), "category", plot.x, plot.w), "started", "ended", "center")


def s06(spark, d):
    """All discs in drawing order: large ones first, then by label."""
    rows = s04(spark, d).join(_scatter_rows(spark, d).select("node_id", F.col("node_name").alias("label")), "node_id")
    return rows.orderBy(F.desc("radius"), "label", "node_id")


def s07(spark, d):
    ends = _with_extent(spark, d).select("lo_x", "hi_x", "lo_y", "hi_y").first()
    if ends is None:
        return spark.createDataFrame([], "axis string, place int, value double, label string")
    x, y = scatter.ticks(float(ends.lo_x), float(ends.hi_x)), scatter.log_ticks(max(1.0, float(ends.lo_y)), float(ends.hi_y))
    rows = [("x", i, v, scatter.tick_label(v, x[1] - x[0] if len(x) > 1 else 0)) for i, v in enumerate(x)] + [("y", i, v, scatter.tick_label(v, 0)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "axis string, place int, value double, label string")


# geometry


def _grid(spark, d) -> tuple[DataFrame, int]:
    counts = materialise(t01(spark, d))
    return counts, counts.count()


def g01(spark, d):
    counts, n = _grid(spark, d)
    placed = layout.spiral_positions(counts, n, WIDTH, HEIGHT, layout.daily_cadence(n, WIDTH, HEIGHT))
    return _rounded(placed.select("bucket", "theta", "r", "x", "y"), "theta", "r", "x", "y")


def g02(spark, d):
    counts, _ = _grid(spark, d)
    largest = counts.agg(F.max("events").alias("largest"))
    rows = counts.crossJoin(F.broadcast(largest))
    return rows.select("bucket", F.round(layout.disc_radius(F.col("events"), F.col("largest"), 40.0, F.col("events") > 0), 6).alias("radius"))


def g03(spark, d):
    found = nodes(spark, d)
    deepest = found.agg(F.max("tree_depth")).first()[0] or 0
    return _rounded(layout.radial_tree(found, 40.0, deepest), "sweep", "angle", "x", "y")


def _sized_nodes(spark, d) -> DataFrame:
    totals = rollup.size_with_floor(file_facts(spark, d), "file-size")
    files = file_facts(spark, d).select("node_path", "parent_path", "node_kind", "node_name", "tree_depth", F.col("file-size").cast("double").alias("size"))
    dirs = nodes(spark, d).where("node_kind = 'dir'").join(totals, "node_path").select("node_path", "parent_path", "node_kind", "node_name", "tree_depth", F.col("total").alias("size"))
    return materialise(files.unionByName(dirs))


def _deepest(df: DataFrame) -> int:
    return df.agg(F.max("tree_depth")).first()[0] or 0


def l01(spark, d):
    sized = _sized_nodes(spark, d)
    return layout.treemap(sized, WIDTH, HEIGHT, _deepest(sized))


def l02(spark, d):
    """Prices of all orders over a plane of day and customer group, interpolated half a day after each of their places."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    seen = table(spark, d, "orders").groupBy(day.alias("ox"), (F.col("o_custkey") % 97).cast("double").alias("oy")).agg(F.sum("o_totalprice").alias("value"))
    points = seen.select((F.col("ox") + 0.5).alias("px"), F.col("oy").alias("py"))
    return _rounded(layout.interpolate(points, seen, 3.0), "value")


def l03(spark, d):
    sized = _sized_nodes(spark, d)
    return layout.bubble_tree(sized, _deepest(sized))


def l04(spark, d):
    points = layout.poisson_points(200.0, 150.0, 4.0)
    return spark.createDataFrame(points, "x double, y double")


def _order_places(spark, d) -> DataFrame:
    """Orders as places of day and price."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    return table(spark, d, "orders").select(day.alias("ox"), F.round(F.col("o_totalprice") / 1000, 0).alias("oy"))


def l05(spark, d):
    """The mesh over the points that fill a picture."""
    points = layout.poisson_points(60.0, 45.0, 4.0)
    rows = [(i, *(float(c) for k in t for c in points[k])) for i, t in enumerate(layout.delaunay(points))]
    return spark.createDataFrame(rows, "triangle bigint, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double")


BREAKS = [50_000.0, 120_000.0, 200_000.0, 300_000.0]


def l06(spark, d):
    """Each order and the two next ones of its customer as a triangle over day and number, cut into bands of price: areas, summed."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    orders = table(spark, d, "orders").select("o_custkey", F.struct(day.alias("x"), (F.col("o_orderkey") % 1000).cast("double").alias("y"), F.col("o_totalprice").alias("v"), "o_orderkey").alias("p"))
    next_ones = Window.partitionBy("o_custkey").orderBy("p")
    rows = orders.select(F.col("p").alias("p0"), F.lead("p", 1).over(next_ones).alias("p1"), F.lead("p", 2).over(next_ones).alias("p2")).where("p2 IS NOT NULL")
    triangles = rows.select(F.col("p0.o_orderkey").alias("triangle"), *(F.col(f"p{i}.{c}").alias(f"{c}{i}") for i in range(3) for c in "xyv"))
    cut = layout.bands(triangles, BREAKS).groupBy("triangle").agg(F.round(F.sum("area"), 4).alias("area"), F.min("band").alias("lowest"), F.max("band").alias("highest"))
    return cut.select("triangle", "area", F.col("lowest").cast("bigint").alias("lowest"), F.col("highest").cast("bigint").alias("highest"))


def l07(spark, d):
    return _rounded(layout.support_radius(_order_places(spark, d)), "radius")


# documents and catalogues


def e01(spark, d):
    facts = file_facts(spark, d)
    found = nodes(spark, d).join(facts.select("node_id", F.col("file-size").alias("file-size"), "file-lines", "file-type"), "node_id", "left")
    kinds = {"file-size": QUANTITY, "file-lines": QUANTITY, "file-type": CLASSIFICATION}
    return export.tree_documents(found, kinds, _deepest(found)).select("root_path", "document")


def e02(spark, d):
    return export.metric_catalogue(spark, REGISTRY)


def e03(spark, d):
    return export.expression_catalogue(spark, REGISTRY)


def e04(spark, d):
    return export.summary(nodes(spark, d), ("extension", "is_binary"))


def _go_sources(spark, d) -> DataFrame:
    files = nodes(spark, d).where(F.lower("node_name").endswith(".go")).select("node_id", "node_path", "parent_path", "repo_slug")
    return files.join(table(spark, d, "file_contents"), "node_id").withColumn("module", F.concat_ws("/", F.lit("code.example"), "repo_slug"))


def c01(spark, d):
    return gosource.go_declarations(_go_sources(spark, d))


def c02(spark, d):
    return gosource.go_files(_go_sources(spark, d))


def c03(spark, d):
    """All declaration expressions over the parsed Go files, rolled up, in long form."""
    sources = _go_sources(spark, d)
    facts = gosource.go_declarations(sources).withColumnsRenamed({"function_length": "function-length", "cyclomatic_complexity": "cyclomatic-complexity"})
    placed = facts.join(sources.select("node_id", F.col("parent_path").alias("dir"), F.col("node_path").alias("file_path")), "node_id")
    wanted = [r for r in (check(e, REGISTRY) for e in valid_expressions(REGISTRY) if e.aggregation) if r.metric.level == "declaration"]
    return rollup.long_form(rollup.rollup({"declaration": placed}, wanted), wanted)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "r01_rollup_sum": _file_rollup("file-size.sum", "file-lines.sum"),
    "r02_rollup_min": _file_rollup("file-size.min"),
    "r03_rollup_max": _file_rollup("file-size.max"),
    "r04_rollup_mean": lambda spark, d: _rounded(_file_rollup("file-size.mean", "file-lines.mean")(spark, d), "file_size_mean", "file_lines_mean"),
    "r05_rollup_count": _geo_rollup("price.count"),
    "r06_rollup_range": _geo_rollup("price.range", "price.min", "price.max"),
    "r07_rollup_mode": _file_rollup("file-type.mode"),
    "r08_rollup_distinct": _file_rollup("file-type.distinct"),
    "r09_filtered_count": _geo_rollup("items.count", "r.items.count", "a.items.count"),
    "r10_filtered_sum": _geo_rollup("quantity.sum", "r.quantity.sum", "a.quantity.mean"),
    "r11_declarations_of_files": r11,
    "r12_tree_counts": lambda spark, d: tree.tree_counts(nodes(spark, d)),
    "r13_leaf_count_and_depth": lambda spark, d: tree.leaf_counts(nodes(spark, d)),
    "r14_closure": lambda spark, d: tree.closure(nodes(spark, d)),
    "r15_size_with_floor": r15,
    "r16_commit_rollup": r16,
    "r17_fused_expressions": r17,
    "r18_direct_weight": r18,
    "f01_ordered_globs": f01,
    "f02_subtree_prune": f02,
    "f03_classification": f03,
    "f04_file_lines": f04,
    "f05_extension": f05,
    "f06_comment_ratio": f06,
    "f07_without_binaries": f07,
    "f09_directory_grain": f09,
    "h01_history_metrics": h01,
    "h02_commit_total": h02,
    "h03_age_and_freshness": h03,
    "h04_author_count": h04,
    "h05_commit_count": h05,
    "h06_lines": h06,
    "h07_commit_density": h07,
    "h08_history_of_files": h08,
    "h09_tracked_only": h09,
    "h10_against_all_parents": h10,
    "h11_file_range": h11,
    "h12_overall_range": h12,
    "h13_last_active": h13,
    "h14_first_parent": h14,
    "h15_commit_paths": h15,
    **{f"a{i:02d}_{name}": _one_metric(name) for i, name in enumerate(METRICS, 1)},
    "a10_directory_authorship": a10,
    "a11_top_authors": a11,
    "a12_other_authors": a12,
    "a13_mailmap": a13,
    "a14_author_ranking": a14,
    "j01_new_recent_authors": j01,
    "j02_nearest_ancestor": j02,
    "t01_daily_grid": t01,
    "t02_hourly_grid": t02,
    "t03_unique_sum": t03,
    "t04_bucket_mode": t04,
    "t05_upper_edge": t05,
    "t06_touch_days": t06,
    "b01_boundaries": b01,
    "b02_bucket_index": b02,
    "b03_bucket_colour": b03,
    "b04_category_colour": b04,
    "b05_file_ink": b05,
    "b06_palettes": b06,
    "s01_skip_counts": s01,
    "s02_linear": s02,
    "s03_log": s03,
    "s04_radius": s04,
    "s05_bands": s05,
    "s06_draw_order": s06,
    "s07_ticks": s07,
    "g01_spiral": g01,
    "g02_discs": g02,
    "g03_radial": g03,
    "l01_treemap": l01,
    "l02_surface": l02,
    "l03_bubbles": l03,
    "l04_poisson": l04,
    "l05_mesh": l05,
    "l06_bands": l06,
    "l07_support_radius": l07,
    "e01_documents": e01,
    "e02_metrics": e02,
    "e03_expressions": e03,
    "e04_summary": e04,
    "c01_go_declarations": c01,
    "c02_go_files": c02,
    "c03_go_rollup": c03,
}
ORACLES = metric_sql.ORACLES


# views


def _view_nodes(spark, d) -> DataFrame:
    found = nodes(spark, d)
    facts = file_facts(spark, d).select("node_path", "file-size", "file-lines", "file-type")
    seen = history.file_history(changes(spark, d), _as_of()).select(F.concat_ws("/", "repo_slug", "file_path").alias("node_path"), F.col("commit_count").alias("commit-count"), F.col("file_freshness").alias("file-freshness"), F.col("total_lines_added").alias("total-lines-added"))
    return found.join(facts, "node_path", "left").join(seen, "node_path", "left")


QUERIES |= {
    "v01_tree_map": lambda spark, d: views.tree_map(_view_nodes(spark, d), "file-lines", "file-type"),
    "v02_bubble_tree": lambda spark, d: views.bubble_tree(_view_nodes(spark, d), "file-lines", "file-freshness"),
    "v03_radial_tree": lambda spark, d: views.radial_tree(_view_nodes(spark, d), "file-size", "file-type"),
    "v04_spiral": lambda spark, d: views.spiral(_events(spark, d), "ts", resolution="hourly"),
    "v05_scatter": lambda spark, d: views.scatter_plot(_view_nodes(spark, d).where("node_kind = 'file'"), "file-size", "file-type", "commit-count", log=("file-size",)),
    "v06_legend": lambda spark, d: views.legend(_view_nodes(spark, d).where("node_kind = 'file'"), views.Spec.parse("file-size,terrain")),
}
