"""The views as tables of shapes: tree map, radial tree, bubble tree, spiral, scatter. And SVG for such a table.

A shape: layer (background 0, structure 10, content 20, overlay 30), shape (rect, disc, line, text), node_path, x, y, w, h, r,
colour, border, label. Layers and, within them, areas give the drawing order.
"""

from __future__ import annotations

from dataclasses import dataclass
from html import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.operators import bucketing, layout, rollup, scatter, timebuckets
from treeline.plans.expr import ExpressionError
from treeline.plans.registry import CLASSIFICATION, Registry, base_registry, kind_of
from treeline.session import materialise

BACKGROUND, STRUCTURE, CONTENT, OVERLAY = 0, 10, 20, 30
SHAPE = ("layer", "shape", "node_path", "x", "y", "w", "h", "r", "colour", "border", "label")
#: ready-made settings by name: view and the metrics of its roles
PRESETS = {
    "size-map": ("tree_map", {"size": "file-lines", "fill": "file-type"}),
    "age-map": ("tree_map", {"size": "file-lines", "fill": "file-freshness"}),
    "owner-bubbles": ("bubble_tree", {"size": "file-lines", "fill": "code-owner"}),
    "churn-scatter": ("scatter_plot", {"x": "file-lines", "y": "commit-count", "size": "total-lines-added"}),
    "type-tree": ("radial_tree", {"fill": "file-type"}),
}


@dataclass(frozen=True)
class Spec:
    """A metric and, if asked for, a palette: metric[,palette]."""

    metric: str
    palette: str | None = None

    @staticmethod
    def parse(text: str) -> "Spec":
        metric, _, palette = (p.strip() for p in text.partition(","))
        if not metric:
            raise ExpressionError("a metric is missing")
        if palette and palette not in bucketing.PALETTES:
            raise ExpressionError(f"no palette {palette}")
        return Spec(metric, palette or None)


def _palette(spec: Spec, registry: Registry) -> str:
    m = registry.get(spec.metric)
    return bucketing.palette_for(m.palette if m else "categorization", spec.palette)


def inked(rows: DataFrame, spec: Spec, registry: Registry | None = None, missing: str = "zero") -> DataFrame:
    """rows with colour by a metric column: buckets of a number, the palette's colours of a category.

    missing: zero lets a row without a number count and be coloured as 0 (files), skip leaves it out of the scale and grey
    (directories, points).
    """
    registry = registry or base_registry()
    palette = _palette(spec, registry)
    c = F.col(f"`{spec.metric}`")
    if kind_of(spec.metric, registry) == CLASSIFICATION:
        table = bucketing.category_colours(rows.select(c.alias("category")), "category", palette)
        known = table.select(F.col("category").alias("_c"), F.col("colour").alias("_k"))
        return rows.join(known, c == F.col("_c"), "left").withColumn("colour", F.coalesce("_k", F.lit(bucketing.GREY))).drop("_c", "_k")
    v = F.coalesce(c.cast("double"), F.lit(0.0)) if missing == "zero" else c.cast("double")
    bounds = bucketing.boundaries(rows.select(v.alias("v")), "v", len(bucketing.colours(palette))).select("boundaries")
    colour = bucketing.colour_of(bucketing.bucket_index(v, F.col("boundaries")), F.col("boundaries"), palette)
    return rows.join(F.broadcast(bounds)).withColumn("colour", F.when(v.isNull(), bucketing.GREY).otherwise(colour)).drop("boundaries")


def breakpoint_label(v: Column) -> Column:
    """A boundary for display: whole numbers without, others with one decimal."""
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(F.format_string("%.1f", v))


def footer(text: str, now) -> str:
    """text with $date and $time of a moment."""
    return text.replace("$date", now.strftime("%Y-%m-%d")).replace("$time", now.strftime("%H:%M:%S"))


def legend(rows: DataFrame, spec: Spec, registry: Registry | None = None) -> DataFrame:
    """(place, colour, label): a swatch per bucket, labelled with its upper boundary (the last has none), or per category."""
    registry = registry or base_registry()
    palette = _palette(spec, registry)
    c = F.col(f"`{spec.metric}`")
    if kind_of(spec.metric, registry) == CLASSIFICATION:
        return bucketing.category_colours(rows.select(c.alias("category")), "category", palette).select("place", "colour", F.col("category").alias("label"))
    bounds = bucketing.boundaries(rows.select(c.cast("double").alias("v")), "v", len(bucketing.colours(palette)))
    places = bounds.select("boundaries", F.explode(F.sequence(F.lit(0), F.size("boundaries"))).alias("place"))
    label = breakpoint_label(F.get("boundaries", F.col("place")))
    return places.select("place", bucketing.colour_of(F.col("place"), F.col("boundaries"), palette).alias("colour"), label.alias("label"))


def _shapes(rows: DataFrame, **columns) -> DataFrame:
    def cell(name: str) -> Column:
        v = columns.get(name)
        kind = {"layer": "int", "x": "double", "y": "double", "w": "double", "h": "double", "r": "double"}.get(name, "string")
        return (v if isinstance(v, Column) else F.lit(v)).cast(kind).alias(name)

    return rows.select(*map(cell, SHAPE))


def _depth(nodes: DataFrame) -> int:
    return nodes.agg(F.max("tree_depth")).first()[0] or 0


def with_totals(nodes: DataFrame, size: str) -> DataFrame:
    """nodes that hold or are files, with size: a file's metric, a directory's total of its files (each at least 1)."""
    files = nodes.where("node_kind = 'file'")
    c = F.col(f"`{size}`").cast("double")
    totals = rollup.size_with_floor(files.select(F.col("parent_path").alias("dir"), c.alias("size")), "size")
    dirs = nodes.where("node_kind = 'dir'").join(totals, "node_path").withColumn("size", F.col("total")).drop("total")
    return files.withColumn("size", c).unionByName(dirs)


def tree_map(nodes: DataFrame, size: str, fill: str | None = None, width: float = 1920.0, height: float = 1080.0, registry: Registry | None = None) -> DataFrame:
    """Nested boxes, files filled by a metric (by default the size). nodes: node columns and a column per metric."""
    sized = materialise(with_totals(nodes, size))
    boxes = materialise(layout.treemap(sized, width, height, _depth(sized)))
    files = inked(sized.where("node_kind = 'file'"), Spec.parse(fill or size), registry)
    at = {n: F.col(n) for n in ("node_path", "x", "y", "w", "h")}
    dirs = _shapes(boxes.join(sized.where("node_kind = 'dir'"), "node_path"), layer=STRUCTURE, shape="rect", colour="#ffffff", border="#000000", label=F.col("node_name"), **at)
    leaves = _shapes(boxes.join(files, "node_path"), layer=CONTENT, shape="rect", colour=F.col("colour"), border=bucketing.darkened(F.col("colour")), label=F.col("node_name"), **at)
    return dirs.unionByName(leaves)


def bubble_tree(nodes: DataFrame, size: str, fill: str | None = None, canvas: float = 1080.0, registry: Registry | None = None) -> DataFrame:
    """Packed circles, placed and scaled to the canvas with a margin of two per cent."""
    sized = materialise(with_totals(nodes, size))
    packed = materialise(layout.bubble_tree(sized, _depth(sized)))
    from treeline.operators.tree import prefixes

    steps = packed.select("node_path", F.explode(prefixes(F.col("node_path"))).alias("up")).join(packed.select(F.col("node_path").alias("up"), "dx", "dy"), "up")
    centres = steps.groupBy("node_path").agg(F.sum("dx").alias("cx"), F.sum("dy").alias("cy")).join(packed.select("node_path", "radius"), "node_path")
    roots = sized.where("parent_path IS NULL").join(packed, "node_path").agg(F.max("radius").alias("most"))
    scale = F.lit(canvas * 0.48) / F.col("most")
    files = inked(sized.where("node_kind = 'file'"), Spec.parse(fill or size), registry).select("node_path", "node_name", "colour", F.lit(CONTENT).alias("layer"))
    dirs = sized.where("node_kind = 'dir'").select("node_path", "node_name", F.lit("#ffffff").alias("colour"), F.lit(STRUCTURE).alias("layer"))
    rows = centres.join(files.unionByName(dirs), "node_path").join(F.broadcast(roots))
    return _shapes(rows, layer=F.col("layer"), shape="disc", node_path=F.col("node_path"), x=F.lit(canvas / 2) + F.col("cx") * scale, y=F.lit(canvas / 2) + F.col("cy") * scale, r=F.col("radius") * scale, colour=F.col("colour"), border=bucketing.darkened(F.col("colour")), label=F.col("node_name"))


def radial_tree(nodes: DataFrame, disc: str | None = None, fill: str | None = None, canvas: float = 1080.0, grain: str = "file", registry: Registry | None = None) -> DataFrame:
    """Rings of discs around the root, with a line from each to its parent."""
    shown = nodes if grain == "file" else nodes.where("node_kind = 'dir'")
    deepest = _depth(shown)
    spacing = canvas / 4 if deepest == 0 else (canvas / 2 - layout.RADIAL_MARGIN) / (deepest + 1)
    placed = materialise(layout.radial_tree(shown, spacing, deepest, grain))
    files = shown.where("node_kind = 'file'")
    coloured = inked(files, Spec.parse(fill), registry) if fill else files.withColumn("colour", F.lit(bucketing.GREY))
    value = F.col(f"`{disc}`").cast("double") if disc else F.lit(None).cast("double")
    ends = files.agg(F.min(F.when(value > 0, value)).alias("lo"), F.max(F.when(value > 0, value)).alias("hi"))
    sized = coloured.join(F.broadcast(ends)).withColumn("r", layout.file_disc(value, F.col("lo"), F.col("hi"), spacing * layout.MAX_DISC_SHARE))
    dirs = shown.where("node_kind = 'dir'").withColumn("r", F.lit(max(spacing * layout.DIR_DISC_SHARE, layout.MIN_DIR_DISC))).withColumn("colour", F.lit("#404040"))
    rows = placed.join(sized.select("node_path", "node_name", "parent_path", "r", "colour").unionByName(dirs.select("node_path", "node_name", "parent_path", "r", "colour")), "node_path")
    x, y = F.col("x") + canvas / 2, F.col("y") + canvas / 2
    discs = _shapes(rows, layer=CONTENT, shape="disc", node_path=F.col("node_path"), x=x, y=y, r=F.col("r"), colour=F.col("colour"), border=bucketing.darkened(F.col("colour")), label=F.col("node_name"))
    ups = placed.select(F.col("node_path").alias("parent_path"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    lines = _shapes(rows.join(ups, "parent_path"), layer=STRUCTURE, shape="line", node_path=F.col("node_path"), x=x, y=y, w=F.col("ux") - F.col("x"), h=F.col("uy") - F.col("y"), border="#a0a0a0")
    return lines.unionByName(discs)


def spiral_labels(started: Column) -> Column:
    """The month on its first day, else the number of the day."""
    return F.when(F.day(started) == 1, F.date_format(started, "MMM")).otherwise(F.day(started).cast("string"))


def spiral(events: DataFrame, at: str, width: float = 1080.0, height: float = 1080.0, resolution: str = "daily", max_disc: float | None = None) -> DataFrame:
    """A disc per bucket along a spiral, sized and coloured by its number of events; empty buckets have no disc."""
    counts = materialise(timebuckets.bucket_counts(events, at, resolution))
    n = counts.count()
    if n == 0:
        raise ValueError("all events are at one moment, or there are none")
    per_lap = layout.daily_cadence(n, width, height) if resolution == "daily" else timebuckets.RESOLUTIONS[resolution][2]
    placed = layout.spiral_positions(counts, n, width, height, per_lap)
    max_disc = layout.largest_disc(n, width, height, per_lap) if max_disc is None else max_disc
    scale = bucketing.boundaries(counts, "events", len(bucketing.colours("temperature"))).select("boundaries")
    rows = placed.join(F.broadcast(counts.agg(F.max("events").alias("most")))).join(F.broadcast(scale))
    colour = bucketing.colour_of(bucketing.bucket_index(F.col("events"), F.col("boundaries")), F.col("boundaries"), "temperature")
    radius = layout.disc_radius(F.col("events"), F.col("most"), max_disc, F.col("events") > 0)
    return _shapes(rows.where("events > 0"), layer=CONTENT, shape="disc", node_path=F.col("started").cast("string"), x=F.col("x"), y=F.col("y"), r=radius, colour=colour, border=bucketing.darkened(colour), label=spiral_labels(F.col("started")))


def scatter_plot(files: DataFrame, x: str, y: str, size: str, fill: str | None = None, width: float = 1080.0, height: float = 1080.0, log: tuple[str, ...] = (), registry: Registry | None = None) -> DataFrame:
    """A disc per file that has all three metrics; a category makes bands, axes named in log are logarithmic."""
    registry = registry or base_registry()
    plot = scatter.plot_area(width, height)
    names = [f"`{c}`" for c in (x, y, size)]
    rows = materialise(files.where(" AND ".join(f"{n} IS NOT NULL" for n in names)))
    for axis in log:
        scatter.require_positive(rows, axis)
    points = rows.agg(F.count("*").alias("points"), F.min(names[2]).alias("lo_s"), F.max(names[2]).alias("hi_s"))
    placed, slots = rows.join(F.broadcast(points)), []
    for c, out, origin, span in ((x, "px", plot.x, plot.w), (y, "py", plot.y, plot.h)):
        if kind_of(c, registry) == CLASSIFICATION:
            bands = scatter.bands(rows.withColumn("_b", F.col(f"`{c}`")), "_b", origin, span)
            placed = placed.join(bands.select(F.col("label").alias(f"_{out}"), F.col("center").alias(out)), F.col(f"`{c}`") == F.col(f"_{out}"), "left").withColumn(out, F.coalesce(out, F.lit(origin + span / 2)))
            slots.append(F.lit(span) / F.greatest(F.lit(bands.count()), F.lit(1)))
        else:
            ends = rows.agg(F.min(f"`{c}`").alias(f"lo_{out}"), F.max(f"`{c}`").alias(f"hi_{out}"))
            norm = (scatter.logarithmic if c in log else scatter.linear)(F.col(f"`{c}`"), F.col(f"lo_{out}"), F.col(f"hi_{out}"))
            placed = placed.join(F.broadcast(ends)).withColumn(out, scatter.across(norm, plot) if out == "px" else scatter.up(norm, plot))
            slots.append(scatter.slot(span, F.col("points")))
    radius = scatter.radius(F.col(names[2]), F.col("lo_s"), F.col("hi_s"), scatter.largest_radius(*slots))
    coloured = inked(placed, Spec.parse(fill or size), registry, missing="skip")
    return _shapes(coloured, layer=CONTENT, shape="disc", node_path=F.col("node_path"), x=F.col("px"), y=F.col("py"), r=radius, colour=F.col("colour"), border=bucketing.darkened(F.col("colour")), label=F.col("node_name"))


def render(name: str, nodes: DataFrame, **settings) -> DataFrame:
    """A view by the name of a preset."""
    view, roles = PRESETS[name]
    rows = nodes.where("node_kind = 'file'") if view == "scatter_plot" else nodes
    return globals()[view](rows, **{**roles, **settings})


def to_svg(shapes: DataFrame, width: float, height: float) -> str:
    """A table of shapes as an SVG text; a picture holds what a driver can hold."""
    order = Window.orderBy("layer", F.desc(F.coalesce(F.col("w") * F.col("h"), F.col("r") * F.col("r"))), "label", "node_path")
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}">']
    for s in shapes.withColumn("_o", F.row_number().over(order)).orderBy("_o").toLocalIterator():
        style = f'fill="{s.colour or "none"}" stroke="{s.border or "none"}"'
        title = f"<title>{escape(s.label or '')}</title>"
        if s.shape == "rect":
            out.append(f'<rect x="{s.x:.2f}" y="{s.y:.2f}" width="{s.w:.2f}" height="{s.h:.2f}" {style}>{title}</rect>')
        elif s.shape == "disc":
            out.append(f'<circle cx="{s.x:.2f}" cy="{s.y:.2f}" r="{s.r:.2f}" {style}>{title}</circle>')
        elif s.shape == "line":
            out.append(f'<line x1="{s.x:.2f}" y1="{s.y:.2f}" x2="{s.x + s.w:.2f}" y2="{s.y + s.h:.2f}" {style}/>')
    return "\n".join([*out, "</svg>", ""])
