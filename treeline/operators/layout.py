"""Geometry of the views as tables: spiral, radial tree, tree map, packed circles, interpolated surface."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.session import materialise

# Sizes in pixels and shares of the views.
SPIRAL_MARGIN, INNER_SHARE, DISC_FLOOR = 40.0, 1.0 / 3.0, 12.0
DAILY_CADENCES, DEFAULT_CADENCE = (14, 28, 42, 56, 84, 112, 168), 28
RADIAL_MARGIN, DIR_DISC_SHARE, MIN_DIR_DISC, DIR_DISC_GROWTH, MIN_FILE_DISC, MAX_DISC_SHARE = 40.0, 0.06, 4.0, 2.0, 3.0, 0.40
HEADER, PADDING, GAP, MIN_AREA = 20.0, 4.0, 2.0, 1.0


# spiral


def spiral_size(buckets: int, width: float, height: float, per_lap: int) -> tuple[float, float, float]:
    """(inner radius, growth per radian, whole angle) of the spiral that fits a canvas."""
    outer = min(width, height) / 2 - SPIRAL_MARGIN
    inner = outer * INNER_SHARE
    angle = max(buckets - 1, 0) * 2 * math.pi / per_lap
    return inner, (outer - inner) / angle if angle else 0.0, angle


def spiral_positions(buckets: DataFrame, n: int, width: float, height: float, per_lap: int) -> DataFrame:
    """buckets (with bucket 0..n-1) with theta, r, x, y: clockwise from the top, outwards."""
    inner, growth, _ = spiral_size(n, width, height, per_lap)
    theta = F.col("bucket") * F.lit(2 * math.pi / per_lap)
    placed = buckets.withColumn("theta", theta).withColumn("r", F.lit(inner) + F.lit(growth) * F.col("theta"))
    return placed.withColumn("x", F.lit(width / 2) + F.col("r") * F.sin("theta")).withColumn("y", F.lit(height / 2) - F.col("r") * F.cos("theta"))


def daily_cadence(buckets: int, width: float, height: float) -> int:
    """The spots per lap for which the gaps along and across the laps differ least at the middle; 28 wins ties."""

    def unevenness(per_lap: int) -> float:
        inner, growth, angle = spiral_size(buckets, width, height, per_lap)
        return math.inf if growth <= 0 else abs(2 * math.pi * growth - (inner + growth * angle / 2) * 2 * math.pi / per_lap)

    return min(DAILY_CADENCES, key=lambda c: (unevenness(c), c != DEFAULT_CADENCE))


def disc_border(radius: float) -> float:
    """The stroke of a disc."""
    return 2.0 if radius < 8 else 3.0


def largest_disc(buckets: int, width: float, height: float, per_lap: int) -> float:
    """The largest radius with which no two discs of a spiral touch, strokes included: along the innermost lap or across laps."""
    if buckets == 0:
        return 4.0
    inner, growth, angle = spiral_size(buckets, width, height, per_lap)
    room = min(inner / per_lap, growth) * math.pi if angle else inner
    return max(0.0, room - disc_border(room) / 2) * (1 - 1e-12)


def disc_radius(value: Column, largest: Column, max_disc: float, active: Column) -> Column:
    """The radius of a bucket's disc: by the root of its share, floored; 0 for a bucket without events."""
    floor = min(DISC_FLOOR, max_disc)
    scaled = F.lit(floor) + F.lit(max_disc - floor) * F.sqrt(value / largest)
    return F.when(~active, 0.0).when(largest == 0, F.lit(floor)).otherwise(F.least(F.lit(max_disc), F.greatest(F.lit(floor), scaled)))


# radial tree


def radial_tree(nodes: DataFrame, spacing: float, max_depth: int, grain: str = "file") -> DataFrame:
    """(node_path, depth, sweep, angle, x, y): every node on the ring of its depth, its sector by its share of the leaves.

    nodes: node_path, parent_path, node_kind, node_name of one tree or several. Below the root each directory keeps a blank
    slot of one child on both sides. Files come before directories, by name. One join and one window a ring; grain
    'directory' leaves the files out.
    """
    from treeline.operators import tree

    shown = nodes if grain == "file" else nodes.where("node_kind = 'dir'")
    files = shown.where("node_kind = 'file'").groupBy(F.col("parent_path").alias("dir")).agg(F.count("*").alias("n"))
    if grain != "file":
        holds = shown.where("parent_path IS NOT NULL").select(F.col("parent_path").alias("node_path")).distinct()
        leaves = shown.join(holds, "node_path", "left_anti").select(F.col("node_path").alias("dir"), F.lit(1).alias("n"))
        files = leaves
    below = tree.to_ancestors(files).groupBy("node_path").agg(F.sum("n").alias("leaves"))
    weighed = materialise(shown.join(below, "node_path", "left").select("node_path", "parent_path", "node_kind", "node_name", F.when(F.col("node_kind") == "file", 1).otherwise(F.greatest(F.coalesce("leaves", F.lit(1)), F.lit(1))).alias("weight")))
    ring = weighed.where("parent_path IS NULL").select("node_path", F.lit(0).alias("depth"), F.lit(-math.pi / 2).alias("started"), F.lit(2 * math.pi).alias("sweep"))
    rings = [ring]
    for depth in range(1, max_depth + 1):
        inside = rings[-1].select(F.col("node_path").alias("parent_path"), F.col("started").alias("p_start"), F.col("sweep").alias("p_sweep"))
        children = weighed.join(inside, "parent_path")
        siblings = Window.partitionBy("parent_path")
        order = siblings.orderBy(F.when(F.col("node_kind") == "file", 0).otherwise(1), "node_name", "node_path")
        units = F.sum("weight").over(siblings)
        pad = F.when(F.lit(depth > 1), F.col("p_sweep") / (units + 2)).otherwise(0.0)
        before = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sized = children.withColumn("units", units).withColumn("pad", pad).withColumn("before", before)
        unit = (F.col("p_sweep") - 2 * F.col("pad")) / F.col("units")
        rings.append(sized.select("node_path", F.lit(depth).alias("depth"), (F.col("p_start") + F.col("pad") + unit * F.col("before")).alias("started"), (unit * F.col("weight")).alias("sweep")))
        if depth % 4 == 0:
            rings[-1] = materialise(rings[-1])
    out = reduce(DataFrame.unionByName, rings).withColumn("angle", F.col("started") + F.col("sweep") / 2)
    radius = F.col("depth") * F.lit(spacing)
    return out.select("node_path", "depth", "sweep", "angle", (radius * F.cos("angle")).alias("x"), (radius * F.sin("angle")).alias("y"))


def directory_disc(value: Column, lo: Column, hi: Column, spacing: float) -> Column:
    """A directory's radius: its area grows with the value; the base size if the values don't vary."""
    base = max(spacing * DIR_DISC_SHARE, MIN_DIR_DISC)
    least, most = MIN_DIR_DISC, base * DIR_DISC_GROWTH
    area = F.lit(least**2) + (value - lo) / (hi - lo) * (most**2 - least**2)
    return F.when(lo.isNull() | (lo == hi), F.lit(base)).when(value.isNull() | (value <= 0), F.lit(least)).otherwise(F.least(F.lit(most), F.greatest(F.lit(least), F.sqrt(area))))


def file_disc(value: Column, lo: Column, hi: Column, largest: float) -> Column:
    scaled = F.lit(MIN_FILE_DISC) + (value - lo) / (hi - lo) * (largest - MIN_FILE_DISC)
    return F.when(value.isNull() | (value <= 0), F.lit(MIN_FILE_DISC)).when(lo == hi, F.lit((MIN_FILE_DISC + largest) / 2)).otherwise(F.least(F.lit(largest), F.greatest(F.lit(MIN_FILE_DISC), scaled)))


# tree map


def squarify(x: float, y: float, w: float, h: float, sizes: list[float]) -> list[tuple[float, float, float, float]]:
    """Boxes with areas in proportion to sizes that fill a box, in rows along its shorter side, as square as can be."""
    scale = w * h / sum(sizes)
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    areas = [sizes[k] * scale for k in order]
    boxes: list[tuple[float, float, float, float]] = [(0.0, 0.0, 0.0, 0.0)] * len(sizes)
    at = 0
    while at < len(areas):
        side = min(w, h)
        end, total, best = at, 0.0, math.inf
        while end < len(areas):
            grown = total + areas[end]
            worst = max(side * side * areas[at] / grown**2, grown**2 / (side * side * areas[end]))
            if worst > best:
                break
            end, total, best = end + 1, grown, worst
        if end == at:
            end, total = at + 1, areas[at]
        thick, offset = total / side, 0.0
        for k in range(at, end):
            long = areas[k] / thick
            boxes[order[k]] = (x, y + offset, thick, long) if w >= h else (x + offset, y, long, thick)
            offset += long
        if w >= h:
            x, w = x + thick, max(w - thick, 1e-12)
        else:
            y, h = y + thick, max(h - thick, 1e-12)
        at = end
    return boxes


BOX = "node_path string, x double, y double, w double, h double"


def _place_children(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    g = group.sort_values(["is_dir", "node_name", "node_path"])
    px, py, pw, ph = (float(g[c].iloc[0]) for c in ("px", "py", "pw", "ph"))
    x, y, w, h = px + PADDING, py + HEADER, pw - 2 * PADDING, ph - HEADER - PADDING
    if w <= 0 or h <= 0:
        return pd.DataFrame(columns=["node_path", "x", "y", "w", "h"])
    rows = []
    for path, (bx, by, bw, bh) in zip(g["node_path"], squarify(x, y, w, h, np.maximum(g["size"], MIN_AREA).tolist())):
        if bw > GAP and bh > GAP:
            bx, by, bw, bh = bx + GAP / 2, by + GAP / 2, bw - GAP, bh - GAP
        rows.append((path, bx, by, bw, bh))
    return pd.DataFrame(rows, columns=["node_path", "x", "y", "w", "h"])


def treemap(nodes: DataFrame, width: float, height: float, max_depth: int) -> DataFrame:
    """(node_path, x, y, w, h): nested boxes; nodes: node_path, parent_path, node_kind, node_name, size (of a directory its total).

    One grouped step a level; a directory's children are one group, since their boxes depend on each other. Directories
    whose box has no room leave their children out.
    """
    base = materialise(nodes.select("node_path", "parent_path", "node_name", (F.col("node_kind") == "dir").alias("is_dir"), F.coalesce(F.col("size").cast("double"), F.lit(0.0)).alias("size")))
    level = base.where("parent_path IS NULL").select("node_path", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(float(width)).alias("w"), F.lit(float(height)).alias("h"))
    levels = [level]
    for _ in range(max_depth):
        boxes = levels[-1].select(F.col("node_path").alias("parent_path"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("w").alias("pw"), F.col("h").alias("ph"))
        levels.append(materialise(base.join(boxes, "parent_path").groupBy("parent_path").applyInPandas(_place_children, BOX)))
    return reduce(DataFrame.unionByName, levels)


def gradient_focus(box: tuple[Column, Column, Column, Column], around: tuple[Column, Column, Column, Column], weight: Column) -> tuple[Column, Column]:
    """Where the light falls on a box, in shares of it: from its middle towards that of the box around by its weight."""

    def towards(at: Column, size: Column, outer_at: Column, outer_size: Column) -> Column:
        middle = at + size / 2
        return F.when(size > 0, (middle + (outer_at + outer_size / 2 - middle) * weight - at) / size).otherwise(0.5)

    return towards(box[0], box[2], around[0], around[2]), towards(box[1], box[3], around[1], around[3])


# packed circles


def pack_circles(radii: list[float], gap: float = 0.0) -> tuple[list[tuple[float, float]], float]:
    """(centres, radius of the circle around all): each circle, large ones first, touches two placed ones as near the middle as can be.

    All pairs of placed circles are tried between which a circle of the size can lie; as sizes fall, pairs too far apart for
    one circle are so for all later ones. A place taken remembers by which circle, which mostly settles it the next time.
    """
    order = sorted(range(len(radii)), key=lambda k: (-radii[k], k))
    rs = np.array([radii[k] + gap for k in order], dtype=float)
    xs, ys = np.zeros(len(order)), np.zeros(len(order))
    i, j, taken = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    for m, r in enumerate(rs.tolist()):
        px, py, pr = xs[:m], ys[:m], rs[:m]
        if m == 1:
            xs[m] = pr[0] + r
        elif m > 1:
            dx, dy = px[j] - px[i], py[j] - py[i]
            d = np.hypot(dx, dy)
            a, b = pr[i] + r, pr[j] + r
            near = (d > 0) & (d <= a + b)
            d = np.where(d > 0, d, 1.0)
            along = (a * a - b * b + d * d) / (2 * d)
            off = np.sqrt(np.maximum(a * a - along * along, 0.0))
            ux, uy = dx / d, dy / d
            x = np.stack([px[i] + along * ux - off * uy, px[i] + along * ux + off * uy], axis=1)
            y = np.stack([py[i] + along * uy + off * ux, py[i] + along * uy - off * ux], axis=1)
            open_ = np.flatnonzero((near[:, None] & (np.hypot(px[taken] - x, py[taken] - y) >= pr[taken] + r - 1e-9)).ravel())
            x, y, by = x.ravel(), y.ravel(), taken.reshape(-1)
            far = x[open_] ** 2 + y[open_] ** 2
            for c in open_[np.argsort(far, kind="stable")].tolist():
                room = np.hypot(px - x[c], py - y[c]) - pr - r
                if room.min() >= -1e-9:
                    xs[m], ys[m] = x[c], y[c]
                    break
                by[c] = room.argmin()
            else:
                xs[m] = float((np.hypot(px, py) + pr).max()) + r
        beside = np.flatnonzero(np.hypot(px - xs[m], py - ys[m]) <= pr + 3 * r + 1e-9)
        i, j = np.concatenate([i, np.full(len(beside), m)]), np.concatenate([j, beside])
        taken = np.concatenate([taken, np.zeros((len(beside), 2), np.int64)])
    placed = list(zip(xs.tolist(), ys.tolist(), rs.tolist()))
    cx, cy, around = enclosing_circle(placed)
    centres = [(0.0, 0.0)] * len(radii)
    for k, (x, y, _) in zip(order, placed):
        centres[k] = (x - cx, y - cy)
    return centres, around


def enclosing_circle(circles: list[tuple[float, float, float]]) -> tuple[float, float, float]:
    """A circle around circles, by moving towards the farthest one in shrinking steps."""
    c = np.array(circles)
    x, y = c[:, 0].mean(), c[:, 1].mean()
    for step in range(1, 400):
        far = np.hypot(c[:, 0] - x, c[:, 1] - y) + c[:, 2]
        k = int(far.argmax())
        x, y = x + (c[k, 0] - x) / (step + 1), y + (c[k, 1] - y) / (step + 1)
    return float(x), float(y), float((np.hypot(c[:, 0] - x, c[:, 1] - y) + c[:, 2]).max())


def bubble_tree(nodes: DataFrame, max_depth: int, gap: float = 2.0) -> DataFrame:
    """(node_path, dx, dy, radius): each node's circle relative to the centre of its parent's.

    nodes: node_path, parent_path, node_kind, tree_depth, size. Bottom up, one grouped step a level: a directory's circle
    encloses those of its children.
    """
    base = materialise(nodes.select("node_path", "parent_path", "node_kind", "tree_depth", F.greatest(F.coalesce(F.col("size").cast("double"), F.lit(1.0)), F.lit(1.0)).alias("size")))

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["radius", "node_path"], ascending=[False, True])
        centres, around = pack_circles(g["radius"].tolist(), gap / 2)
        rows = [(p, x, y, r, False) for p, (x, y), r in zip(g["node_path"], centres, g["radius"])]
        return pd.DataFrame([*rows, (key[0], 0.0, 0.0, around, True)], columns=["node_path", "dx", "dy", "radius", "is_parent"])

    files = base.where("node_kind = 'file'").select("node_path", "parent_path", "tree_depth", F.sqrt("size").alias("radius"))
    dirs, out = None, []
    for depth in range(max_depth, 0, -1):
        level = files.where(F.col("tree_depth") == depth).select("node_path", "parent_path", "radius")
        if dirs is not None:
            level = level.unionByName(base.where("node_kind = 'dir'").where(F.col("tree_depth") == depth).join(dirs, "node_path").select("node_path", "parent_path", "radius"))
        packed = materialise(level.groupBy("parent_path").applyInPandas(pack, "node_path string, dx double, dy double, radius double, is_parent boolean"))
        out.append(packed.where("NOT is_parent").drop("is_parent"))
        dirs = packed.where("is_parent").select("node_path", "radius")
    if dirs is None:  # nothing has a parent
        dirs = base.select("node_path", F.sqrt("size").alias("radius"))
    roots = dirs.select("node_path", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), "radius")
    return reduce(DataFrame.unionByName, [*out, roots])


# surface


def smoother(t: Column) -> Column:
    """1 at no distance, 0 at the support radius, flat at both ends."""
    return 1 - t * t * t * (t * (t * 6 - 15) + 10)


def interpolate(points: DataFrame, observations: DataFrame, radius: float) -> DataFrame:
    """points (px, py) with value: an observation (ox, oy, value) at the very place, else the weighted mean of those within the radius.

    Both sides are keyed by square cells of the radius' size and a point meets only its own and the eight cells around it: an
    equality join instead of all pairs. Points without an observation near are left with NULL.
    """
    cell = F.lit(float(radius))
    own = observations.select(F.floor(F.col("ox") / cell).alias("cx"), F.floor(F.col("oy") / cell).alias("cy"), "ox", "oy", "value")
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    keyed = points.select("px", "py", F.explode(steps).alias("s")).select("px", "py", (F.floor(F.col("px") / cell) + F.col("s.i")).alias("cx"), (F.floor(F.col("py") / cell) + F.col("s.j")).alias("cy"))
    near = keyed.join(own, ["cx", "cy"]).withColumn("d", F.hypot(F.col("px") - F.col("ox"), F.col("py") - F.col("oy"))).where(F.col("d") < cell)
    w = smoother(F.col("d") / cell)
    per = near.groupBy("px", "py").agg(F.avg(F.when(F.col("d") == 0, F.col("value"))).alias("hit"), (F.sum(w * F.col("value")) / F.sum(w)).alias("mean"))
    return points.join(per, ["px", "py"], "left").select("px", "py", F.coalesce("hit", "mean").alias("value"))


def nearest_distances(observations: DataFrame) -> DataFrame:
    """(ox, oy, n, d): each place with its number of observations and the distance to the nearest other place.

    Rounds of an equality join on square cells: a neighbour within the cells' size lies in one of the nine cells around a
    place, so a distance up to that size is final. What finds none so near is sought again in cells twice as large. The first
    size follows from the extent and the number of places; a single place has no neighbour and gives no row.
    """
    places = materialise(observations.where("ox IS NOT NULL AND oy IS NOT NULL AND NOT isnan(ox) AND NOT isnan(oy)").groupBy("ox", "oy").agg(F.count("*").alias("n")))
    e = places.agg(F.count("*").alias("n"), (F.max("ox") - F.min("ox")).alias("w"), (F.max("oy") - F.min("oy")).alias("h")).first()
    empty = places.select("ox", "oy", "n", F.lit(0.0).alias("d")).limit(0)
    if e.n < 2:
        return empty
    extent = math.hypot(e.w, e.h)
    size, open_places, found = extent / math.sqrt(e.n), places, empty
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    while True:
        cell = F.lit(size)
        other = places.select(F.floor(F.col("ox") / cell).alias("cx"), F.floor(F.col("oy") / cell).alias("cy"), F.col("ox").alias("qx"), F.col("oy").alias("qy"))
        keyed = open_places.select("ox", "oy", "n", F.explode(steps).alias("s"))
        keyed = keyed.select("ox", "oy", "n", (F.floor(F.col("ox") / cell) + F.col("s.i")).alias("cx"), (F.floor(F.col("oy") / cell) + F.col("s.j")).alias("cy"))
        d = F.hypot(F.col("ox") - F.col("qx"), F.col("oy") - F.col("qy"))
        near = keyed.join(other, ["cx", "cy"], "left").groupBy("ox", "oy", "n").agg(F.min(F.when(d > 0, d)).alias("d"))
        last = size >= extent
        near = materialise(near.withColumn("final", F.coalesce(F.col("d") <= size, F.lit(False)) | F.lit(last)))
        found = found.unionByName(near.where("final").drop("final"))
        open_places = near.where("NOT final").select("ox", "oy", "n")
        if last or open_places.isEmpty():
            return found
        size = min(2 * size, extent)


def support_radius(observations: DataFrame, percentile: float = 0.9, times: float = 2.0) -> DataFrame:
    """One row (radius): a multiple of a percentile of the observations' distances to the nearest other place; NULL if there is none.

    A place counts as often as it was observed. Distances are summed up by value, and the one at the rank is found among
    running totals over range partitions.
    """
    per = materialise(nearest_distances(observations).groupBy("d").agg(F.sum("n").alias("n")).repartitionByRange("d").withColumn("part", F.spark_partition_id()))
    parts = per.groupBy("part").agg(F.sum("n").alias("of_part"))
    before = parts.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("before"))  # a row per partition
    within = F.sum("n").over(Window.partitionBy("part").orderBy("d"))
    total = parts.agg(F.sum("of_part").alias("total"))
    ranked = per.withColumn("upto", within).join(F.broadcast(before), "part").crossJoin(F.broadcast(total))
    return ranked.where(F.col("upto") + F.col("before") >= F.ceil(F.lit(percentile) * F.col("total"))).agg((F.lit(times) * F.min("d")).alias("radius"))


def poisson_points(width: float, height: float, distance: float, seed: int = 1, tries: int = 20) -> list[tuple[float, float]]:
    """Points that fill a rectangle with no two nearer than a distance, by throwing darts around those that are there."""
    rng = np.random.default_rng(seed)
    cell = distance / math.sqrt(2)
    cells: dict[tuple[int, int], tuple[float, float]] = {}

    def free(x: float, y: float) -> bool:
        i, j = int(x / cell), int(y / cell)
        around = (cells.get((i + a, j + b)) for a in range(-2, 3) for b in range(-2, 3))
        return all(q is None or math.hypot(q[0] - x, q[1] - y) >= distance for q in around)

    first = (width * rng.random(), height * rng.random())
    cells[int(first[0] / cell), int(first[1] / cell)] = first
    out, active = [first], [first]
    while active:
        k = int(rng.integers(len(active)))
        for _ in range(tries):
            angle, r = 2 * math.pi * rng.random(), distance * (1 + rng.random())
            x, y = active[k][0] + r * math.cos(angle), active[k][1] + r * math.sin(angle)
            if 0 <= x < width and 0 <= y < height and free(x, y):
                cells[int(x / cell), int(y / cell)] = (x, y)
                out.append((x, y))
                active.append((x, y))
                break
        else:
            active.pop(k)
    return out


def clip_to_band(triangle: list[tuple[float, float, float]], lo: float, hi: float) -> list[tuple[float, float, float]]:
    """The part of a triangle (x, y, value) whose value lies between two breakpoints."""
    shape = list(triangle)
    for bound, sign in ((lo, 1), (hi, -1)):
        if math.isinf(bound):
            continue
        cut = []
        for p, q in zip(shape, shape[1:] + shape[:1]):
            dp, dq = sign * (p[2] - bound), sign * (q[2] - bound)
            if dp >= 0:
                cut.append(p)
            if dp * dq < 0:
                t = dp / (dp - dq)
                cut.append(tuple(a + t * (b - a) for a, b in zip(p, q)))
        shape = cut
    return shape


def band_parts(triangle: list[tuple[float, float, float]], breaks: list[float]) -> list[tuple[int, list[tuple[float, float, float]]]]:
    """(band, polygon) of the parts of a triangle between rising breakpoints; a part without area is left out."""
    edges = [-math.inf, *breaks, math.inf]
    parts = ((k, clip_to_band(triangle, lo, hi)) for k, (lo, hi) in enumerate(zip(edges, edges[1:])))
    flat = triangle[0][2] == triangle[1][2] == triangle[2][2]  # lies in one band, even on a breakpoint
    own = sum(triangle[0][2] >= b for b in breaks)
    return [(k, p) for k, p in parts if len(p) > 2 and polygon_area(p) > 0 and (not flat or k == own)]


def polygon_area(points: list[tuple[float, ...]]) -> float:
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1]))) / 2


def bands(triangles: DataFrame, breaks: list[float]) -> DataFrame:
    """(triangle, band, points, area): the parts of each triangle that lie between the breakpoints; no shuffle.

    triangles: triangle, and x, y, v with the suffixes 0, 1, 2. Corners without a value and triangles without area give none.
    """
    if any(a >= b for a, b in zip(breaks, breaks[1:])):
        raise ValueError("breakpoints must rise")
    corners = [f"{c}{i}" for i in range(3) for c in "xyv"]

    def cut(batches):
        for batch in batches:
            rows = []
            for key, *c in batch[["triangle", *corners]].itertuples(index=False):
                shape = [tuple(c[:3]), tuple(c[3:6]), tuple(c[6:])]
                if all(map(math.isfinite, c)) and polygon_area(shape) > 0:
                    rows += [(key, k, [list(map(float, p)) for p in part], polygon_area(part)) for k, part in band_parts(shape, breaks)]
            yield pd.DataFrame(rows, columns=["triangle", "band", "points", "area"])

    return triangles.select(F.col("triangle").cast("bigint").alias("triangle"), *(F.col(c).cast("double").alias(c) for c in corners)).na.drop().mapInPandas(cut, "triangle bigint, band int, points array<array<double>>, area double")


def delaunay(points: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Triangles (numbers of their corners, rising) in whose circumcircles no other point lies: points are put in one by one.

    For the points of one picture (hundreds to a few thousand). Repeated points count once; points on one line give no triangle.
    """
    xy = np.asarray(points, float).reshape(-1, 2)
    if len(xy) < 3:
        return []
    n, span = len(xy), float(np.ptp(xy, axis=0).max()) or 1.0
    cx, cy = xy.mean(axis=0)
    far = 1000 * span
    corner = np.vstack([xy, [[cx - far, cy - far], [cx + far, cy - far], [cx, cy + far]]])

    def circle(t: tuple[int, int, int]) -> tuple[float, float, float]:
        (ax, ay), (bx, by), (px, py) = corner[list(t)]
        d = 2 * ((bx - ax) * (py - ay) - (by - ay) * (px - ax))
        if d == 0:
            return ax, ay, math.inf
        b2, p2 = (bx - ax) ** 2 + (by - ay) ** 2, (px - ax) ** 2 + (py - ay) ** 2
        ux, uy = ((py - ay) * b2 - (by - ay) * p2) / d, ((bx - ax) * p2 - (px - ax) * b2) / d
        return ax + ux, ay + uy, ux * ux + uy * uy

    first = (n, n + 1, n + 2)
    held, circles = [first], np.array([circle(first)])
    seen: set[tuple[float, float]] = set()
    for k in np.lexsort((xy[:, 1], xy[:, 0])).tolist():
        x, y = xy[k]
        if (x, y) in seen:
            continue
        seen.add((x, y))
        inside = (circles[:, 0] - x) ** 2 + (circles[:, 1] - y) ** 2 < circles[:, 2] * (1 - 1e-12)
        rim: dict[tuple[int, int], int] = {}
        for i in np.flatnonzero(inside).tolist():
            a, b, c = held[i]
            for e in ((a, b), (b, c), (a, c)):
                rim[e] = rim.get(e, 0) + 1
        fresh = [tuple(sorted((*e, k))) for e, times in rim.items() if times == 1]
        held = [held[i] for i in np.flatnonzero(~inside).tolist()] + fresh
        circles = np.vstack([circles[~inside], [circle(t) for t in fresh]]) if fresh else circles[~inside]
    out = [t for t in held if t[2] < n]
    return sorted(t for t in out if polygon_area([tuple(corner[i]) for i in t]) > 1e-12 * span * span)
