"""Sessions by inactivity, as a cut through the Cartesian tree over each entity's gaps.

The events of an entity, in order of time, have a gap between each two neighbours. In the Cartesian tree over these gaps the
largest gap is the root and each node spans the events that are joined once its gap is bridged. A node is stored with its
gap, the gap of its parent, and the first time, last time and number of events it spans; events are the leaves. For any
threshold the sessions are the nodes with gap <= threshold < parent's gap: a filter, so one tree serves every setting.

The tree is built in chunks: contiguous ranges of (entity, time), so an entity with a third of all events is spread over
many tasks. Within a chunk every node bounded by larger gaps on both sides is final. What is left are the gaps that exceed
all others before or after them in the chunk (a spine, of logarithmic length unless the gaps keep growing), with the events
between them folded into one item; these few items of all chunks are merged by the same procedure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.session import materialise

#: Items of one entity that are held at once (and the batch that goes beyond it).
CHUNK_ROWS = 200_000
NODE = "entity string, gap bigint, parent_gap bigint, started bigint, ended bigint, n bigint, final boolean, leaf boolean"


def _bounds(gaps: list[int]) -> tuple[list[int], list[int]]:
    """Index of the nearest gap to the left that is >= and to the right that is >; -1 and len if there is none."""
    left, right, stack = [0] * len(gaps), [len(gaps)] * len(gaps), []
    for i, g in enumerate(gaps):
        while stack and gaps[stack[-1]] < g:
            right[stack.pop()] = i
        left[i] = stack[-1] if stack else -1
        stack.append(i)
    return left, right


def gap_tree(start: np.ndarray, end: np.ndarray, n: np.ndarray, leaf: np.ndarray, entity: str, whole: bool) -> list[tuple]:
    """Nodes of one entity's items (start, end, n, leaf), ordered by time and apart from each other.

    leaf: the item still needs its own row. whole: no item of the entity lies outside; then all nodes are final. Otherwise
    the rows with final=False are the items to merge with those of the neighbouring chunks.
    """
    s, e, w = start.tolist(), end.tolist(), n.tolist()
    gaps = (start[1:] - end[:-1]).tolist()
    m = len(gaps)
    left, right = _bounds(gaps)
    upto = [0, *np.cumsum(n).tolist()]
    rows: list[tuple] = []

    def node(i: int) -> tuple:
        lo, hi = left[i], right[i]
        around = [gaps[j] for j in (lo, hi) if 0 <= j < m]
        return (entity, gaps[i], min(around) if around else None, s[lo + 1], e[hi], upto[hi + 1] - upto[lo + 1], True, False)

    def single(i: int) -> tuple:
        around = [gaps[j] for j in (i - 1, i) if 0 <= j < m]
        return (entity, -1, min(around) if around else None, s[i], e[i], w[i], True, True)

    if whole:
        rows += [node(i) for i in range(m)]
        rows += [single(i) for i in np.flatnonzero(leaf).tolist()]
        return rows
    spine = [i for i in range(m) if left[i] < 0 or right[i] >= m]
    # of a run of equal gaps on the spine only the outer two matter: what lies between is final and folded
    keep = [i for k, i in enumerate(spine) if not (0 < k < len(spine) - 1 and gaps[spine[k - 1]] == gaps[i] == gaps[spine[k + 1]])]
    on_spine = set(spine)
    rows += [node(i) for i in range(m) if i not in on_spine]
    edges = {0, m}
    rows += [single(i) for i in np.flatnonzero(leaf).tolist() if i not in edges]
    cuts = [-1, *keep, m]
    for a, b in zip(cuts, cuts[1:]):
        edge = b == a + 1 and (a + 1) in edges
        rows.append((entity, -1, None, s[a + 1], e[b], upto[b + 1] - upto[a + 1], False, bool(edge and leaf[a + 1])))
    return rows


_COLUMNS = [c.split(" ")[0] for c in NODE.split(", ")]


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"parent_gap": "Int64"})


def _chunk(batches: Iterator[pd.DataFrame], flush_rows: int = 50_000, most: int = CHUNK_ROWS) -> Iterator[pd.DataFrame]:
    """One range of (entity, started): its first and last entity may go on in other ranges, all others are whole.

    An entity with more than `most` items is cut into several chunks, so a task holds no more of them at once.
    """
    entity, parts, first, rows, size = None, [], True, [], 0

    def finish(whole: bool) -> list[tuple]:
        columns = parts[0] if len(parts) == 1 else [np.concatenate(c) for c in zip(*parts)]
        return gap_tree(*columns, entity, whole)

    for batch in batches:
        if batch.empty:
            continue
        names = batch["entity"].to_numpy()
        columns = [batch[c].to_numpy() for c in ("started", "ended", "n", "leaf")]
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if entity is not None and names[a] != entity:
                rows += finish(whole=not first)
                parts, first, size = [], False, 0
                if len(rows) >= flush_rows:
                    yield _table(rows)
                    rows = []
            entity = names[a]
            if size >= most:
                rows += finish(whole=False)
                parts, first, size = [], True, 0  # what is left of the entity isn't whole either
            parts.append([c[a:b] for c in columns])
            size += b - a
    if entity is not None:
        rows += finish(whole=False)
    if rows:
        yield _table(rows)


def _merge(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
    items = items.sort_values("started")
    return _table(gap_tree(*(items[c].to_numpy() for c in ("started", "ended", "n", "leaf")), key[0], True))


def session_tree(events: DataFrame, entity: str, at_us: str) -> DataFrame:
    """entity, gap, parent_gap, started, ended, n: the gap tree of every entity (gap -1: a leaf; parent_gap NULL: a root).

    events: one row per event with the entity and the time as bigint. NULL entities or times are left out; events of one
    entity at one time form one leaf with their number; an empty input gives an empty tree.
    """
    items = (
        events.select(F.col(entity).cast("string").alias("entity"), F.col(at_us).alias("started"))
        .where("entity IS NOT NULL AND started IS NOT NULL")
        .groupBy("entity", "started")
        .agg(F.count("*").alias("n"))
        .select("entity", "started", F.col("started").alias("ended"), "n", F.lit(True).alias("leaf"))
    )
    ranges = items.repartitionByRange("entity", "started").sortWithinPartitions("entity", "started")
    nodes = materialise(ranges.mapInPandas(_chunk, NODE))
    open_items = nodes.where("NOT final").select("entity", "started", "ended", "n", "leaf")
    merged = open_items.groupBy("entity").applyInPandas(_merge, NODE)
    return nodes.where("final").unionByName(merged).select("entity", "gap", "parent_gap", "started", "ended", "n")


def sessions(tree: DataFrame, threshold_us: int) -> DataFrame:
    """entity, started, ended, n: the sessions at one threshold; a gap of exactly the threshold doesn't end a session."""
    return tree.where((F.col("gap") <= threshold_us) & (F.col("parent_gap").isNull() | (F.col("parent_gap") > threshold_us))).select("entity", "started", "ended", "n")
