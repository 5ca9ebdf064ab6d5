"""Nested JSON documents into related flat tables, by shared inlining.

The schema graph is analysed first: which element types occur under which, as one object, as a list or as a map. An element
type gets a table of its own if it is repeated, shared by several parents or recursive; every other element is a singleton
descendant and its scalars become prefixed columns of the nearest ancestor with a table. Each row has its number within the
document and its parent's, so every table can be joined to its parent's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ELEMENTS = ("one", "many", "map")
ROW = "doc string, element string, row_no bigint, parent_element string, parent_no bigint, ordinal bigint, label_path string, parent_path string, depth int, attrs map<string,string>"


@dataclass(frozen=True)
class Shape:
    """What the analysis cannot know from names alone.

    same_type: keys whose elements are of another key's type (the root is a directory). maps: keys that hold a map, whose
    entries are rows with key and value. lists: keys that hold a list even where one object or NULL stands in its place.
    label: scalar keys that name a row, in order of preference; of one that holds a path the last segment is taken.
    """

    root: str = "root"
    same_type: Mapping[str, str] = field(default_factory=dict)
    maps: tuple[str, ...] = ()
    lists: tuple[str, ...] = ()
    label: tuple[str, ...] = ("name",)
    label_paths: tuple[str, ...] = ("path",)

    def type_of(self, key: str) -> str:
        return self.same_type.get(key, key)


def parse(text: str | None, root: str) -> dict | None:
    """The root object of a payload; None if it isn't readable or has none."""
    try:
        doc = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    top = doc.get(root) if isinstance(doc, dict) else None
    return top if isinstance(top, dict) else None


def _edges(top: dict, shape: Shape) -> set[tuple[str, str, str]]:
    found, todo = {("", shape.type_of(shape.root), "one")}, [(shape.type_of(shape.root), top)]
    while todo:
        kind, node = todo.pop()
        for key, value in node.items():
            child = shape.type_of(key)
            if key in shape.maps:
                found.add((kind, child, "map"))
                if isinstance(value, dict):
                    found.update((child, "value", _scalar(v)) for v in value.values())
            elif isinstance(value, list):
                inner = [x for x in value if isinstance(x, dict)]
                found.add((kind, child, "many"))
                todo += [(child, x) for x in inner]
            elif isinstance(value, dict):
                found.add((kind, child, "many" if key in shape.lists else "one"))
                todo.append((child, value))
            elif key in shape.lists:
                found.add((kind, child, "many"))
            else:
                found.add((kind, child, _scalar(value)))
    return found


def _scalar(value) -> str:
    return "null" if value is None else "boolean" if value is True or value is False else {int: "bigint", float: "double"}.get(type(value), "string")


def with_edges(docs: DataFrame, payload: str, shape: Shape) -> DataFrame:
    """docs with the schema edges of each payload, as JSON texts; NULL if it can't be read or has no root."""
    texts: dict[tuple[str, str, str], str] = {}

    @F.pandas_udf("array<string>")
    def edges(payloads: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[str] | None:
            if (top := parse(text, shape.root)) is None:
                return None
            return [texts.setdefault(e, json.dumps(e)) for e in _edges(top, shape)]

        return payloads.map(of)

    return docs.withColumn("edges", edges(payload))


def schema_graph(docs: DataFrame, max_edges: int = 10_000) -> list[tuple[str, str, str]]:
    """The distinct (parent type, key, form) over all documents with edges; bounded by the schema, not by the data.

    form: one, many or map for an element, else the type of a scalar.
    """
    rows = docs.select(F.explode("edges").alias("edge")).distinct().limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        raise ValueError(f"more than {max_edges} schema edges: are all maps declared?")
    return sorted(tuple(json.loads(r.edge)) for r in rows)


def own_tables(edges: Sequence[tuple[str, str, str]]) -> set[str]:
    """The element types that get a table: the root, and all that are repeated, shared or recursive."""
    elements = [(p, c, f) for p, c, f in edges if f in ELEMENTS]
    parents: dict[str, set[str]] = {}
    for p, c, _ in elements:
        parents.setdefault(c, set()).add(p)
    children: dict[str, set[str]] = {}
    for p, c, _ in elements:
        children.setdefault(p, set()).add(c)

    def reaches_itself(x: str) -> bool:
        todo, seen = list(children.get(x, ())), set()
        while todo:
            y = todo.pop()
            if y == x:
                return True
            if y not in seen:
                seen.add(y)
                todo += children.get(y, ())
        return False

    return {c for _, c, f in elements if f in ("many", "map")} | {c for c, ps in parents.items() if len(ps) > 1 or "" in ps} | {c for c in parents if reaches_itself(c)}


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def _label(node: dict, shape: Shape) -> str:
    for key in shape.label:
        if isinstance(node.get(key), str) and node[key]:
            return node[key]
    for key in shape.label_paths:
        if isinstance(node.get(key), str):
            parts = node[key].replace("\\", "/").rstrip("/").rsplit("/", 1)
            return parts[-1]
    return ""


def _rows(doc: str, top: dict, shape: Shape, tables: set[str], wanted: frozenset[str] | None) -> Iterator[tuple]:
    """Depth-first; singleton descendants without a table are folded into their ancestor's attributes."""
    count = 0
    todo = [(shape.type_of(shape.root), top, None, None, 0, None, 0)]
    while todo:
        element, node, up, up_no, ordinal, above, depth = todo.pop()
        no, count = count, count + 1
        label = _label(node, shape)
        path = label if above is None else f"{above}/{label}"
        attrs: dict[str, str | None] = {}
        inner = [("", node)]
        below = []
        while inner:
            prefix, part = inner.pop()
            for key, value in part.items():
                child = shape.type_of(key)
                if key in shape.maps:
                    if isinstance(value, dict) and wanted is not None and child not in wanted:
                        count += len(value)
                    elif isinstance(value, dict):
                        for k, (name, v) in enumerate(value.items()):
                            yield (doc, child, count, element, no, k, f"{path}#{name}", path, depth + 1, {"key": name, "value": _text(v)})
                            count += 1
                elif isinstance(value, list):
                    below += [(child, x, element, no, k, path, depth + 1) for k, x in enumerate(value) if isinstance(x, dict)]
                    if any(not isinstance(x, dict) and x is not None for x in value):
                        attrs[prefix + key] = _text([x for x in value if not isinstance(x, dict)])
                elif isinstance(value, dict):
                    if child in tables:
                        below.append((child, value, element, no, 0, path, depth + 1))
                    else:
                        inner.append((f"{prefix}{key}.", value))
                elif key not in shape.lists:
                    attrs[prefix + key] = _text(value)
        if wanted is None or element in wanted:
            yield (doc, element, no, up, up_no, ordinal, path, above or "", depth, attrs)
        todo += reversed(below)


def column_types(edges: Sequence[tuple[str, str, str]], tables: set[str]) -> dict[str, dict[str, str]]:
    """table -> its columns with their types: whole numbers bigint, with fractions among them double, mixed kinds string."""
    seen: dict[str, dict[str, set[str]]] = {t: {} for t in sorted(tables)}

    def inline(table: str, element: str, prefix: str) -> None:
        for p, c, f in edges:
            if p == element and c not in tables:
                if f == "one":
                    inline(table, c, f"{prefix}{c}.")
                elif f not in ELEMENTS:
                    seen[table].setdefault(prefix + c, set()).add(f)

    for t in seen:
        if any(c == t and f == "map" for _, c, f in edges):
            seen[t] = {"key": {"string"}, "value": set()}
        inline(t, t, "")

    def kind(types: set[str]) -> str:
        types = types - {"null"}
        return types.pop() if len(types) == 1 else "double" if types == {"bigint", "double"} else "string"

    return {t: {c: kind(types) for c, types in columns.items()} for t, columns in seen.items()}


def shred(docs: DataFrame, doc_id: str, payload: str, shape: Shape, elements: Sequence[str] | None = None, batch_rows: int = 20_000) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """(all rows of all tables, table -> its columns and their types).

    A row: doc, element (its table), row_no, parent_element, parent_no, ordinal among its siblings, label_path (the labels
    from the root down, joined by /), parent_path, depth, attrs. Documents that can't be read or have no root give no row;
    NULL elements of lists are left out; one object in place of a list counts as a list of one; documents are independent,
    so there is no shuffle and a document is the largest unit of work. `table_of` cuts out one table. elements: the tables
    that are wanted, if not all. docs may have a column edges (see with_edges), else the payloads are read once more for it.
    """
    wanted = None if elements is None else frozenset(elements)
    edges = schema_graph(docs if "edges" in docs.columns else with_edges(docs, payload, shape))
    tables = own_tables(edges)

    names = [x.split(" ")[0] for x in ROW.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch["doc"], batch["payload"]):
                if (top := parse(text, shape.root)) is not None:
                    for row in _rows(doc, top, shape, tables, wanted):
                        out.append(row)
                        if len(out) >= batch_rows:
                            yield pd.DataFrame(out, columns=names).astype({"parent_no": "Int64"})
                            out = []
        yield pd.DataFrame(out, columns=names).astype({"parent_no": "Int64"})

    rows = docs.select(F.col(doc_id).cast("string").alias("doc"), F.col(payload).alias("payload")).where("doc IS NOT NULL AND payload IS NOT NULL").mapInPandas(walk, ROW)
    return rows, column_types(edges, tables)


def table_of(rows: DataFrame, columns: Mapping[str, Mapping[str, str]], element: str) -> DataFrame:
    """One flat table: keys to the row and its parent, then a typed column for each inlined attribute."""
    attrs = [F.try_element_at("attrs", F.lit(c)).try_cast(t).alias(c) for c, t in columns[element].items()]
    keys = ["doc", "row_no", "parent_element", "parent_no", "ordinal", "label_path", "parent_path", "depth"]
    return rows.where(F.col("element") == element).select(*keys, *attrs)


def latest_readable(docs: DataFrame, doc_id: str, payload: str, at: str, shape: Shape) -> DataFrame:
    """(doc_id, payload, edges): the latest sent payload of each document among those that can be read and have a root.

    Of several sent at one time the greatest text counts. A payload is parsed once, for its edges, which also tell whether it can be read.
    """
    good = with_edges(docs.select(F.col(doc_id).alias("doc_id"), F.col(payload).alias("payload"), F.col(at).alias("at")).where("payload IS NOT NULL AND doc_id IS NOT NULL"), "payload", shape)
    best = F.max_by(F.struct("payload", "edges"), F.struct("at", "payload")).alias("best")
    latest = good.where("edges IS NOT NULL").groupBy("doc_id").agg(best)
    return latest.select(F.col("doc_id").alias(doc_id), F.col("best.payload").alias(payload), F.col("best.edges").alias("edges"))


EXPORT_SHAPE = Shape(root="root", same_type={"root": "directories"}, maps=("quantities", "measures", "classifications"), lists=("directories", "files"))
