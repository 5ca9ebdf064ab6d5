"""Trees with their metrics as nested documents, and the catalogue of metrics and expressions."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.plans.expr import valid_expressions
from treeline.plans.registry import CLASSIFICATION, MEASURE, QUANTITY, Registry
from treeline.session import materialise


def metric_maps(rows: DataFrame, kinds: dict[str, str]) -> list[Column]:
    """Up to three maps, one per kind, of the metrics a row has; NULL where it has none of a kind."""
    out = []
    for kind, name, kind_type in ((QUANTITY, "quantities", "bigint"), (MEASURE, "measures", "double"), (CLASSIFICATION, "classifications", "string")):
        entries = [F.when(F.col(f"`{m}`").isNotNull(), F.struct(F.lit(m).alias("key"), F.col(f"`{m}`").cast(kind_type).alias("value"))) for m in sorted(kinds) if kinds[m] == kind]
        if entries:
            there = F.filter(F.array(*entries), lambda e: e.isNotNull())
            out.append(F.when(F.size(there) > 0, F.map_from_entries(there)).alias(name))
    return out


def tree_documents(nodes: DataFrame, kinds: dict[str, str], max_depth: int) -> DataFrame:
    """(root_path, document): each tree as nested JSON text.

    nodes: node_path, parent_path, node_name, node_kind, tree_depth, extension, is_binary and a column per metric. Bottom up,
    one aggregate a level: a directory's text is put together from its children's; absent maps and values are left out.
    """
    file = F.struct(F.col("node_name").alias("name"), F.col("node_path").alias("path"), "extension", F.col("is_binary").alias("isBinary"), *metric_maps(nodes, kinds))
    folder = F.struct(F.col("node_name").alias("name"), F.col("node_path").alias("path"), *metric_maps(nodes, kinds))
    text = F.when(F.col("node_kind") == "file", F.to_json(file)).otherwise(F.to_json(folder))
    base = materialise(nodes.select("node_path", "parent_path", "node_name", "node_kind", "tree_depth", text.alias("own")))
    files = base.where("node_kind = 'file'").select("parent_path", "tree_depth", "node_name", F.col("own").alias("doc"), F.lit(True).alias("is_file"))
    below, roots = None, []
    for depth in range(max_depth, -1, -1):
        level = base.where("node_kind = 'dir'").where(F.col("tree_depth") == depth)
        children = files.where(F.col("tree_depth") == depth + 1).drop("tree_depth")
        if below is not None:
            children = children.unionByName(below)

        def listed(is_file: bool) -> Column:
            mine = F.sort_array(F.collect_list(F.when(F.col("is_file") == is_file, F.struct("node_name", "doc"))))
            return F.array_join(F.transform(mine, lambda c: c["doc"]), ",")

        grouped = children.groupBy(F.col("parent_path").alias("node_path")).agg(listed(False).alias("d"), listed(True).alias("f"))
        whole = level.join(grouped, "node_path", "left")
        tail = F.concat(*(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f',"{n}":['), c, F.lit("]"))).otherwise("") for n, c in (("directories", F.col("d")), ("files", F.col("f")))))
        done = whole.withColumn("doc", F.concat(F.substring("own", 1, F.length("own") - 1), tail, F.lit("}")))
        roots.append(done.where("parent_path IS NULL").select(F.col("node_path").alias("root_path"), F.concat(F.lit('{"root":'), "doc", F.lit("}")).alias("document")))
        below = materialise(done.where("parent_path IS NOT NULL").select("parent_path", "node_name", "doc", F.lit(False).alias("is_file")))
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return out


def export_format(path: str) -> str:
    """json or yaml by the extension; others raise ValueError."""
    found = {".json": "json", ".yaml": "yaml", ".yml": "yaml"}.get(os.path.splitext(path)[1].lower())
    if found is None:
        raise ValueError(f"can't tell the format of {path}")
    return found


def to_yaml(value, indent: int = 0) -> str:
    """A parsed document as YAML; texts are quoted as in JSON."""
    pad = "  " * indent
    if isinstance(value, dict) and value:
        return "".join(f"{pad}{json.dumps(k, ensure_ascii=False)}:" + (f"\n{to_yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f" {to_yaml(v).strip()}\n") for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}-\n{to_yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f"{pad}- {to_yaml(v).strip()}\n" for v in value)
    return f"{pad}{json.dumps(value, ensure_ascii=False)}\n"


def save_document(document: str, path: str) -> None:
    """One tree's document to a file that only its owner can read."""
    parsed = json.loads(document)
    text = to_yaml(parsed) if export_format(path) == "yaml" else json.dumps(parsed, indent=2, ensure_ascii=False) + "\n"
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        f.write(text)


def metric_catalogue(spark: SparkSession, registry: Registry) -> DataFrame:
    """(name, kind, level, filters, aggregations, palette) of every metric."""
    rows = [(m.name, m.kind, m.level, ",".join(m.filters), ",".join(m.aggregations), m.palette) for m in registry.all()]
    return spark.createDataFrame(rows, "name string, kind string, level string, filters string, aggregations string, palette string")


def expression_catalogue(spark: SparkSession, registry: Registry) -> DataFrame:
    """(expression, base, filter, aggregation) of every valid expression."""
    return spark.createDataFrame([(str(e), e.base, e.filter, e.aggregation) for e in valid_expressions(registry)], "expression string, base string, filter string, aggregation string")


def summary(nodes: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """One row: files, directories and how many files lack each column."""
    lacks = [F.count_if((F.col("node_kind") == "file") & F.col(c).isNull()).alias(f"without_{c}") for c in columns]
    return nodes.agg(F.count_if(F.col("node_kind") == "file").alias("files"), F.count_if(F.col("node_kind") == "dir").alias("dirs"), *lacks)
