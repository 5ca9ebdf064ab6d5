"""The tree of directories and files: nodes, ancestors, counts, depth, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node: the latest scan of each, of equally late ones the greater value.

    Each column is an aggregate of its own, so that columns nobody asks for are neither read nor shuffled.
    """
    others = [c for c in nodes.columns if c not in ("node_id", "scanned_at")]
    last = [F.max(F.struct("scanned_at", F.col(c).alias("v"))).getField("v").alias(c) for c in others]
    return nodes.where("node_id IS NOT NULL AND node_path IS NOT NULL").groupBy("node_id").agg(*last)


def prefixes(path: Column) -> Column:
    """All prefixes of a path, itself last: a, a/b, a/b/c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def parent_of(path: Column) -> Column:
    """The path without its last segment; NULL at a root."""
    up = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(up != "", up)


def closure(nodes: DataFrame) -> DataFrame:
    """(ancestor_path, descendant_path, distance): each node with all its ancestors and itself."""
    up = F.posexplode(F.reverse(prefixes(F.col("node_path"))))
    return nodes.select(F.col("node_path").alias("descendant_path"), up.alias("distance", "ancestor_path")).select("ancestor_path", "descendant_path", "distance")


def to_ancestors(by_directory: DataFrame, path: str = "dir") -> DataFrame:
    """Rows of directories repeated for each directory at or above them, as node_path."""
    return by_directory.withColumn("node_path", F.explode(prefixes(F.col(path)))).drop(path)


def tree_counts(nodes: DataFrame) -> DataFrame:
    """(node_path, direct_files, all_files, all_dirs) of each directory that has a file below it.

    Counts are summed per parent first, so only directories, not files, are repeated for their ancestors.
    """
    files = nodes.where("node_kind = 'file'").groupBy(F.col("parent_path").alias("dir")).agg(F.count("*").alias("n"))
    dirs = nodes.where("node_kind = 'dir' AND parent_path IS NOT NULL").select("node_path", F.col("parent_path").alias("dir"))
    holding = to_ancestors(files.select("dir")).distinct()
    kept = dirs.join(holding, "node_path", "left_semi").groupBy("dir").agg(F.count("*").alias("d"))
    direct = files.withColumnRenamed("dir", "node_path").withColumnRenamed("n", "direct_files")
    all_files = to_ancestors(files).groupBy("node_path").agg(F.sum("n").alias("all_files"))
    all_dirs = to_ancestors(kept).groupBy("node_path").agg(F.sum("d").alias("all_dirs"))
    out = all_files.join(direct, "node_path", "left").join(all_dirs, "node_path", "left")
    return out.select("node_path", F.coalesce("direct_files", F.lit(0)).alias("direct_files"), "all_files", F.coalesce("all_dirs", F.lit(0)).alias("all_dirs"))


def leaf_counts(nodes: DataFrame) -> DataFrame:
    """(node_path, leaf_count, max_depth) of each directory: files below it, or 1 if there are none; steps to the deepest file."""
    files = nodes.where("node_kind = 'file'").groupBy(F.col("parent_path").alias("dir")).agg(F.count("*").alias("n"), F.max("tree_depth").alias("deepest"))
    below = to_ancestors(files).groupBy("node_path").agg(F.sum("n").alias("n"), F.max("deepest").alias("deepest"))
    dirs = nodes.where("node_kind = 'dir'").select("node_path", "tree_depth")
    out = dirs.join(below, "node_path", "left")
    return out.select("node_path", F.coalesce("n", F.lit(1)).alias("leaf_count"), F.coalesce(F.col("deepest") - F.col("tree_depth"), F.lit(0)).cast("bigint").alias("max_depth"))


def without_binaries(nodes: DataFrame) -> DataFrame:
    """Files that aren't binary and the directories that still hold one; NULL counts as not binary."""
    files = nodes.where("node_kind = 'file' AND NOT coalesce(is_binary, false)")
    holding = to_ancestors(files.select(F.col("parent_path").alias("dir")).distinct()).distinct()
    dirs = nodes.where("node_kind = 'dir'").join(holding, "node_path", "left_semi")
    return files.unionByName(dirs)


def nearest_ancestor(nodes: DataFrame, marks: DataFrame, value: str) -> DataFrame:
    """(node_path, value): of the marked directories (node_path, value) at or above each node's parent, the nearest one's value."""
    dirs = nodes.where("node_kind = 'file'").select(F.col("parent_path").alias("dir")).distinct()
    found = to_ancestors(dirs.withColumn("own", F.col("dir"))).join(marks, "node_path").groupBy("own").agg(F.max_by(value, F.length("node_path")).alias(value))
    return nodes.where("node_kind = 'file'").select("node_path", F.col("parent_path").alias("own")).join(found, "own").select("node_path", value)


def require_files(nodes: DataFrame) -> DataFrame:
    """nodes; raises ValueError if no file is left."""
    if nodes.where("node_kind = 'file'").isEmpty():
        raise ValueError("no files found")
    return nodes


def file_extension(name: Column) -> Column:
    """The part after the last dot; no-extension if there is none."""
    found = F.regexp_extract(name, r"\.([^.]*)$", 1)
    return F.when(found == "", "no-extension").otherwise(found)


def line_count(text: Column) -> Column:
    """Lines of a text; a last line without line end counts, an empty text has none."""
    ends = F.length(text) - F.length(F.regexp_replace(text, "\n", ""))
    return (ends + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("bigint")


def comment_ratio(text: Column) -> Column:
    """Comment lines among the lines that aren't blank; 0 if all are blank."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    comments = F.filter(lines, lambda x: x.rlike(r"^\s*(?://|#(?!include|define)|/\*|\*)"))
    return F.when(F.size(lines) > 0, F.size(comments) / F.size(lines)).otherwise(F.lit(0.0))
