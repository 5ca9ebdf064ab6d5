"""Directories on disk as node tables; mailmaps; exported commit logs; settings."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators import globs, tree

PROBE_BYTES = 8000
LOG_FORMAT = "%x01%H%x09%P%x09%an%x09%ae%x09%at"


def is_binary(content: Column) -> Column:
    """A zero byte among the first 8000, unless a UTF-16 mark leads (that of UTF-32 little endian is no excuse)."""
    head = F.hex(F.substring(content, 1, PROBE_BYTES))
    zero = F.regexp_instr(head, F.lit("^(?:..)*?00")) > 0
    utf16 = (head.startswith("FFFE") & ~head.startswith("FFFE0000")) | head.startswith("FEFF")
    return zero & ~utf16


def decoded(content: Column) -> Column:
    """The text of a file: UTF-16 by its mark, else UTF-8."""
    head = F.hex(F.substring(content, 1, 2))
    return F.when(head.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).otherwise(F.decode(content, "UTF-8"))


def _empty_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of the files without content, which Spark's file sources pass over."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    listing = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(top, True)
    found = []
    while listing.hasNext():
        status = listing.next()
        if status.getLen() == 0:
            found.append((status.getPath().toUri().toString(), 0, b""))
    return spark.createDataFrame(found, "path string, length bigint, content binary")


def scan(spark: SparkSession, folder: str, rules: Sequence[globs.Rule] = (), include_binary: bool = False) -> DataFrame:
    """A node per file and per directory that holds one: node_path from the folder's name down, size, lines, extension.

    Rules see the path below the folder and prune with the directories they exclude. Files that vanish or can't be read
    meanwhile are skipped. Lines are NULL for binary files and for files with a line over 64 KiB.
    """
    root = os.path.abspath(folder)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    plain = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    every = reader.load(root).select("path", "length", "content").unionByName(_empty_files(spark, root))
    found = every.withColumn("relative", F.substring(plain, len(root) + 2, 1_000_000))
    kept = found.where(globs.kept(F.col("relative"), rules))
    text = decoded(F.col("content"))
    longest = F.aggregate(F.split(text, "\n"), F.lit(0), lambda a, x: F.greatest(a, F.length(x)))
    binary = is_binary(F.col("content"))
    lines = F.when(~F.col("is_binary") & (longest <= 65_535), tree.line_count(text))
    files = kept.withColumn("is_binary", binary).withColumn("file_lines", lines)
    if not include_binary:
        files = files.where(~F.col("is_binary"))
    top = os.path.basename(root)
    path = F.concat(F.lit(top + "/"), "relative")
    name = F.element_at(F.split("relative", "/"), -1)
    rows = files.select(path.alias("node_path"), tree.parent_of(path).alias("parent_path"), name.alias("node_name"), F.lit("file").alias("node_kind"), tree.file_extension(name).alias("extension"), "is_binary", F.col("length").alias("file_size"), "file_lines")
    folders = rows.select(F.explode(tree.prefixes(F.col("parent_path"))).alias("node_path")).distinct()
    dirs = folders.select("node_path", tree.parent_of(F.col("node_path")).alias("parent_path"), F.element_at(F.split("node_path", "/"), -1).alias("node_name"), F.lit("dir").alias("node_kind"))
    return rows.unionByName(dirs, allowMissingColumns=True).withColumn("tree_depth", F.size(F.split("node_path", "/")) - 1)


def read_mailmap(lines: DataFrame, text: str = "value") -> DataFrame:
    """(old_email, proper_email, proper_name) of mailmap lines: name and one or two addresses in <>; # starts a comment.

    Keyed by the old address, else the proper one, in lower case; of several lines for one key the greatest name stays.
    """
    line = F.trim(F.regexp_replace(F.trim(F.col(text)), r"\s#.*$|^#.*$", ""))
    parts = lines.select(line.alias("l")).select("l", F.regexp_extract_all("l", F.lit(r"<([^>]*)>"), F.lit(1)).alias("mails"))
    first, second = F.trim(F.get("mails", F.lit(0))), F.trim(F.get("mails", F.lit(1)))
    name = F.trim(F.regexp_extract("l", r"^([^<]*)<", 1))
    rows = parts.where(F.size("mails") > 0).select(F.lower(F.coalesce(second, first)).alias("old_email"), first.alias("proper_email"), name.alias("proper_name")).where("proper_email <> ''")
    return rows.groupBy("old_email").agg(F.max(F.struct("proper_name", "proper_email")).alias("m")).select("old_email", "m.proper_email", "m.proper_name")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Touch facts of exported logs (git log --numstat with LOG_FORMAT, one or many files): a row per commit and path.

    Binary changes have NULL lines. Creations can't be told from a numstat and are NULL.
    """
    blocks = spark.read.option("lineSep", "\x01").text(path).where("trim(value) <> ''")
    lines = F.split("value", "\n")
    head = F.split(F.get("l", F.lit(0)), "\t")
    commits = blocks.select(lines.alias("l")).select(head.alias("h"), F.explode(F.slice("l", F.lit(2), F.size("l"))).alias("change"))
    stat = F.split("change", "\t", 3)
    rows = commits.where(F.col("change").rlike(r"^(\d+|-)\t(\d+|-)\t.")).select("h", stat.alias("s"))
    parents = F.filter(F.split(F.get("h", F.lit(1)), " "), lambda p: p != "")
    return rows.select(
        F.get("h", F.lit(0)).alias("commit_hash"),
        F.get("h", F.lit(2)).alias("author_name"),
        F.get("h", F.lit(3)).alias("author_email"),
        F.timestamp_seconds(F.get("h", F.lit(4)).try_cast("bigint")).alias("touched_at"),
        F.size(parents).alias("n_parents"),
        F.lit(0).alias("parent_idx"),
        F.lit(None).cast("boolean").alias("is_creation"),
        F.get("s", F.lit(2)).alias("file_path"),
        F.get("s", F.lit(0)).try_cast("bigint").alias("added"),
        F.get("s", F.lit(1)).try_cast("bigint").alias("removed"),
    )


@dataclass(frozen=True)
class Config:
    """Settings of a run. Unset values keep the defaults; filters are tried before those of the call."""

    filters: tuple[str, ...] = ("!.*",)
    classes: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    width: int = 1920
    height: int = 1080
    top_k: int = 11
    activity_days: int = 180
    recent_days: int = 180
    early_fraction: float = 0.25

    def rules(self, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[globs.Rule]:
        own = [globs.parse_rule(f) for f in self.filters]
        return globs.merge_rules(own, [globs.parse_rule(p) for p in include], [globs.parse_rule("!" + p) for p in exclude])

    def overridden(self, **values) -> "Config":
        """With the given values where they aren't empty or zero."""
        return replace(self, **{k: v for k, v in values.items() if v})


def load_config(path: str | None = None, output: str | None = None) -> Config:
    """The settings of a JSON (or, if PyYAML is there, YAML) file over the defaults; without a path <output>-config.* is looked for."""
    if path is None and output is not None:
        stem = os.path.splitext(output)[0]
        path = next((p for e in (".json", ".yaml", ".yml") if os.path.exists(p := f"{stem}-config{e}")), None)
    if path is None:
        return Config()
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            raw = json.load(f)
        else:
            import yaml  # optional

            raw = yaml.safe_load(f)
    known = {k: tuple(v) if k == "filters" else v for k, v in (raw or {}).items() if k in Config.__dataclass_fields__}
    if "imageSize" in (raw or {}):
        w, _, h = str(raw["imageSize"]).partition("x")
        known |= {"width": int(w), "height": int(h or w)}
    return Config(**known)


def save_config(config: Config, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({k: list(v) if isinstance(v, tuple) else v for k, v in config.__dict__.items()}, f, indent=2)
        f.write("\n")
