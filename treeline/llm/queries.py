"""Queries of the text operators. Their results are lists of cases or of places, which SQL can't compute: no oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeline.llm import identities, leaks, packing, reading, sourcefiles
from treeline.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    judged = sourcefiles.judged_files(table(spark, d, "nodes"), table(spark, d, "file_contents"))
    return judged.where("reason IS NOT NULL").select("node_id").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return identities.same_pairs(identities.entities(table(spark, d, "signatures")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_bands(table(spark, d, "documents"), table(spark, d, "reading_labels")).distinct()


QUERIES = {"p2_found": p2_found, "p6_found": p6_found, "p7_containers": p7_containers, "p8_found": p8_found, "p9_found": p9_found}
ORACLES: dict[str, str] = {}
