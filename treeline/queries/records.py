"""Queries of the general record operators: wide tables, skewed counts, sessions, nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import values as V
from treeline.operators import nested, sessions, skew, wide
from treeline.session import materialise, table

SESSION_GAP_US = 30 * 60 * 1_000_000


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    wide_rows, kinds = wide.wide_table(wide.metric_cells(table(spark, d, "metric_values")), "node_path")
    return wide.melt_cells(wide_rows, "node_path", kinds)


def commit_facts(commits: DataFrame) -> DataFrame:
    """(key_kind, key_value, commits, partners): keys of commits with one of their commits, one of their partners, or both.

    All facts of a commit come out of one pass over its row: a path with the commit and its author, the author with each
    path, the first time with the commit too. An author without paths has one row. Hexadecimal hashes are kept as bytes.
    """
    paths = F.array_distinct(F.filter(F.transform(F.coalesce("changed_paths", F.array().cast("array<string>")), V.repo_path), lambda p: p.isNotNull()))
    packed = F.when(F.col("commit_hash").rlike("^(?:[0-9a-f]{2})+$"), F.unhex("commit_hash")).otherwise(F.encode(F.concat(F.lit("="), "commit_hash"), "UTF-8"))
    rows = commits.select(packed.alias("commit"), V.email_key(F.col("author_email")).alias("author"), paths.alias("paths"))

    def fact(kind: str, key: Column, commit: Column, partner: Column) -> Column:
        return F.struct(F.lit(kind).alias("key_kind"), key.alias("key_value"), commit.alias("commits"), partner.alias("partners"))

    author, commit, none = F.col("author"), F.col("commit"), F.lit(None)
    partners = F.when(F.size("paths") > 0, F.col("paths")).otherwise(F.array(none.cast("string")))
    facts = F.concat(
        F.transform(partners, lambda p, i: fact("author", author, F.when(i == 0, commit), p)),
        F.transform("paths", lambda p: fact("path", p, commit, author)),
    )
    return rows.select(F.explode(facts).alias("f")).select("f.*").where("key_value IS NOT NULL")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.distinct_counts(commit_facts(table(spark, d, "commits")), ["key_kind", "key_value"], ["commits", "partners"])


def commit_events(commits: DataFrame) -> DataFrame:
    """(author_email, at_us): one row per commit_hash with author and date; re-ingested rows are one commit."""
    rows = commits.select("commit_hash", V.email_key(F.col("author_email")).alias("author_email"), F.unix_micros(F.col("author_date").cast("timestamp")).alias("at_us"))
    once = rows.where("commit_hash IS NOT NULL").groupBy("commit_hash").agg(F.max("author_email").alias("author_email"), F.min("at_us").alias("at_us"))
    return once.where("author_email IS NOT NULL AND at_us IS NOT NULL").select("author_email", "at_us")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    tree = sessions.session_tree(commit_events(table(spark, d, "commits")), "author_email", "at_us")
    found = sessions.sessions(tree, SESSION_GAP_US)
    return found.select(F.col("entity").alias("author_email"), F.col("started").alias("started_us"), F.col("ended").alias("ended_us"), F.col("n").alias("n_commits")).distinct()


SESSION_GAPS_US = tuple(m * 60 * 1_000_000 for m in (5, 30, 240))


def p4_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The sessions at three settings, all cut from one tree."""
    tree = materialise(sessions.session_tree(commit_events(table(spark, d, "commits")), "author_email", "at_us"))
    each = [sessions.sessions(tree, gap).select(F.lit(gap).cast("bigint").alias("gap_us"), F.col("entity").alias("author_email"), F.col("started").alias("started_us"), F.col("ended").alias("ended_us"), F.col("n").alias("n_commits")) for gap in SESSION_GAPS_US]
    return each[0].unionByName(each[1]).unionByName(each[2])


def _export_rows(spark: SparkSession, d: str, *elements: str) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    docs = materialise(nested.latest_readable(table(spark, d, "export_payloads"), "export_id", "payload", "exported_at", nested.EXPORT_SHAPE))
    return nested.shred(docs, "export_id", "payload", nested.EXPORT_SHAPE, elements)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = _export_rows(spark, d, "directories", "files")
    kind = F.when(F.col("element") == "directories", "dir").otherwise("file")
    return rows.select(F.col("doc").cast("bigint").alias("export_id"), F.col("label_path").alias("node_path"), "parent_path", kind.alias("node_kind")).distinct()


def p5_tables(spark: SparkSession, d: str) -> DataFrame:
    """Directories and files, each with the path of the directory that its foreign key points to."""
    rows, columns = _export_rows(spark, d, "directories", "files")
    rows = materialise(rows)

    def one(element: str) -> DataFrame:
        return nested.table_of(rows, {element: columns.get(element, {})}, element).withColumn("element", F.lit(element))

    parents = one("directories").select("doc", F.col("row_no").alias("parent_no"), F.col("label_path").alias("above"))
    names = ("doc", "element", "label_path", "parent_no", "ordinal", "depth")
    both = one("directories").select(*names).unionByName(one("files").select(*names)).join(parents, ["doc", "parent_no"], "left")
    return both.select(F.col("doc").cast("bigint").alias("export_id"), "element", F.col("label_path").alias("node_path"), F.coalesce("above", F.lit("")).alias("parent_path"), "ordinal", F.col("depth").cast("bigint").alias("depth"))


def p5_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The three metric tables in one: each value, typed, with the path of the node that its foreign key points to."""
    kinds = {"quantities": "quantity", "measures": "measure", "classifications": "classification"}
    rows, columns = _export_rows(spark, d, "directories", "files", *kinds)
    rows = materialise(rows)
    owners = rows.where("element IN ('directories', 'files')").select("doc", F.col("row_no").alias("parent_no"), F.col("label_path").alias("node_path"))
    types = {"quantities": "bigint", "measures": "double", "classifications": "string"}

    def one(element: str) -> DataFrame:
        values = nested.table_of(rows, columns | {element: {"key": "string", "value": types[element]}}, element).where("value IS NOT NULL")
        typed = [(F.col("value") if e == element else F.lit(None).cast(types[e])).alias(k) for e, k in kinds.items()]
        return values.select("doc", "parent_no", F.lit(kinds[element]).alias("metric_kind"), F.col("key").alias("metric"), *typed)

    out = one("quantities").unionByName(one("measures")).unionByName(one("classifications"))
    return out.join(owners, ["doc", "parent_no"]).select(F.col("doc").cast("bigint").alias("export_id"), "node_path", "metric_kind", "metric", *kinds.values())


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p4_found": p4_found, "p4_thresholds": p4_thresholds, "p5_found": p5_found, "p5_tables": p5_tables, "p5_metrics": p5_metrics}

_MISSING = "('', 'n/a', 'na', '#n/a', 'null', 'none', 'nil', 'nan', '-', '--', '?', 'unknown', 'undefined')"


def _names(kind: str) -> str:
    from treeline.plans.registry import names_by_kind

    return "(" + ", ".join(f"'{n}'" for n in names_by_kind()[kind]) + ")"


_JSON_NAME = "coalesce(nullif(json_extract_string({n}, '$.name'), ''), regexp_extract(rtrim(json_extract_string({n}, '$.path'), '/'), '([^/]*)$', 1), '')"
_JSON_LIST = "CASE json_type(node, '$.{k}') WHEN 'ARRAY' THEN CAST(json_extract(node, '$.{k}') AS JSON[]) WHEN 'OBJECT' THEN [json_extract(node, '$.{k}')] ELSE [] END"

_DOCS = """
            SELECT export_id, json_extract(payload, '$.root') AS root FROM export_payloads
            WHERE json_valid(payload) AND CASE WHEN json_valid(payload) THEN json_type(payload, '$.root') END = 'OBJECT'
            QUALIFY row_number() OVER (PARTITION BY export_id ORDER BY exported_at DESC NULLS LAST, payload DESC) = 1"""

ORACLES = {
    "p1_found": f"""
        WITH named AS (
            SELECT node_path, entry_id, loaded_at,
                   regexp_replace(lower(regexp_replace(regexp_replace(metric, '^\\s+|\\s+$', '', 'g'), '([a-z0-9])([A-Z])', '\\1-\\2', 'g')), '[\\s_-]+', '-', 'g') AS metric,
                   regexp_replace(raw_value, '^\\s+|\\s+$', '', 'g') AS v
            FROM metric_values WHERE node_path IS NOT NULL),
        typed AS (
            SELECT *,
                   CASE WHEN lower(v) IN {_MISSING} THEN NULL
                        WHEN metric IN {_names("quantity")} THEN
                            CASE WHEN regexp_full_match(v, '[+-]?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)(\\.[0-9]*)?([eE][+-]?[0-9]{{1,3}})?')
                                  AND TRY_CAST(replace(v, ',', '') AS DOUBLE) = floor(TRY_CAST(replace(v, ',', '') AS DOUBLE))
                                 THEN CAST(CAST(TRY_CAST(replace(v, ',', '') AS DOUBLE) AS BIGINT) AS VARCHAR) END
                        WHEN metric IN {_names("measure")} THEN
                            CASE WHEN regexp_full_match(v, '[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]{{1,3}})?')
                                 THEN printf('%.3f', CAST(replace(v, ',', '.') AS DOUBLE)) END
                        ELSE v END AS cell_value
            FROM named)
        SELECT node_path, metric, cell_value FROM typed WHERE cell_value IS NOT NULL AND metric <> ''
        QUALIFY row_number() OVER (PARTITION BY node_path, metric ORDER BY loaded_at DESC, entry_id DESC) = 1""",
    "p3_found": """
        WITH c AS (SELECT commit_hash, nullif(lower(regexp_replace(author_email, '^\\s+|\\s+$', '', 'g')), '') AS author, changed_paths FROM commits),
        t AS (SELECT commit_hash, author, nullif(regexp_replace(replace(p, chr(92), '/'), '^(\\./+)+', ''), '') AS path
              FROM (SELECT commit_hash, author, unnest(changed_paths) AS p FROM c)),
        a AS (SELECT author, count(DISTINCT commit_hash) AS n FROM c WHERE author IS NOT NULL GROUP BY 1),
        ap AS (SELECT author, count(DISTINCT path) AS n FROM t GROUP BY 1)
        SELECT 'author' AS key_kind, a.author AS key_value, a.n AS n_commits, coalesce(ap.n, 0) AS n_partners FROM a LEFT JOIN ap USING (author)
        UNION ALL
        SELECT 'path', path, count(DISTINCT commit_hash), count(DISTINCT author) FROM t WHERE path IS NOT NULL GROUP BY path""",
    "p4_found": """
        WITH c AS (SELECT commit_hash, max(nullif(lower(regexp_replace(author_email, '^\\s+|\\s+$', '', 'g')), '')) AS author_email, min(epoch_us(author_date)) AS t
                   FROM commits WHERE commit_hash IS NOT NULL GROUP BY 1),
        g AS (SELECT author_email, t, t - lag(t) OVER (PARTITION BY author_email ORDER BY t) AS gap FROM c WHERE author_email IS NOT NULL AND t IS NOT NULL),
        s AS (SELECT author_email, t, sum(CASE WHEN gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY author_email ORDER BY t) AS s FROM g)
        SELECT author_email, min(t) AS started_us, max(t) AS ended_us, count(*) AS n_commits FROM s GROUP BY author_email, s""",
    "p5_found": f"""
        WITH RECURSIVE docs AS (
            SELECT export_id, json_extract(payload, '$.root') AS root FROM export_payloads
            WHERE json_valid(payload) AND CASE WHEN json_valid(payload) THEN json_type(payload, '$.root') END = 'OBJECT'
            QUALIFY row_number() OVER (PARTITION BY export_id ORDER BY exported_at DESC NULLS LAST, payload DESC) = 1),
        t(export_id, node, node_path, parent_path, node_kind) AS (
            SELECT export_id, root, {_JSON_NAME.format(n="root")}, '', 'dir' FROM docs
            UNION ALL
            SELECT export_id, c.node, node_path || '/' || {_JSON_NAME.format(n="c.node")}, node_path, c.kind FROM (
                SELECT export_id, node_path, unnest(list_concat(
                    list_transform({_JSON_LIST.format(k="directories")}, lambda d: {{'node': d, 'kind': 'dir'}}),
                    list_transform({_JSON_LIST.format(k="files")}, lambda d: {{'node': d, 'kind': 'file'}}))) AS c FROM t)
            WHERE json_type(c.node) = 'OBJECT')
        SELECT DISTINCT export_id, node_path, parent_path, node_kind FROM t""",
    "p4_thresholds": """
        WITH c AS (SELECT commit_hash, max(nullif(lower(regexp_replace(author_email, '^\\s+|\\s+$', '', 'g')), '')) AS author_email, min(epoch_us(author_date)) AS t
                   FROM commits WHERE commit_hash IS NOT NULL GROUP BY 1),
        g AS (SELECT gap_us, author_email, t, t - lag(t) OVER (PARTITION BY gap_us, author_email ORDER BY t) AS gap
              FROM c, (SELECT unnest([300000000, 1800000000, 14400000000]) AS gap_us) WHERE author_email IS NOT NULL AND t IS NOT NULL),
        s AS (SELECT gap_us, author_email, t, sum(CASE WHEN gap > gap_us THEN 1 ELSE 0 END) OVER (PARTITION BY gap_us, author_email ORDER BY t) AS s FROM g)
        SELECT gap_us, author_email, min(t) AS started_us, max(t) AS ended_us, count(*) AS n_commits FROM s GROUP BY gap_us, author_email, s""",
    "p5_tables": f"""
        WITH RECURSIVE docs AS ({_DOCS}),
        t(export_id, element, node, node_path, parent_path, ordinal, depth) AS (
            SELECT export_id, 'directories', root, {_JSON_NAME.format(n="root")}, '', 0, 0 FROM docs
            UNION ALL
            SELECT export_id, c.element, c.node, node_path || '/' || {_JSON_NAME.format(n="c.node")}, node_path, c.ordinal, depth + 1 FROM (
                SELECT export_id, node_path, depth, unnest(list_concat(
                    list_transform({_JSON_LIST.format(k="directories")}, lambda d, i: {{'node': d, 'element': 'directories', 'ordinal': i - 1}}),
                    list_transform({_JSON_LIST.format(k="files")}, lambda d, i: {{'node': d, 'element': 'files', 'ordinal': i - 1}}))) AS c FROM t)
            WHERE json_type(c.node) = 'OBJECT')
        SELECT export_id, element, node_path, parent_path, ordinal, depth FROM t""",
    "p5_metrics": f"""
        WITH RECURSIVE docs AS ({_DOCS}),
        t(export_id, node, node_path) AS (
            SELECT export_id, root, {_JSON_NAME.format(n="root")} FROM docs
            UNION ALL
            SELECT export_id, c, node_path || '/' || {_JSON_NAME.format(n="c")} FROM (
                SELECT export_id, node_path, unnest(list_concat({_JSON_LIST.format(k="directories")}, {_JSON_LIST.format(k="files")})) AS c FROM t)
            WHERE json_type(c) = 'OBJECT'),
        m AS (SELECT export_id, node_path, k.kind AS metric_kind, json_extract(node, '$.' || k.member) AS values FROM t,
                     (SELECT unnest([{{'kind': 'quantity', 'member': 'quantities'}}, {{'kind': 'measure', 'member': 'measures'}}, {{'kind': 'classification', 'member': 'classifications'}}]) AS k)
              WHERE json_type(node, '$.' || k.member) = 'OBJECT'),
        v AS (SELECT export_id, node_path, metric_kind, unnest(json_keys(values)) AS metric, values FROM m),
        x AS (SELECT export_id, node_path, metric_kind, metric, json_extract_string(values, '$."' || metric || '"') AS text FROM v),
        y AS (SELECT export_id, node_path, metric_kind, metric,
               CASE WHEN metric_kind = 'quantity' AND regexp_full_match(text, '-?[0-9]+') THEN TRY_CAST(text AS BIGINT) END AS quantity,
               CASE WHEN metric_kind = 'measure' THEN TRY_CAST(text AS DOUBLE) END AS measure,
               CASE WHEN metric_kind = 'classification' THEN text END AS classification FROM x)
        SELECT * FROM y WHERE quantity IS NOT NULL OR measure IS NOT NULL OR classification IS NOT NULL""",
}
