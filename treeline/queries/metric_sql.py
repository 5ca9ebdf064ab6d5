"""The metric queries in DuckDB's SQL."""

from __future__ import annotations



from treeline.operators import bucketing, scatter
from treeline.plans.expr import valid_expressions
from treeline.plans.registry import base_registry

AS_OF, HEAD = "2025-10-01 00:00:00", "2025-09-01 00:00:00"
RECENT_US = f"(epoch_us(TIMESTAMP '{HEAD}') - 30 * 86400000000)"
ACTIVE_US = f"(epoch_us(TIMESTAMP '{HEAD}') - 45 * 86400000000)"
PLOT = scatter.plot_area(1200.0, 900.0)

N = "n AS (SELECT DISTINCT node_id, repo_slug, node_path, parent_path, node_name, node_kind, tree_depth, extension, is_binary FROM nodes)"
LINES = "length(content) - length(replace(content, chr(10), '')) + CASE WHEN content <> '' AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END"
KIND = "CASE WHEN contains(node_name, '.') AND NOT ends_with(node_name, '.') THEN regexp_extract(node_name, '\\.([^.]*)$', 1) ELSE 'no-extension' END"
FILES = f"""{N}, f AS (SELECT n.*, n.parent_path AS dir, strlen(content) AS file_size,
    CASE WHEN NOT coalesce(is_binary, false) THEN {LINES} END AS file_lines, {KIND} AS file_type
    FROM n LEFT JOIN file_contents USING (node_id) WHERE node_kind = 'file')"""
T = "t AS (SELECT DISTINCT * FROM touches)"
# what a commit changed against all its parents, with the lines against the first
CH = f"""{T}, ch AS (SELECT repo_slug, commit_hash, file_path, max(author_email) AS author_email, max(touched_at) AS touched_at, bool_or(is_creation) AS is_creation,
    max(added) FILTER (WHERE parent_idx = 0) AS added, max(removed) FILTER (WHERE parent_idx = 0) AS removed
    FROM t GROUP BY 1, 2, 3 HAVING count(DISTINCT parent_idx) >= greatest(coalesce(max(n_parents), 1), 1))"""


def up(path: str) -> str:
    return f"unnest(list_transform(range(1, len(string_split({path}, '/')) + 1), lambda i: array_to_string(string_split({path}, '/')[1:i], '/')))"


def below_root(path: str) -> str:
    return f"regexp_replace({path}, '^[^/]+/', '')"


def geo(select: str) -> str:
    return f"""WITH g AS (SELECT 'root/' || r_name || '/' || n_name || '/' || c_custkey AS dir, o_orderkey, o_totalprice, o_orderpriority
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        gu AS (SELECT {up("dir")} AS node_path, * FROM g),
        li AS (SELECT gu.node_path, lower(l_returnflag) AS flag, CAST(l_quantity AS BIGINT) AS q FROM lineitem JOIN gu ON l_orderkey = o_orderkey)
        {select}"""


def file_rollup(columns: str, having: str) -> str:
    return f"WITH {FILES}, u AS (SELECT {up('dir')} AS node_path, * FROM f) SELECT node_path, {columns} FROM u GROUP BY node_path HAVING {having}"


def texts(column: str) -> str:
    return f"WITH {FILES}, u AS (SELECT {up('dir')} AS node_path, * FROM f), c AS (SELECT node_path, {column} AS v, count(*) AS n FROM u WHERE {column} IS NOT NULL GROUP BY 1, 2) "


def last_name(p: str) -> str:
    return f"string_split({p}, '/')[-1]"


def rules_sql(p: str) -> str:
    """The rules of the queries said in plain string functions; the first that fits decides."""
    return f"""CASE WHEN {last_name(p)} = 'vendor' THEN false WHEN ends_with({p}, '_test.go') THEN false WHEN ends_with({p}, '.go') THEN true WHEN ends_with({p}, '.py') THEN false
        WHEN list_contains(string_split({p}, '/')[:-2], 'src') THEN false WHEN {last_name(p)} = 'docs' THEN true
        WHEN {last_name(p)} = 'lib' AND list_contains(string_split({p}, '/')[:-2], 'docs') THEN false ELSE true END"""


CLASS_SQL = f"""CASE WHEN contains({last_name("p")}, '_test.') OR list_contains(string_split(p, '/')[:-2], 'tests') THEN 'tests'
    WHEN list_contains(string_split(p, '/')[:-2], 'docs') OR ends_with(p, '.md') THEN 'docs' WHEN ends_with(p, '.go') THEN 'go'
    WHEN ends_with(p, '.js') OR ends_with(p, '.ts') OR ends_with(p, '.css') THEN 'web' ELSE 'rest' END"""

CONTRIB = f"""{CH}, c AS (SELECT repo_slug || '/' || file_path AS node, author_email AS email, epoch_us(touched_at) AS at_us, coalesce(added, 0) + coalesce(removed, 0) AS w
    FROM ch WHERE author_email IS NOT NULL AND touched_at IS NOT NULL)"""
DIR_CONTRIB = CONTRIB.replace("c AS (", "c0 AS (") + f", c AS (SELECT {up('regexp_extract(node, chr(94) || chr(40) || chr(46) || chr(42) || chr(41) || chr(47), 1)')} AS node, email, at_us, w FROM c0)"
RECORDS = f"""span AS (SELECT node, min(at_us) AS lo, max(at_us) AS hi FROM c GROUP BY 1),
    cut AS (SELECT node, lo + CAST(trunc((hi - lo) * 0.25) AS BIGINT) AS cutoff FROM span),
    rec AS (SELECT node, email, sum(w) AS weight, min(at_us) AS first, sum(w) FILTER (WHERE at_us <= cutoff) AS ew, min(at_us) FILTER (WHERE at_us <= cutoff) AS ef,
        sum(w) FILTER (WHERE at_us >= {RECENT_US}) AS rw, min(at_us) FILTER (WHERE at_us >= {RECENT_US}) AS rf,
        bool_or(at_us <= cutoff AND w <> 0) AS was_early, bool_or(cutoff > {RECENT_US}) AS overlap FROM c JOIN cut USING (node) GROUP BY 1, 2)"""
LAST = "la AS (SELECT author_email AS email, epoch_us(max(touched_at)) AS last_us FROM t WHERE author_email IS NOT NULL GROUP BY 1)"
RANKED = """k AS (SELECT *, sum(weight) OVER (PARTITION BY node) AS total, count(*) OVER (PARTITION BY node) AS authors,
        row_number() OVER (PARTITION BY node ORDER BY weight DESC, first, email) AS rank,
        row_number() OVER (PARTITION BY node ORDER BY ew DESC NULLS LAST, ef, email) AS erank,
        row_number() OVER (PARTITION BY node ORDER BY rw DESC NULLS LAST, rf, email) AS rrank FROM rec LEFT JOIN la USING (email)),
    s AS (SELECT *, CASE WHEN total > 0 THEN weight / total END AS share FROM k),
    z AS (SELECT *, sum(share) OVER (PARTITION BY node ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM s)"""
NINE = f"""m AS (SELECT node,
    CASE WHEN sum(weight) > 0 THEN max(email) FILTER (WHERE rank = 1) ELSE '«unmaintained»' END AS code_owner,
    CASE WHEN coalesce(sum(ew), 0) > 0 THEN max(email) FILTER (WHERE erank = 1) ELSE '«unmaintained»' END AS initial_developer,
    CASE WHEN coalesce(sum(rw), 0) > 0 THEN max(email) FILTER (WHERE rrank = 1) ELSE '«unmaintained»' END AS current_maintainer,
    count(*) FILTER (WHERE share >= 0.10) AS significant_contributor_count,
    CASE WHEN sum(weight) > 0 THEN coalesce(min(rank) FILTER (WHERE upto >= 0.5), max(rank)) ELSE 0 END AS bus_factor,
    round(coalesce(max(share), 0), 6) AS ownership_dominance,
    round(CASE WHEN sum(weight) > 0 AND count(*) > 1 THEN coalesce(-sum(CASE WHEN share > 0 THEN share * ln(share) END), 0) / ln(count(*)) ELSE 0 END, 6) AS contributor_entropy,
    round(CASE WHEN sum(weight) > 0 THEN coalesce(sum(weight) FILTER (WHERE coalesce(last_us < {ACTIVE_US}, true)), 0) / sum(weight) ELSE 0 END, 6) AS orphan_risk,
    round(CASE WHEN bool_or(overlap) OR coalesce(sum(rw), 0) = 0 THEN 0 ELSE coalesce(sum(rw) FILTER (WHERE NOT was_early), 0) / sum(rw) END, 6) AS knowledge_handoff
    FROM z GROUP BY node)"""
AUTHORS = f"WITH {CONTRIB}, {RECORDS}, {LAST}, {RANKED}, {NINE} "
TOP = "SELECT email, sum(w) AS weight, min(at_us) AS first FROM c GROUP BY 1 ORDER BY weight DESC, first, email LIMIT 11"


def grid(source: str, at: str, unit: str) -> str:
    step = f"INTERVAL 1 {unit}"
    return f"""ends AS (SELECT min({at}) AS lo, max({at}) AS hi FROM {source}),
        grid AS (SELECT row_number() OVER (ORDER BY started) - 1 AS bucket, started FROM
            (SELECT unnest(generate_series(date_trunc('{unit}', lo), date_trunc('{unit}', hi - INTERVAL 1 MICROSECOND), {step})) AS started FROM ends WHERE lo < hi))"""


def bounds(steps: int) -> str:
    """v: a table of one column; bb: the boundaries as a list."""
    power = "pow(10.0, 2.0 - ceil(log10(abs(x))))"
    return f"""o AS (SELECT CAST(v AS DOUBLE) AS x, row_number() OVER (ORDER BY v) - 1 AS i FROM v WHERE v IS NOT NULL),
        e AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi FROM o),
        raw AS (SELECT DISTINCT CASE WHEN x = 0 THEN 0 ELSE round(x * {power}) / {power} END AS b FROM o, e,
            (SELECT unnest(range(1, {steps})) AS s) WHERE i = s * n // {steps} AND lo < hi),
        bb AS (SELECT coalesce(list(b ORDER BY b) FILTER (WHERE b > lo), []) AS bs, any_value(lo) AS lo, any_value(hi) AS hi, any_value(n) AS n FROM e LEFT JOIN raw ON true)"""


def palette(name: str) -> str:
    return "[" + ", ".join(f"'{c}'" for c in bucketing.colours(name)) + "]"


def _colour(name: str) -> str:
    k = len(bucketing.colours(name))
    return f"{palette(name)}[CASE WHEN len(bs) = 0 THEN {k // 2} ELSE bucket * {k - 1} // len(bs) END + 1]"


BUCKET = "len(list_filter(bs, lambda b: v >= b)) AS bucket"
SCATTER = f"""{FILES}, {CH}, h AS (SELECT repo_slug || '/' || file_path AS node_path, count(*) AS size FROM ch WHERE touched_at IS NOT NULL GROUP BY 1),
    r AS (SELECT node_id, node_name, file_size AS x, file_lines AS y, size, file_type AS category FROM f LEFT JOIN h USING (node_path)),
    dd AS (SELECT * FROM r WHERE x IS NOT NULL AND y IS NOT NULL AND size IS NOT NULL),
    e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(size) AS ls, max(size) AS hs, count(*) AS n FROM dd)"""
LARGEST = f"greatest(12.0, greatest(4.0, least({PLOT.w} / greatest(8.0, sqrt(n)), {PLOT.h} / greatest(8.0, sqrt(n))) * 0.45))"
RADIUS = f"round(CASE WHEN {LARGEST} <= 12 OR ls = hs THEN {LARGEST} ELSE 12 + ({LARGEST} - 12) * (size - ls) / (hs - ls) END, 6)"


def _spiral() -> str:
    """The spots per lap of seven that leave the evenest gaps at the middle radius, 28 winning ties, on a spiral from a third of the radius outwards."""
    outer = 900 / 2 - 40
    return f"""WITH {grid("events", "ts", "DAY")}, k AS (SELECT count(*) AS n FROM grid),
        laps AS (SELECT lap, n, {outer} / 3.0 AS inside, (n - 1) * 2 * pi() / lap AS turn FROM k, (SELECT unnest([14, 28, 42, 56, 84, 112, 168]) AS lap)),
        u AS (SELECT *, {outer} * 2 / 3.0 / turn AS growth FROM laps),
        best AS (SELECT lap, inside, growth FROM u ORDER BY abs(2 * pi() * growth - (inside + growth * turn / 2) * 2 * pi() / lap), lap <> 28, lap LIMIT 1),
        p AS (SELECT bucket, bucket * 2 * pi() / lap AS theta, inside + growth * bucket * 2 * pi() / lap AS r FROM grid, best)
        SELECT bucket, round(theta, 6) AS theta, round(r, 6) AS r, round(600 + r * sin(theta), 6) AS x, round(450 - r * cos(theta), 6) AS y FROM p"""


def _palettes() -> str:
    rows = ", ".join(f"('{p}', {i}, '{c}')" for p in sorted(bucketing.PALETTES) for i, c in enumerate(bucketing.colours(p)))

    def channel(at: int) -> str:
        return f"(CAST('0x' || substr(colour, {at}, 2) AS INTEGER) / 255.0)"

    def lin(at: int) -> str:
        c = channel(at)
        return f"(CASE WHEN {c} <= 0.03928 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END)"

    lum = f"(0.2126 * {lin(2)} + 0.7152 * {lin(4)} + 0.0722 * {lin(6)})"
    dark = " || ".join(f"lpad(format('{{:x}}', CAST(floor(CAST('0x' || substr(colour, {at}, 2) AS INTEGER) * (1 - 0.4)) AS BIGINT)), 2, '0')" for at in (2, 4, 6))
    return f"""WITH p(palette, place, colour) AS (VALUES {rows}) SELECT palette, place, colour, round({lum}, 6) AS luminance,
        round(1.05 / ({lum} + 0.05), 6) AS contrast, CASE WHEN {lum} > 0.5 THEN '#000000' ELSE '#ffffff' END AS text, '#' || {dark} AS border FROM p"""


def _catalogue() -> tuple[str, str]:
    reg = base_registry()
    metrics = ", ".join(f"('{m.name}', '{m.kind}', '{m.level}', '{','.join(m.filters)}', '{','.join(m.aggregations)}', '{m.palette}')" for m in reg.all())
    exprs = ", ".join(f"('{e}', '{e.base}', '{e.filter}', '{e.aggregation}')" for e in valid_expressions(reg))
    return (
        f"SELECT * FROM (VALUES {metrics}) AS x(name, kind, level, filters, aggregations, palette)",
        f'SELECT * FROM (VALUES {exprs}) AS x(expression, base, "filter", aggregation)',
    )


def _fused() -> str:
    def verbs(table: str, column: str, name: str) -> list[str]:
        ask = [("sum", "quantity", "sum({c})::BIGINT::VARCHAR"), ("min", "quantity", "min({c})::VARCHAR"), ("max", "quantity", "max({c})::VARCHAR"), ("mean", "measure", "printf('%.6f', avg({c}))")]
        return [f"SELECT node_path, '{name}.{v}' AS metric, '{k}' AS kind, {x.format(c=column)} AS value FROM {table} GROUP BY 1 HAVING count({column}) > 0" for v, k, x in ask]

    parts = verbs("u", "file_size", "file-size") + verbs("u", "file_lines", "file-lines") + verbs("w", "added", "lines-added") + verbs("w", "removed", "lines-removed") + verbs("w", "added + removed", "lines-changed")
    mode = "SELECT node_path, 'file-type.mode', 'classification', v FROM c QUALIFY row_number() OVER (PARTITION BY node_path ORDER BY n DESC, v) = 1"
    distinct = "SELECT node_path, 'file-type.distinct', 'quantity', count(*)::VARCHAR FROM c GROUP BY 1"
    return f"{texts('file_type')}, {CH}, w AS (SELECT {up(PARENT)} AS node_path, added, removed FROM ch) " + " UNION ALL ".join([*parts, f"({mode})", distinct])


PARENT = "regexp_extract(repo_slug || '/' || file_path, '^(.*)/', 1)"

HISTORY = f"""{CH}, p AS (SELECT repo_slug, file_path, epoch_us(min(touched_at)) AS lo, epoch_us(max(touched_at)) AS hi, count(DISTINCT author_email) AS author_count, count(*) AS commit_count,
        coalesce(sum(added) FILTER (WHERE NOT coalesce(is_creation, false)), 0)::BIGINT AS total_lines_added, coalesce(sum(removed) FILTER (WHERE NOT coalesce(is_creation, false)), 0)::BIGINT AS total_lines_removed
        FROM ch WHERE touched_at IS NOT NULL GROUP BY 1, 2),
    hist AS (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - lo) // 86400000000 AS file_age, (epoch_us(TIMESTAMP '{AS_OF}') - hi) // 86400000000 AS file_freshness,
        round(commit_count / greatest(1.0, (hi - lo) / (3600000000.0 * 24 * 30.44)), 6) AS commit_density FROM p)"""

ORACLES = {
    "r01_rollup_sum": file_rollup("sum(file_size)::BIGINT AS file_size_sum, sum(file_lines)::BIGINT AS file_lines_sum", "count(file_size) + count(file_lines) > 0"),
    "r02_rollup_min": file_rollup("min(file_size) AS file_size_min", "count(file_size) > 0"),
    "r03_rollup_max": file_rollup("max(file_size) AS file_size_max", "count(file_size) > 0"),
    "r04_rollup_mean": file_rollup("round(avg(file_size), 6) AS file_size_mean, round(avg(file_lines), 6) AS file_lines_mean", "count(file_size) + count(file_lines) > 0"),
    "r05_rollup_count": geo("SELECT node_path, count(o_totalprice) AS price_count FROM gu GROUP BY 1"),
    "r06_rollup_range": geo("SELECT node_path, round(max(o_totalprice) - min(o_totalprice), 4) AS price_range, round(min(o_totalprice), 4) AS price_min, round(max(o_totalprice), 4) AS price_max FROM gu GROUP BY 1"),
    "r07_rollup_mode": texts("file_type") + "SELECT node_path, v AS file_type_mode FROM c QUALIFY row_number() OVER (PARTITION BY node_path ORDER BY n DESC, v) = 1",
    "r08_rollup_distinct": texts("file_type") + "SELECT node_path, count(*) AS file_type_distinct FROM c GROUP BY 1",
    "r09_filtered_count": geo("SELECT node_path, count(*) AS items_count, nullif(count(*) FILTER (WHERE flag = 'r'), 0) AS r_items_count, nullif(count(*) FILTER (WHERE flag = 'a'), 0) AS a_items_count FROM li GROUP BY 1"),
    "r10_filtered_sum": geo("SELECT node_path, sum(q)::BIGINT AS quantity_sum, (sum(q) FILTER (WHERE flag = 'r'))::BIGINT AS r_quantity_sum, round(avg(q) FILTER (WHERE flag = 'a'), 4) AS a_quantity_mean FROM li GROUP BY 1"),
    "r11_declarations_of_files": geo("""SELECT dir || '/' || o_orderkey AS node_path, count(*) AS items_count, nullif(count(*) FILTER (WHERE l_returnflag = 'R'), 0) AS r_items_count,
        sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity_sum, round(avg(CAST(l_quantity AS BIGINT)), 6) AS quantity_mean, max(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'A') AS a_quantity_max
        FROM lineitem JOIN g ON l_orderkey = o_orderkey GROUP BY 1"""),
    "r12_tree_counts": f"""WITH {N}, fu AS (SELECT {up("parent_path")} AS node_path, parent_path FROM n WHERE node_kind = 'file'),
        a AS (SELECT node_path, count(*) AS all_files, count(*) FILTER (WHERE node_path = parent_path) AS direct_files FROM fu GROUP BY 1),
        du AS (SELECT {up("parent_path")} AS node_path FROM n WHERE node_kind = 'dir' AND parent_path IS NOT NULL AND node_path IN (SELECT node_path FROM a)),
        b AS (SELECT node_path, count(*) AS all_dirs FROM du GROUP BY 1)
        SELECT node_path, direct_files, all_files, coalesce(all_dirs, 0) AS all_dirs FROM a LEFT JOIN b USING (node_path)""",
    "r13_leaf_count_and_depth": f"""WITH {N}, fu AS (SELECT {up("parent_path")} AS node_path, tree_depth AS fd FROM n WHERE node_kind = 'file')
        SELECT n.node_path, greatest(count(fd), 1) AS leaf_count, coalesce(max(fd) - any_value(tree_depth), 0)::BIGINT AS max_depth FROM n LEFT JOIN fu USING (node_path) WHERE node_kind = 'dir' GROUP BY 1""",
    "r14_closure": f"""WITH {N}, u AS (SELECT node_path AS descendant_path, {up("node_path")} AS ancestor_path FROM n)
        SELECT ancestor_path, descendant_path, (len(string_split(descendant_path, '/')) - len(string_split(ancestor_path, '/')))::INTEGER AS distance FROM u""",
    "r15_size_with_floor": f"WITH {FILES}, u AS (SELECT {up('dir')} AS node_path, file_size FROM f) SELECT node_path, sum(CASE WHEN file_size IS NULL OR file_size <= 0 THEN 1.0 ELSE file_size END)::DOUBLE AS total FROM u GROUP BY 1",
    "r16_commit_rollup": f"""WITH {CH}, u AS (SELECT {up(PARENT)} AS node_path, added, removed FROM ch)
        SELECT node_path, sum(added)::BIGINT AS lines_added_sum, round(avg(added), 6) AS lines_added_mean, max(removed) AS lines_removed_max, min(added + removed) AS lines_changed_min, sum(added + removed)::BIGINT AS lines_changed_sum
        FROM u GROUP BY 1 HAVING count(added) + count(removed) > 0""",
    "r17_fused_expressions": _fused(),
    "r18_direct_weight": f"WITH {FILES} SELECT dir AS node_path, CASE WHEN coalesce(sum(file_size), 0) > 0 THEN sum(file_size)::BIGINT ELSE count(*) END AS weight FROM f GROUP BY 1",
    "f01_ordered_globs": f"WITH {N} SELECT node_path, {rules_sql(below_root('node_path'))} AS included FROM n WHERE node_kind = 'file'",
    "f02_subtree_prune": f"""WITH {N}, u AS (SELECT node_path, {up(below_root("node_path"))} AS p FROM n WHERE node_kind = 'file')
        SELECT node_path FROM u GROUP BY 1 HAVING bool_and({rules_sql("p")})""",
    "f03_classification": f"WITH {N}, u AS (SELECT node_path, {below_root('node_path')} AS p FROM n WHERE node_kind = 'file') SELECT node_path, {CLASS_SQL} AS class FROM u",
    "f04_file_lines": f"WITH {FILES} SELECT node_id, file_lines, file_size FROM f",
    "f05_extension": f"WITH {N} SELECT node_id, {KIND} AS extension FROM n WHERE node_kind = 'file'",
    "f06_comment_ratio": """WITH l AS (SELECT node_id, list_filter(regexp_split_to_array(content, '\\r?\\n'), lambda x: trim(x, ' ') <> '') AS ls FROM file_contents)
        SELECT node_id, round(CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*(//|#|/\\*|\\*)') AND NOT regexp_matches(x, '^\\s*#(include|define)'))) / len(ls) ELSE 0 END, 6) AS comment_ratio FROM l""",
    "f07_without_binaries": f"""WITH {N}, k AS (SELECT * FROM n WHERE node_kind = 'file' AND NOT coalesce(is_binary, false)),
        fu AS (SELECT {up("parent_path")} AS node_path, parent_path FROM k), a AS (SELECT node_path, count(*) AS all_files, count(*) FILTER (WHERE node_path = parent_path) AS direct_files FROM fu GROUP BY 1),
        du AS (SELECT {up("parent_path")} AS node_path FROM n WHERE node_kind = 'dir' AND parent_path IS NOT NULL AND node_path IN (SELECT node_path FROM a)),
        b AS (SELECT node_path, count(*) AS all_dirs FROM du GROUP BY 1)
        SELECT node_path, direct_files, all_files, coalesce(all_dirs, 0) AS all_dirs FROM a LEFT JOIN b USING (node_path)""",
    "f09_directory_grain": f"WITH {N} SELECT repo_slug, tree_depth, count(*) AS dirs FROM n WHERE node_kind = 'dir' GROUP BY 1, 2",
    "h01_history_metrics": f"WITH {HISTORY} SELECT repo_slug, file_path, file_age, file_freshness, author_count, commit_count, total_lines_added, total_lines_removed, commit_density FROM hist",
    "h03_age_and_freshness": f"WITH {HISTORY} SELECT repo_slug, file_path, file_age, file_freshness FROM hist",
    "h04_author_count": f"WITH {HISTORY} SELECT repo_slug, file_path, author_count FROM hist",
    "h05_commit_count": f"WITH {HISTORY} SELECT repo_slug, file_path, commit_count FROM hist",
    "h06_lines": f"WITH {HISTORY} SELECT repo_slug, file_path, total_lines_added, total_lines_removed FROM hist",
    "h07_commit_density": f"WITH {HISTORY} SELECT repo_slug, file_path, commit_density FROM hist",
    "h02_commit_total": f"WITH {T} SELECT repo_slug, count(DISTINCT commit_hash) AS commits FROM t GROUP BY 1",
    "h08_history_of_files": f"""WITH {N}, k AS (SELECT DISTINCT repo_slug, {below_root("node_path")} AS file_path FROM n WHERE node_kind = 'file'),
        c AS (SELECT DISTINCT repo_slug, commit_hash, regexp_replace(replace(p, chr(92), '/'), '^(\\./+)+', '') AS file_path FROM (SELECT repo_slug, commit_hash, unnest(changed_paths) AS p FROM commits))
        SELECT repo_slug, file_path, count(*) AS commits FROM c SEMI JOIN k USING (repo_slug, file_path) GROUP BY 1, 2""",
    "h09_tracked_only": f"""WITH {N}, {T}, k AS (SELECT DISTINCT repo_slug, {below_root("node_path")} AS file_path FROM n WHERE node_kind = 'file')
        SELECT repo_slug, count(*) AS touches, count(DISTINCT file_path) AS files FROM t SEMI JOIN k USING (repo_slug, file_path) GROUP BY 1""",
    "h10_against_all_parents": f"""WITH {T} SELECT repo_slug, commit_hash, file_path FROM t GROUP BY 1, 2, 3
        HAVING count(DISTINCT parent_idx) >= greatest(coalesce(max(n_parents), 1), 1)""",
    "h11_file_range": f"WITH {T} SELECT repo_slug, file_path, epoch_us(min(touched_at)) AS earliest, epoch_us(max(touched_at)) AS latest FROM t WHERE touched_at IS NOT NULL GROUP BY 1, 2",
    "h12_overall_range": f"WITH {T} SELECT epoch_us(min(touched_at)) AS earliest, epoch_us(max(touched_at)) AS latest FROM t",
    "h13_last_active": f"WITH {T}, {LAST} SELECT email AS author_email, last_us FROM la",
    "h14_first_parent": f"WITH {T} SELECT repo_slug, file_path, sum(coalesce(added, 0))::BIGINT AS added, sum(coalesce(removed, 0))::BIGINT AS removed FROM t WHERE parent_idx = 0 GROUP BY 1, 2",
    "h15_commit_paths": f"""WITH {N}, {T}, k AS (SELECT DISTINCT repo_slug, {below_root("node_path")} AS file_path FROM n WHERE node_kind = 'file')
        SELECT repo_slug, commit_hash, array_to_string(list_sort(list(DISTINCT file_path)), '|') AS paths FROM t SEMI JOIN k USING (repo_slug, file_path) GROUP BY 1, 2""",
    **{
        f"a{i:02d}_{m}": f"{AUTHORS} SELECT node, {m} FROM m"
        for i, m in enumerate(("code_owner", "initial_developer", "current_maintainer", "significant_contributor_count", "bus_factor", "ownership_dominance", "contributor_entropy", "orphan_risk", "knowledge_handoff"), 1)
    },
    "a10_directory_authorship": f"WITH {DIR_CONTRIB}, {RECORDS}, {LAST}, {RANKED}, {NINE} SELECT * FROM m",
    "a11_top_authors": f"WITH {CONTRIB} SELECT email, weight::BIGINT AS weight, first FROM ({TOP})",
    "a12_other_authors": f"{AUTHORS}, top AS ({TOP}) SELECT node, "
    + ", ".join(f"CASE WHEN {c} = '«unmaintained»' OR {c} IN (SELECT email FROM top) THEN {c} ELSE '«other»' END AS {c}" for c in ("code_owner", "initial_developer", "current_maintainer"))
    + " FROM m",
    "a13_mailmap": """WITH mm(o, e, n) AS (VALUES ('conveyor@ci.foundry.example', 'builds@foundry.example', 'Build Team'), ('janitor@bots.foundry.example', 'janitor@foundry.example', ''), ('train@release.foundry.example', 'train@release.foundry.example', 'Train')),
        c AS (SELECT DISTINCT commit_hash, author_email, author_name FROM commits)
        SELECT coalesce(nullif(e, ''), author_email) AS author_email, coalesce(nullif(n, ''), author_name) AS author_name, count(DISTINCT commit_hash) AS commits FROM c LEFT JOIN mm ON lower(author_email) = o GROUP BY 1, 2""",
    "a14_author_ranking": f"{AUTHORS} SELECT node, email, weight::BIGINT AS weight, round(share, 6) AS share, rank FROM z WHERE total > 0",
    "j01_new_recent_authors": f"WITH {CONTRIB}, {RECORDS} SELECT node, email, rw::BIGINT AS recent_weight FROM rec r WHERE rw IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rec e WHERE e.node = r.node AND e.email = r.email AND e.was_early)",
    "j02_nearest_ancestor": f"""WITH {N}, mk AS (SELECT parent_path AS anc, min(node_name) AS module FROM n WHERE node_kind = 'file' AND ends_with(lower(node_name), '.go') GROUP BY 1),
        u AS (SELECT node_path, {up("parent_path")} AS anc FROM n WHERE node_kind = 'file') SELECT node_path, arg_max(module, length(anc)) AS module FROM u JOIN mk USING (anc) GROUP BY 1""",
    "t01_daily_grid": f"WITH {grid('events', 'ts', 'DAY')} SELECT bucket, started, count(e.ts) AS events FROM grid LEFT JOIN events e ON date_trunc('DAY', e.ts) = started GROUP BY 1, 2",
    "t02_hourly_grid": f"WITH {grid('events', 'ts', 'HOUR')} SELECT bucket, started, count(e.ts) AS events FROM grid LEFT JOIN events e ON date_trunc('HOUR', e.ts) = started GROUP BY 1, 2",
    "t03_unique_sum": f"""WITH {grid("events", "ts", "DAY")}, u AS (SELECT date_trunc('DAY', ts) AS started, user_id, max(value) AS v FROM events GROUP BY 1, 2)
        SELECT bucket, started, round(sum(v), 6) AS value FROM grid LEFT JOIN u USING (started) GROUP BY 1, 2""",
    "t04_bucket_mode": f"""WITH {grid("events", "ts", "HOUR")}, u AS (SELECT date_trunc('HOUR', ts) AS started, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2),
        b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY started ORDER BY n DESC, event_type) = 1) SELECT bucket, started, coalesce(event_type, '') AS category FROM grid LEFT JOIN b USING (started)""",
    "t05_upper_edge": f"WITH c AS (SELECT date_trunc('DAY', ts) AS ts FROM events), {grid('c', 'ts', 'DAY')} SELECT bucket, count(*) AS events FROM grid JOIN c ON ts = started GROUP BY 1",
    "t06_touch_days": f"WITH {T}, c AS (SELECT touched_at AS seen FROM t WHERE touched_at IS NOT NULL), {grid("c", "seen", "DAY")} SELECT bucket, started, count(seen) AS events FROM grid LEFT JOIN c ON date_trunc('DAY', seen) = started GROUP BY 1, 2",
    "b01_boundaries": f"WITH v AS (SELECT o_totalprice AS v FROM orders), {bounds(9)} SELECT unnest(range(len(bs))) ::INTEGER AS place, unnest(bs) AS boundary, lo AS min, hi AS max, n FROM bb",
    "b02_bucket_index": f"WITH v AS (SELECT o_totalprice AS v FROM orders), {bounds(11)}, x AS (SELECT v, {BUCKET} FROM v, bb) SELECT bucket::INTEGER AS bucket, count(*) AS n, min(v) AS lo, max(v) AS hi FROM x GROUP BY 1",
    "b03_bucket_colour": f"WITH v AS (SELECT o_totalprice AS v FROM orders), {bounds(11)}, x AS (SELECT v, bs, {BUCKET} FROM v, bb) SELECT bucket::INTEGER AS bucket, {_colour('temperature')} AS colour, count(*) AS n FROM x GROUP BY 1, 2",
    "b04_category_colour": f"WITH {N}, c AS (SELECT DISTINCT {KIND} AS category FROM n WHERE node_kind = 'file'), r AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS place FROM c) SELECT category, place, {palette('categorization')}[place % 12 + 1] AS colour FROM r",
    "b05_file_ink": f"WITH {FILES}, v AS (SELECT node_id, coalesce(file_size, 0) AS v FROM f), {bounds(9)}, x AS (SELECT node_id, bs, {BUCKET} FROM v, bb) SELECT node_id, {_colour('neutral')} AS colour FROM x",
    "b06_palettes": _palettes(),
    "s01_skip_counts": f"WITH {SCATTER} SELECT count(*) FILTER (WHERE x IS NULL) AS missing_x, count(*) FILTER (WHERE y IS NULL) AS missing_y, count(*) FILTER (WHERE size IS NULL) AS missing_size, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL AND size IS NOT NULL) AS kept FROM r",
    "s02_linear": f"WITH {SCATTER} SELECT node_id, round({PLOT.x} + {PLOT.w} * CASE WHEN lx = hx THEN 0.5 ELSE (x - lx) / (hx - lx) END, 6) AS px, round({PLOT.y} + {PLOT.h} * (1 - CASE WHEN ly = hy THEN 0.5 ELSE (y - ly) / (hy - ly) END), 6) AS py FROM dd, e",
    "s03_log": f"WITH {SCATTER} SELECT node_id, round({PLOT.x} + {PLOT.w} * CASE WHEN lx = hx THEN 0.5 ELSE (ln(x) - ln(lx)) / (ln(hx) - ln(lx)) END, 6) AS px FROM dd, e WHERE lx > 0",
    "s04_radius": f"WITH {SCATTER} SELECT node_id, {RADIUS} AS radius FROM dd, e",
    "s05_bands": f"WITH {FILES}, c AS (SELECT DISTINCT file_type AS label FROM f), r AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i, {PLOT.w} / count(*) OVER () AS s FROM c) SELECT label, round({PLOT.x} + i * s, 6) AS started, round({PLOT.x} + i * s + s, 6) AS ended, round({PLOT.x} + i * s + s / 2, 6) AS center FROM r",
    "s06_draw_order": f"WITH {SCATTER} SELECT node_id, {RADIUS} AS radius, node_name AS label FROM dd, e ORDER BY radius DESC, label, node_id",
    "g01_spiral": _spiral(),
    "g02_discs": f"""WITH {grid("events", "ts", "DAY")}, k AS (SELECT bucket, count(e.ts) AS n FROM grid LEFT JOIN events e ON date_trunc('DAY', e.ts) = started GROUP BY 1), m AS (SELECT max(n) AS hi FROM k)
        SELECT bucket, round(CASE WHEN n = 0 THEN 0 ELSE least(40.0, greatest(12.0, 12 + 28 * sqrt(n / hi))) END, 6) AS radius FROM k, m""",
    "g03_radial": f"""WITH RECURSIVE {N}, fu AS (SELECT {up("parent_path")} AS node_path FROM n WHERE node_kind = 'file'), k AS (SELECT node_path, count(*) AS leaves FROM fu GROUP BY 1),
        w AS (SELECT node_path, parent_path, node_kind, node_name, CASE WHEN node_kind = 'file' THEN 1 ELSE coalesce(leaves, 1) END AS weight FROM n LEFT JOIN k USING (node_path)),
        s AS (SELECT *, sum(weight) OVER (PARTITION BY parent_path) AS units,
            coalesce(sum(weight) OVER (PARTITION BY parent_path ORDER BY node_kind <> 'file', node_name, node_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM w WHERE parent_path IS NOT NULL),
        r(node_path, depth, started, sweep) AS (
            SELECT node_path, 0, -pi() / 2, 2 * pi() FROM w WHERE parent_path IS NULL
            UNION ALL
            SELECT node_path, depth, p_start + pad + (p_sweep - 2 * pad) / units * ahead, (p_sweep - 2 * pad) / units * weight FROM (
                SELECT s.node_path, r.depth + 1 AS depth, r.started AS p_start, r.sweep AS p_sweep, units, ahead, weight, CASE WHEN r.depth > 0 THEN r.sweep / (units + 2) ELSE 0 END AS pad
                FROM r JOIN s ON s.parent_path = r.node_path))
        SELECT node_path, depth, round(sweep, 6) AS sweep, round(started + sweep / 2, 6) AS angle, round(40 * depth * cos(started + sweep / 2), 6) AS x, round(40 * depth * sin(started + sweep / 2), 6) AS y FROM r""",
    "l02_surface": """WITH o AS (SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS ox, CAST(o_custkey % 97 AS DOUBLE) AS oy, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2),
        p AS (SELECT ox + 0.5 AS px, oy AS py FROM o),
        q AS (SELECT px, py, value, sqrt((px - ox) * (px - ox) + (py - oy) * (py - oy)) / 3.0 AS t, ox FROM p JOIN o ON ox BETWEEN px - 3 AND px + 3 AND oy BETWEEN py - 3 AND py + 3),
        w AS (SELECT px, py, value, t, 1 - t * t * t * (t * (t * 6 - 15) + 10) AS w FROM q WHERE t < 1),
        s AS (SELECT px, py, coalesce(avg(value) FILTER (WHERE t = 0), sum(w * value) / sum(w)) AS value FROM w GROUP BY 1, 2)
        SELECT px, py, round(value, 6) AS value FROM p LEFT JOIN s USING (px, py)""",
    "l06_bands": """WITH o AS (SELECT o_custkey, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x, CAST(o_orderkey % 1000 AS DOUBLE) AS y, o_totalprice AS v, o_orderkey AS k FROM orders),
        t AS (SELECT k AS triangle, x AS x0, y AS y0, v AS v0, lead(x, 1) OVER w AS x1, lead(y, 1) OVER w AS y1, lead(v, 1) OVER w AS v1, lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2, lead(v, 2) OVER w AS v2
              FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY x, y, v, k)),
        a AS (SELECT *, abs((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / 2 AS area, least(v0, v1, v2) AS lo, greatest(v0, v1, v2) AS hi FROM t WHERE x2 IS NOT NULL)
        SELECT triangle, round(area, 4) AS area, (lo >= 50000)::BIGINT + (lo >= 120000)::BIGINT + (lo >= 200000)::BIGINT + (lo >= 300000)::BIGINT AS lowest,
            (hi > 50000)::BIGINT + (hi > 120000)::BIGINT + (hi > 200000)::BIGINT + (hi > 300000)::BIGINT AS highest FROM a WHERE area > 0""",
    "l07_support_radius": """WITH o AS (SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS ox, round(o_totalprice / 1000, 0) AS oy FROM orders),
        p AS (SELECT ox, oy, count(*) AS n FROM o GROUP BY 1, 2),
        d AS (SELECT a.ox, a.oy, any_value(a.n) AS n, min(sqrt((a.ox - b.ox) * (a.ox - b.ox) + (a.oy - b.oy) * (a.oy - b.oy))) AS d FROM p a JOIN p b ON a.ox <> b.ox OR a.oy <> b.oy GROUP BY 1, 2),
        r AS (SELECT d, sum(n) OVER (ORDER BY d, ox, oy ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER () AS total FROM d)
        SELECT round(2 * min(d), 6) AS radius FROM r WHERE upto >= ceil(0.9 * total)""",
    "e02_metrics": _catalogue()[0],
    "e03_expressions": _catalogue()[1],
    "e04_summary": f"WITH {N} SELECT count(*) FILTER (WHERE node_kind = 'file') AS files, count(*) FILTER (WHERE node_kind = 'dir') AS dirs, count(*) FILTER (WHERE node_kind = 'file' AND extension IS NULL) AS without_extension, count(*) FILTER (WHERE node_kind = 'file' AND is_binary IS NULL) AS without_is_binary FROM n",
}
