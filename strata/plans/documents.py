"""Registered queries over the scan documents and reports, each with the SQL that gives the same rows.

The documents are JSON texts of many parts; each part is read back out of the text and held against SQL. It is read entry by entry, as the
fragments of the documents have them, so that a document may be larger than any row or task.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import graph, metrics, report
from strata.plans import bridge as b
from strata.plans import catalogue as k
from strata.storage import written

#: Entries of the documents' lists and maps, by name.
ENTRY = {
    "long_files": "path string, lines long",
    "import_map": "map<string, array<string>>",
    "in_degree": "map<string, long>",
    "circular_dependencies": "array<string>",
    "cycles": "type string, length long, files array<string>, folders array<string>, risk_score long",
    "folder_coupling": "map<string, struct<external_dependencies: long, depends_on: array<string>>>",
    "tight_coupling_pairs": "array<string>",
    "core_modules": "path string, in_degree long, out_degree long, normalized_in double, normalized_out double, centrality_score double",
    "god_module_candidates": "path string, lines long, in_degree long, out_degree long",
    "layer_violations": "importer_folder string, imported_folder string",
}
#: What documents hold outside of them.
FACTS = """source_files long, total_files long, total_lines long, total_long_files long, max_in_degree_file string, total_cycles long, structural_class string,
architecture_score struct<raw_score: long, normalized_score: long, risk_breakdown: struct<long_file_penalty: long, circular_dependency_penalty: long, centralization_penalty: long, cross_folder_penalty: long>,
  structural_profile: struct<long_file_ratio: double, cycle_ratio: double, centralization_score: double, cross_folder_ratio: double>>"""


def _tables(s, d, graphs=b.GRAPHS, config=None, once=False):
    """``once``: the edges are read a single time, and so are not written."""
    edges = b.supplier_edges(s, d, graphs)
    return report.document_tables(b.supplier_files(s, d, graphs), edges if once else written(edges, "edges"), config)


def _listed(t, name, *fields):
    """A list's entries with their place."""
    x = report.placed(report.document_part(t, name)).select("repo", "place", F.from_json("text", ENTRY[name]).alias("c"))
    return x.select("repo", "place", *(fields or ("c.*",)))


def _mapped(t, name, key):
    """A map's entries: repo, ``key`` and c, the value."""
    return report.document_part(t, name).select("repo", F.explode(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), ENTRY[name])).alias(key, "c"))


def _folders(s, d):
    x = _mapped(_tables(s, d, b.WIDE, once=True), "folder_coupling", "folder")
    return x.select("repo", "folder", "c.external_dependencies", F.array_join("c.depends_on", ",").alias("depends_on"))


def _imports(s, d):
    t = _tables(s, d, b.WIDE)
    x = _mapped(t, "import_map", "rel_path").select("repo", "rel_path", F.size("c").cast("long").alias("n"), F.sha2(F.array_join("c", ","), 256).alias("imports"))
    return x.join(_mapped(t, "in_degree", "rel_path").withColumnRenamed("c", "in_degree"), ["repo", "rel_path"], "left").select("repo", "rel_path", "in_degree", "n", "imports")


def _long(s, d):
    return _listed(report.document_tables(b.supplier_files(s, d, b.WIDE), b.supplier_edges(s, d, b.WIDE)), "long_files")  # no edge is asked for


def _cycles(s, d):
    return _listed(_tables(s, d), "cycles").withColumns({"files": F.array_join("files", ","), "folders": F.array_join("folders", ",")})


def _pairs(s, d):
    return _listed(_tables(s, d), "tight_coupling_pairs", F.col("c")[0].alias("a"), F.col("c")[1].alias("b"))


def _violations(s, d):
    config = b.layers(s, b.WIDE).withColumn("scoring", F.lit(None).cast(metrics.config_struct()))
    return _listed(_tables(s, d, b.WIDE, config, once=True), "layer_violations")


def _weak(s, d):
    """Nations as repositories whose files all lie below ``tests``: confidence, and whether the summary says that it is weak."""
    files, edges = b.nation_files(s, d), written(b.nation_edges(s, d), "edges")
    view = report.overview(files, edges)
    text = report.summaries(view).select("repo", F.contains("summary", F.lit("\nArchitecture signal weak due to insufficient structural data.\n")).alias("weak"))
    x = view.select("repo", "total_files", "total_edges", "only_tests", metrics.signal_confidence("source_files").cast("long").alias("signal_confidence"))
    return x.join(text, "repo")


def _facts(s, d):
    edges = written(b.supplier_edges(s, d), "edges")
    cycle = written(graph.cycles(graph.strong_components(edges)), "cycles")  # facts and list read them
    t = report.document_tables(b.supplier_files(s, d), edges, cycle=cycle)
    chain = F.array_join(F.from_json("text", ENTRY["circular_dependencies"]), " -> ")
    cycles = report.as_list(report.document_part(t, "circular_dependencies"), chain, "chains", F.col("k2")).select("repo", F.array_join("chains", "; ").alias("cycles"))
    x = report.document_facts(t, FACTS).select("repo", "d.*").join(cycles, "repo", "left").na.fill("", ["cycles"])
    score = F.col("architecture_score")
    return x.select(
        "repo", "source_files", "total_files", "total_lines", "total_long_files", "max_in_degree_file", "total_cycles", "structural_class", "cycles",
        score["raw_score"].alias("raw_score"), score["normalized_score"].alias("normalized_score"), "architecture_score.risk_breakdown.*", "architecture_score.structural_profile.*",
    )


def _first_long(s, d):
    x = report.long_files_by_path(b.part_files(s, d))
    return x.select("repo", F.col("rank").cast("long").alias("rank"), "rel_path", F.col("lines").cast("long").alias("lines"))


def _view(s, d):
    return report.overview(b.supplier_files(s, d), k.edges_of(s, d))


def _audit(s, d):
    x = report.audit_rows(_view(s, d))
    return x.select("repo", F.col("place").cast("long").alias("place"), "metric", "value")


QUERIES = {
    "scan_documents": lambda s, d: report.scan_documents(b.supplier_files(s, d), k.edges_of(s, d)),
    "document_folders": _folders,
    "document_imports": _imports,
    "document_core_modules": lambda s, d: _listed(_tables(s, d, b.WIDE), "core_modules"),
    "document_long_files": _long,
    "document_god_modules": lambda s, d: _listed(_tables(s, d, b.WIDE), "god_module_candidates"),
    "document_layer_violations": _violations,
    "document_cycles": _cycles,
    "document_tight_pairs": _pairs,
    "weak_signals": _weak,
    "document_facts": _facts,
    "first_long_files": _first_long,
    "summary_text": lambda s, d: report.summaries(_view(s, d)),
    "markdown_report": lambda s, d: report.markdown(_view(s, d)),
    "audit_table": _audit,
}

_4 = "format('{{:.4f}}', {0})::DOUBLE"  # the exact binary value, half to even
_SIZE = "CASE WHEN total_files < 3 THEN 'Micro' WHEN total_files <= 10 THEN 'Small' WHEN total_files <= 50 THEN 'Medium' ELSE 'Large' END"
_REPORT = f"""share AS (SELECT repo, 100.0::DOUBLE * max_lines / nullif(total_lines, 0) AS line_share, 100.0::DOUBLE * max_functions / nullif(total_functions, 0) AS function_share, 100.0::DOUBLE * max_in / nullif(total_edges, 0) AS in_share FROM score),
signs AS (SELECT repo, max_lines > 300 AS a, coalesce(function_share > 40, false) AS b, coalesce(max_in > 0 AND in_share > 40, false) AS c, total_files > 2 AND coalesce(line_share > 50, false) AS d,
  (100 - 25 * (total_files < 5)::INT - 25 * (total_edges < 5)::INT - 25 * (total_files > 50 AND cross_folder_ratio = 0)::INT) AS confidence FROM score JOIN share USING (repo)),
tops AS (SELECT repo, list(rel_path || ': ' || lines || ' lines' ORDER BY lines DESC, rel_path)[:3] AS largest, count(*) FILTER (lines > 300) AS n_long,
  list(rel_path ORDER BY function_count DESC, rel_path)[1] AS f_file, list(rel_path ORDER BY class_count DESC, rel_path)[1] AS c_file, max(class_count) AS max_classes,
  list('`' || rel_path || '` (' || lines || ' lines)' ORDER BY lines DESC, rel_path) FILTER (lines > 300) AS long_files FROM files GROUP BY repo),
ins AS (SELECT repo, arg_min(rel_path, {{'n': -in_degree, 'p': rel_path}}) AS i_file FROM degrees GROUP BY repo),
fold AS (SELECT repo, list(folder ORDER BY external_dependencies DESC, folder) AS names, list(external_dependencies ORDER BY external_dependencies DESC, folder) AS n FROM coupling GROUP BY repo),
cyc AS (SELECT repo, list('  ' || array_to_string(list_append(nodes, nodes[1]), ' -> ') ORDER BY nodes) AS cycles FROM cycles GROUP BY repo),
neck AS (SELECT repo, list('  ' || rel_path ORDER BY rel_path) AS necks FROM (SELECT d.repo, d.rel_path, function_count, in_degree, sum(function_count) OVER (PARTITION BY d.repo) AS f, sum(in_degree) OVER (PARTITION BY d.repo) AS i FROM degrees d JOIN files USING (repo, rel_path))
  WHERE f > 0 AND i > 0 AND function_count::DOUBLE / f >= 0.3 AND in_degree::DOUBLE / i >= 0.3 GROUP BY repo),
v AS (SELECT *, CASE WHEN cross_folder_ratio > 0.4 THEN 'high' WHEN cross_folder_ratio > 0.25 THEN 'moderate' ELSE 'low' END AS level, {_SIZE} AS size, a::INT + b::INT + c::INT + d::INT AS growth
  FROM score JOIN share USING (repo) JOIN signs USING (repo) JOIN tops USING (repo) JOIN ins USING (repo) JOIN fold USING (repo) LEFT JOIN cyc USING (repo) LEFT JOIN neck USING (repo))"""
_yes = "CASE WHEN {0} THEN 'Yes' ELSE 'No' END".format
_pct = "format('{{:.1f}}', {0})".format
#: Folders of these graphs are regions, none of which is a folder of tests.
_SUMMARY = f"""SELECT repo, array_to_string(
  ['Repository: ' || repo, 'Project size: ' || size || ' (' || total_files || ' source files)', 'Total files: ' || total_files, 'Total lines: ' || total_lines, 'Total functions: ' || total_functions,
   'TODO count: 0', 'FIXME count: 0', 'Long files (>300 lines): ' || n_long]
  || CASE WHEN total_lines > 0 THEN ['Largest file share of total lines: ' || {_pct('line_share')} || '%'] ELSE [] END
  || CASE WHEN max_functions > 0 THEN ['Most function-heavy file share of total functions: ' || {_pct('function_share')} || '%'] ELSE [] END
  || ['', 'Top largest files:'] || list_transform(largest, lambda x: '  ' || x)
  || CASE WHEN max_functions > 0 THEN ['', 'Most functions: ' || f_file || ' (' || max_functions || ')'] ELSE [] END
  || CASE WHEN max_in > 0 THEN ['', 'Most depended-on file: ' || i_file || ' (in-degree ' || max_in || ', ' || {_pct('in_share')} || '% of internal imports)'] ELSE [] END
  || ['', 'Growth risk indicators: ' || growth || '/4 triggered', '  growth_risk_score: ' || growth, '  Largest file > 300 lines: ' || {_yes('a')}, '  Function share > 40%: ' || {_yes('b')},
      '  Dependency fan-in share > 40%: ' || {_yes('c')}, '  Small+ project dominated by one file (>50% lines): ' || {_yes('d')}]
  || ['', 'Folder-level coupling:', '- Cross-folder dependency ratio: ' || {_pct('100.0::DOUBLE * cross_folder_ratio')} || '% (' || CASE level WHEN 'high' THEN 'High coupling risk' WHEN 'moderate' THEN 'Moderate coupling' ELSE 'Low coupling' END || ')',
      '- Top most coupled folder: ' || names[1] || ' (' || n[1] || ' external folders)', '- Most externally dependent folders:']
  || list_transform(range(1, least(len(names), 3) + 1), lambda i: '  - ' || names[i] || ': ' || n[i] || ' external folders') || ['coupling_risk_level: ' || level]
  || ['', 'Signal confidence: ' || confidence || '%'] || CASE WHEN confidence < 50 THEN ['Architecture signal weak due to insufficient structural data.'] ELSE [] END
  || CASE WHEN necks IS NOT NULL THEN ['', 'Potential architectural bottleneck(s) (high function share and high dependency share):'] || necks ELSE [] END
  || CASE WHEN cycles IS NOT NULL THEN ['', 'Circular dependencies detected:'] || cycles ELSE ['', 'No circular dependencies detected.'] END
  || CASE WHEN max_classes > 0 THEN ['', 'Most classes: ' || c_file || ' (' || max_classes || ')'] ELSE [] END, chr(10)) AS summary FROM v"""
_MARKDOWN = f"""SELECT repo, array_to_string(
  ['# Architecture Report', '', '## Summary', '- **Project size:** ' || size || ' (' || total_files || ' source files)', '- **Total lines:** ' || total_lines, '- **Total files:** ' || total_files,
   '- **Signal confidence:** ' || confidence || '%', '- **Architecture score (deterministic):** ' || architecture_health_percentage, '', '## Growth Risks', '- **Growth risk indicators:** ' || growth || '/4 triggered']
  || CASE WHEN n_long > 0 THEN ['- **Long files (>300 lines):**'] || list_transform(long_files[:15], lambda x: '  - ' || x) ELSE ['- **Long files:** None'] END
  || ['', '## Coupling Analysis', '- **Cross-folder dependency ratio:** ' || {_pct('100.0::DOUBLE * cross_folder_ratio')} || '%', '- **Coupling risk level:** ' || level, '- **Top coupled folders:**']
  || list_transform(range(1, least(len(names), 10) + 1), lambda i: '  - `' || names[i] || '`: ' || n[i] || ' external folders') || ['', '## Key Issues', '- None reported.', ''], chr(10)) AS markdown FROM v"""
_AUDIT = """, first AS (SELECT repo, list(rel_path || ' (' || lines || ')' ORDER BY rel_path) AS l FROM files WHERE lines > 300 GROUP BY repo),
w AS (SELECT *, CASE WHEN l IS NOT NULL THEN array_to_string(l[:10], ', ') || CASE WHEN len(l) > 10 THEN ' … +' || (len(l) - 10) || ' more' ELSE '' END END AS shown FROM score LEFT JOIN first USING (repo))
SELECT * FROM (SELECT repo, unnest([2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14])::BIGINT AS place, unnest(['Path', 'Source files', 'Total lines', 'Structural class', 'TODO', 'FIXME', 'Files > 300 lines', 'Raw score', 'Normalized score',
  'Long file penalty', 'Circular dependency penalty', 'Centralization penalty', 'Cross-folder penalty']) AS metric,
  unnest([repo, total_files::VARCHAR, total_lines::VARCHAR, structural_class, '0', '0', shown, raw_score::VARCHAR, architecture_health_percentage::VARCHAR, long_file_penalty::VARCHAR, circular_dependency_penalty::VARCHAR,
  centralization_penalty::VARCHAR, cross_folder_penalty::VARCHAR]) AS value FROM w) WHERE value IS NOT NULL"""
_ALL = (*k.SCORED_SQL, k.COUPLING)

ORACLE_SQL = {
    "document_folders": k.with_parts(b.supplier_sql(b.WIDE), k.COUPLING) + "SELECT * FROM coupling",
    "document_imports": k.with_parts(b.supplier_sql(b.WIDE), k.DEGREES, "o AS (SELECT repo, src AS rel_path, count(*) AS n, string_agg(dst, ',' ORDER BY dst) AS deps FROM edges GROUP BY repo, src)")
    + "SELECT repo, rel_path, in_degree, coalesce(n, 0) AS n, sha256(coalesce(deps, '')) AS imports FROM degrees LEFT JOIN o USING (repo, rel_path)",
    "document_core_modules": k.with_parts(
        b.supplier_sql(b.WIDE), k.DEGREES, "m AS (SELECT repo, greatest(max(in_degree), 1) AS i, greatest(max(out_degree), 1) AS o FROM degrees GROUP BY repo)",
        "c AS (SELECT *, in_degree::DOUBLE / i AS x, out_degree::DOUBLE / o AS y FROM degrees JOIN m USING (repo) WHERE in_degree > 0 OR out_degree > 0)",
    )
    + f"SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY (x + y) / 2.0::DOUBLE DESC, rel_path) - 1 AS place, rel_path AS path, in_degree, out_degree, {_4.format('x')} AS normalized_in, {_4.format('y')} AS normalized_out, {_4.format('(x + y) / 2.0::DOUBLE')} AS centrality_score FROM c",
    "document_long_files": k.with_parts(b.supplier_sql(b.WIDE)) + "SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY rel_path) - 1 AS place, rel_path AS path, lines FROM files WHERE lines > 300",
    "document_god_modules": k.with_parts(b.supplier_sql(b.WIDE), k.DEGREES, *k.GODS) + "SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY rel_path) - 1 AS place, rel_path AS path, lines, in_degree, out_degree FROM g JOIN m USING (repo) WHERE lines > 800 AND degree > median",
    "document_layer_violations": k.with_parts(b.supplier_sql(b.WIDE), *k.LAYERED) + f"SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY importer_folder, imported_folder) - 1 AS place, importer_folder, imported_folder FROM ({k.VIOLATIONS})",
    "document_cycles": k.with_parts(b.SUPPLIER_SQL, k.SCC, recursive=True) + f"SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY type, n, nodes) - 1 AS place, type, n AS length, array_to_string(nodes, ',') AS files, {k.CYCLE_FOLDERS} AS folders, 2 * n AS risk_score FROM (SELECT *, {k.CYCLE_TYPE} AS type FROM cycles)",
    "document_tight_pairs": k.with_parts(b.SUPPLIER_SQL, k.SCC, recursive=True) + "SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY nodes) - 1 AS place, nodes[1] AS a, nodes[2] AS b FROM cycles WHERE n = 2",
    "weak_signals": k.with_parts(b.NATION_SQL) + """SELECT repo, n AS total_files, e AS total_edges, true AS only_tests, confidence AS signal_confidence, confidence < 50 AS weak
  FROM (SELECT *, greatest(0, 100 - 25 * (n < 5)::INT - 25 * (e < 5)::INT - 25 - 25 * (n > 50 AND e = 0)::INT - 25 * (n > 50 AND e > 0)::INT)::BIGINT AS confidence FROM (SELECT repo, count(*) AS n, (SELECT count(*) FROM edges e WHERE e.repo = files.repo) AS e FROM files GROUP BY repo))""",
    "document_facts": k.with_parts(*_ALL, k.score_sql(), recursive=True)
    + f"""SELECT repo, total_files AS source_files, total_files, total_lines, total_long_files, (SELECT arg_min(rel_path, {{'n': -in_degree, 'p': rel_path}}) FROM degrees d WHERE d.repo = score.repo) AS max_in_degree_file,
  total_cycles, structural_class, coalesce((SELECT string_agg(array_to_string(list_append(nodes, nodes[1]), ' -> '), '; ' ORDER BY nodes) FROM cycles y WHERE y.repo = score.repo), '') AS cycles, raw_score,
  architecture_health_percentage AS normalized_score, long_file_penalty, circular_dependency_penalty, centralization_penalty, cross_folder_penalty, {_4.format('long_file_ratio')} AS long_file_ratio,
  {_4.format('cycle_ratio')} AS cycle_ratio, {_4.format('centralization_score')} AS centralization_score, {_4.format('cross_folder_ratio')} AS cross_folder_ratio FROM score""",
    "first_long_files": k.with_parts(b.PART_SQL) + "SELECT repo, row_number() OVER w AS rank, rel_path, lines::BIGINT AS lines FROM files WHERE lines > 300 WINDOW w AS (PARTITION BY repo ORDER BY rel_path) QUALIFY row_number() OVER w <= 10",
    "summary_text": k.with_parts(*_ALL, k.score_sql(), _REPORT, recursive=True) + _SUMMARY,
    "markdown_report": k.with_parts(*_ALL, k.score_sql(), _REPORT, recursive=True) + _MARKDOWN,
    "audit_table": k.with_parts(*_ALL, k.score_sql(), recursive=True).rstrip() + _AUDIT,
}
