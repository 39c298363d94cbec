"""The registered queries over the bridged tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import paths, rules
from strata.operators import graph, metrics, review
from strata.plans import bridge as b
from strata.storage import written

c = F.col


def edges_of(s, d):
    """The import graphs, written once: degrees, totals, components and coupling all read them."""
    return written(b.supplier_edges(s, d), "edges")


def _facts(s, d):
    return metrics.repo_facts(b.supplier_files(s, d), edges_of(s, d))


def _custom(s):
    """Overrides: a profile, other thresholds, a scale and floors, one of them 0 (which counts as missing)."""
    text = (
        '{"scoring": {"scoring_profile": "relaxed", "long_file_threshold_low": 400, "cross_folder_threshold_high": 0.85, "cycle_penalty_2_node": 7, '
        '"structural_class_health_floor": {"small_project": 0, "mid_project": 12}, "structural_class_penalty_scale": {"mid_project": 0.5}}}'
    )
    x = s.createDataFrame([("q49_45", text), ("q48_46", text.replace('"small_project": 0', '"small_project": 33'))], "repo string, text string")
    return x.select("repo", metrics.settings(c("text")).alias("j")).select("repo", "j.*")


def _cycles(s, d):
    return graph.cycles(graph.strong_components(b.supplier_edges(s, d)))


def _degrees(s, d):
    return graph.degrees(b.supplier_files(s, d, b.WIDE), b.supplier_edges(s, d, b.WIDE))


def _path_parts(s, d):
    x, p = b.page_paths(s, d), c("rel_path")
    return x.select("page_id", paths.module_name(p).alias("module"), paths.top_folder(p).alias("folder"), paths.base_name(p).alias("name"), paths.url_name(c("url")).alias("url_name"))


def _adjusted(s, d):
    x = b.table(s, d, "conversations").select("conv_id", "turn").distinct()
    score, n, growth = (c("conv_id") * 7 + c("turn") * 13) % 101, c("conv_id") % 4, c("turn") % 5
    level = F.element_at(F.array(*map(F.lit, ("low", "moderate", "high", "x"))), (c("conv_id") % 4 + 1).cast("int"))
    return x.select("conv_id", "turn", rules.adjusted_score(score, n, growth, level).cast("long").alias("adjusted_score"))


def _cycle_text(s, d):
    x = graph.cycle_analysis(_cycles(s, d))
    return x.select("repo", "type", c("length").cast("long").alias("length"), F.array_join("files", ",").alias("files"), F.array_join("folders", ",").alias("folders"), c("risk_score").cast("long").alias("risk_score"))


def _coupling_text(s, d):
    x = graph.folder_coupling(b.supplier_files(s, d, b.WIDE), b.supplier_edges(s, d, b.WIDE))
    return x.select("repo", "folder", c("external_dependencies").cast("long").alias("external_dependencies"), F.array_join("depends_on", ",").alias("depends_on"))


def _score_columns(scored):
    return scored.select(
        "repo", "total_files", "total_lines", "structural_class", c("raw_score"), "architecture_health_percentage", c("long_file_penalty"), c("circular_dependency_penalty"),
        c("centralization_penalty").cast("long").alias("centralization_penalty"), c("cross_folder_penalty").cast("long").alias("cross_folder_penalty"),
        "long_file_ratio", "cycle_ratio", "centralization_score", "cross_folder_ratio", "scoring_mode", "scoring_profile",
    )


def _top3(s, d):
    return graph.top_rows(b.part_files(s, d), 3, F.desc("lines"), "rel_path").select("repo", "rel_path", "lines", c("rank").cast("long").alias("rank"))


def _top15(s, d):
    x = b.part_files(s, d).where("lines > 300")
    return graph.top_rows(x, 15, F.desc("lines"), "rel_path").select("repo", "rel_path", "lines", c("rank").cast("long").alias("rank"))


def _review(s, d):
    x = review.parse_lenient(b.reviews(s, d))
    return x.select("conv_id", "turn", c("architecture_score").cast("long").alias("architecture_score"), F.array_join("key_issues", ",").alias("key_issues"), F.size("improvement_priorities").cast("long").alias("n_priorities"))


def _strict(s, d):
    x = review.parse_strict(b.reviews(s, d))
    return x.select("conv_id", "turn", "error", c("architecture_score").cast("long").alias("architecture_score"))


def _totals(s, d):
    x = metrics.totals(b.part_files(s, d))
    return x.select("repo", "total_files", "total_lines", "total_long_files", "total_functions", "average_lines_per_file")


def _size(s, d):
    x = metrics.totals(b.part_files(s, d))
    n, lines = c("total_files"), c("total_lines")
    kind = rules.structural_class(n, lines)
    return x.select("repo", rules.size_name(n).alias("size"), kind.alias("structural_class"), rules.class_rule(kind).alias("rule"))


def _growth(s, d):
    x = _facts(s, d)
    return x.select("repo", metrics.growth_risk().cast("long").alias("growth_risk_score"), metrics.signal_confidence().cast("long").alias("signal_confidence"))


def _coupling_level(s, d, tests):
    return metrics.coupling_risk(b.supplier_files(s, d), edges_of(s, d), tests)


QUERIES = {
    "line_counts": lambda s, d: b.document_files(s, d).select("repo", "rel_path", "lines"),
    "marker_counts": lambda s, d: b.document_files(s, d).groupBy("repo").agg(F.sum("todo").alias("todo_count"), F.sum("fixme").alias("fixme_count")),
    "path_parts": _path_parts,
    "repo_totals": _totals,
    "long_files_300": lambda s, d: b.part_files(s, d).where("lines > 300").select("repo", "rel_path", "lines"),
    "top3_largest": _top3,
    "report_top15": _top15,
    "size_classes": _size,
    "argmax_stats": lambda s, d: metrics.extremes(b.part_files(s, d)),
    "long_file_penalty": lambda s, d: b.part_files(s, d).groupBy("repo").agg(F.sum(rules.long_penalty(c("lines"), *map(F.lit, (500, 800, 2, 5)))).alias("penalty")),
    "edges": lambda s, d: b.supplier_edges(s, d, b.WIDE).groupBy("repo", "src", "dst").agg(F.count("*").alias("n")),
    "degrees": lambda s, d: _degrees(s, d),
    "max_in_degree_file": lambda s, d: graph.max_in_degree_file(_degrees(s, d)),
    "core_modules": lambda s, d: graph.core_modules(_degrees(s, d)),
    "god_modules": lambda s, d: graph.god_modules(b.supplier_files(s, d, b.WIDE), _degrees(s, d)),
    "bottlenecks": lambda s, d: graph.bottlenecks(b.supplier_files(s, d, b.WIDE), _degrees(s, d), 0.01),
    "folder_coupling": _coupling_text,
    "cross_folder_ratio": lambda s, d: graph.edge_totals(b.supplier_edges(s, d, b.WIDE)),
    "layer_violations": lambda s, d: graph.layer_violations(b.supplier_edges(s, d, b.WIDE), b.layers(s, b.WIDE)),
    "scc": lambda s, d: graph.strong_components(b.supplier_edges(s, d)),
    "scc_over_tasks": lambda s, d: _over_tasks(s, d),
    "cycles": lambda s, d: _cycles(s, d).select("repo", F.array_join(graph.closed("nodes"), " -> ").alias("cycle")),
    "tight_pairs": lambda s, d: graph.tight_pairs(_cycles(s, d)),
    "cycle_analysis": _cycle_text,
    "cycle_penalty": lambda s, d: _cycles(s, d).groupBy("repo").agg(F.sum(rules.cycle_penalty(F.size("nodes"), F.lit(10))).alias("penalty"), F.count("*").alias("total_cycles")),
    "coupling_level": lambda s, d: _coupling_level(s, d, rules.TEST_FOLDERS),
    "coupling_level_tests": lambda s, d: _coupling_level(s, d, tuple(x.lower() for x in b.LAYERS)),
    "growth_and_confidence": _growth,
    "architecture_score": lambda s, d: _score_columns(metrics.score(_facts(s, d))),
    "architecture_score_custom": lambda s, d: _score_columns(metrics.score(metrics.repo_facts(b.supplier_files(s, d), edges_of(s, d), None, _custom(s)))),
    "benchmark_rows": lambda s, d: metrics.benchmark_rows(metrics.score(_facts(s, d))),
    "harness_metrics": lambda s, d: _harness(s, d),
    "adjusted_score": _adjusted,
    "review_lenient": _review,
    "review_strict": _strict,
}


def _over_tasks(s, d):
    numbers = b.supplier_numbers(s, d, b.WIDE)
    return graph.strong_components(b.supplier_edges(s, d, b.WIDE), local_edges=0) if numbers is None else graph.numbered_components(*numbers, local_edges=0)


def _harness(s, d):
    x = metrics.harness_rows(metrics.score(_facts(s, d)))
    return x.withColumns({k: c(k).cast("long") for k in ("centralization_penalty", "cross_folder_penalty")})


# --- SQL ---

FOLDER = "CASE WHEN contains({0}, '/') THEN split_part({0}, '/', 1) ELSE '.' END"
_src, _dst, _path = (FOLDER.format(x) for x in ("src", "dst", "rel_path"))
DEGREES = """degrees AS (SELECT f.repo, f.rel_path, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM files f
  LEFT JOIN (SELECT repo, dst, count(*) AS n FROM edges GROUP BY repo, dst) i ON i.repo = f.repo AND i.dst = f.rel_path
  LEFT JOIN (SELECT repo, src, count(*) AS n FROM edges GROUP BY repo, src) o ON o.repo = f.repo AND o.src = f.rel_path)"""
SCC = """uniq AS (SELECT DISTINCT repo, src, dst FROM edges), reach(repo, a, z) AS (SELECT repo, src, dst FROM uniq UNION SELECT r.repo, r.a, u.dst FROM reach r JOIN uniq u ON u.repo = r.repo AND u.src = r.z),
ends AS (SELECT repo, src AS rel_path FROM uniq UNION SELECT repo, dst FROM uniq),
scc AS (SELECT e.repo, least(e.rel_path, coalesce(min(y.z), e.rel_path)) AS component, e.rel_path FROM ends e
  LEFT JOIN (SELECT x.repo, x.a, x.z FROM reach x JOIN reach y ON x.repo = y.repo AND x.a = y.z AND x.z = y.a) y ON y.repo = e.repo AND y.a = e.rel_path GROUP BY e.repo, e.rel_path),
cycles AS (SELECT repo, component, count(*) AS n, list(rel_path ORDER BY rel_path) AS nodes FROM scc GROUP BY repo, component HAVING count(*) > 1)"""
RATIOS = f"ratios AS (SELECT repo, count(*) AS total_edges, count(*) FILTER ({_src} <> {_dst}) AS cross_edges, (count(*) FILTER ({_src} <> {_dst}))::DOUBLE / count(*) AS cross_folder_ratio FROM edges GROUP BY repo)"
COUPLING = f"""coupling AS (SELECT repo, folder, count(DISTINCT other) AS external_dependencies, coalesce(string_agg(DISTINCT other, ',' ORDER BY other), '') AS depends_on
  FROM (SELECT repo, {_src} AS folder, CASE WHEN {_src} <> {_dst} THEN {_dst} END AS other FROM edges UNION ALL SELECT repo, {_path}, NULL FROM files) GROUP BY repo, folder)"""


def with_parts(*parts, recursive=False):
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts) + "\n"


_S, _W = b.SUPPLIER_SQL, b.supplier_sql(b.WIDE)
_CLASS = "CASE WHEN total_files <= 50 AND total_lines <= 50000 THEN 'small_project' WHEN total_files <= 300 AND total_lines <= 200000 THEN 'mid_project' WHEN total_lines::DOUBLE / total_files >= 250 THEN 'core_engine' ELSE 'large_framework' END"


def score_sql(custom: bool = False) -> str:
    values = "('q49_45', 400, 0.85::DOUBLE, 7, 20, 12, 0.5::DOUBLE, 'custom', 'relaxed'), ('q48_46', 400, 0.85, 7, 33, 12, 0.5, 'custom', 'relaxed'), ('q49_46', 500, 0.4, 10, 20, 20, 1.0, 'default', 'v2_default')"
    plain = ", ".join(f"('{g[0]}', 500, 0.4::DOUBLE, 10, 20, 20, 1.0::DOUBLE, 'default', 'v2_default')" for g in b.GRAPHS)
    return f"""settings(repo, low, cross_high, base, small_floor, mid_floor, mid_scale, scoring_mode, scoring_profile) AS (VALUES {values if custom else plain}),
t AS (SELECT repo, count(*) AS total_files, sum(lines)::BIGINT AS total_lines, (sum(CASE WHEN lines > 800 THEN 5 WHEN lines > low THEN 2 ELSE 0 END))::BIGINT AS long_file_penalty,
  count(*) FILTER (lines > low) AS long_count, count(*) FILTER (lines > 500) AS total_long_files, sum(function_count)::BIGINT AS total_functions, max(lines) AS max_lines, max(function_count) AS max_functions FROM files JOIN settings USING (repo) GROUP BY repo),
k AS (SELECT repo, count(*) AS total_cycles, (sum(round_even(base * ln(n) / ln(2.0::DOUBLE), 0)))::BIGINT AS cyc FROM cycles JOIN settings USING (repo) GROUP BY repo),
m AS (SELECT repo, max(in_degree) AS max_in FROM degrees GROUP BY repo),
j AS (SELECT t.*, settings.* EXCLUDE (repo), coalesce(total_cycles, 0) AS total_cycles, coalesce(cyc, 0) AS circular_dependency_penalty, max_in, coalesce(total_edges, 0) AS total_edges, coalesce(cross_folder_ratio, 0) AS cross_folder_ratio, {_CLASS} AS structural_class,
  (CASE WHEN max_in > total_files * 0.05::DOUBLE THEN 10 ELSE 0 END)::BIGINT AS centralization_penalty, (CASE WHEN cross_folder_ratio > cross_high THEN 20 WHEN cross_folder_ratio > 0.2 THEN 10 ELSE 0 END)::BIGINT AS cross_folder_penalty
  FROM t JOIN settings USING (repo) JOIN m USING (repo) LEFT JOIN k USING (repo) LEFT JOIN ratios USING (repo)),
score AS (SELECT *, long_file_penalty + circular_dependency_penalty + centralization_penalty + cross_folder_penalty AS raw_score, long_count::DOUBLE / total_files AS long_file_ratio, total_cycles::DOUBLE / total_files AS cycle_ratio, max_in::DOUBLE / total_files AS centralization_score,
  greatest(CASE structural_class WHEN 'small_project' THEN small_floor WHEN 'mid_project' THEN mid_floor WHEN 'large_framework' THEN 25 ELSE 30 END, least(100, round_even(greatest(0, 100.0::DOUBLE - (
    (CASE structural_class WHEN 'small_project' THEN 1.0::DOUBLE WHEN 'mid_project' THEN mid_scale WHEN 'large_framework' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END)
    * (long_file_penalty * (long_count::DOUBLE / total_files) + circular_dependency_penalty * (total_cycles::DOUBLE / total_files)) + centralization_penalty + cross_folder_penalty)), 0)))::BIGINT AS architecture_health_percentage FROM j)"""


GODS = ("g AS (SELECT d.*, lines, in_degree + out_degree AS degree FROM degrees d JOIN files USING (repo, rel_path))", "m AS (SELECT repo, quantile_disc(degree, 0.5 ORDER BY degree DESC) AS median FROM g GROUP BY repo)")
LAYERED = (f"p AS (SELECT DISTINCT repo, {_src} AS importer_folder, {_dst} AS imported_folder FROM edges)", f"o AS (SELECT unnest({list(b.LAYERS)}) AS folder, unnest(range({len(b.LAYERS)})) AS pos)")
VIOLATIONS = "SELECT p.* FROM p JOIN o x ON x.folder = importer_folder JOIN o y ON y.folder = imported_folder WHERE x.pos < y.pos"
CYCLE_TYPE = "CASE WHEN n = 2 THEN 'tight_coupling' WHEN n <= 5 THEN 'layer_leak' ELSE 'structural_cycle' END"
CYCLE_FOLDERS = "array_to_string(list_sort(list_distinct(list_transform(nodes, lambda x: split_part(x, '/', 1)))), ',')"
SCORED_SQL = (_S, DEGREES, RATIOS, SCC)
_SCORE_COLUMNS = "repo, total_files, total_lines, structural_class, raw_score, architecture_health_percentage, long_file_penalty, circular_dependency_penalty, centralization_penalty, cross_folder_penalty, long_file_ratio, cycle_ratio, centralization_score, cross_folder_ratio, scoring_mode, scoring_profile"
_LEVEL = "CASE WHEN cross_folder_ratio > 0.4 THEN 'high' WHEN cross_folder_ratio > 0.25 THEN 'moderate' ELSE 'low' END"
_LOWER = "CASE WHEN cross_folder_ratio > 0.4 THEN 'moderate' ELSE 'low' END"
_TOP = "top AS (SELECT repo, arg_min(folder, {'n': -external_dependencies, 'f': folder}) AS top_folder FROM coupling GROUP BY repo)"
_REVIEWS = """r AS (SELECT conv_id, turn, role, (conv_id * 7 + turn * 13) % 130 AS n FROM conversations)"""

ORACLE_SQL = {
    "line_counts": with_parts(b.DOCUMENT_SQL) + "SELECT repo, rel_path, lines FROM files",
    "marker_counts": with_parts(b.DOCUMENT_SQL) + "SELECT repo, sum(todo)::BIGINT AS todo_count, sum(fixme)::BIGINT AS fixme_count FROM files GROUP BY repo",
    "path_parts": r"""WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '^[^/]*/?', '') AS rel_path FROM pages),
q AS (SELECT *, regexp_replace(rel_path, '([^/])[.][^./]+$', '\1') AS bare, trim(replace(rel_path, '\', '/'), '/') AS clean FROM p)
SELECT page_id, replace(CASE WHEN split_part(bare, '/', 1) = 'src' THEN CASE WHEN contains(bare, '/') THEN substr(bare, 5) ELSE '' END ELSE bare END, '/', '.') AS module,
CASE WHEN clean = '' THEN '.' WHEN split_part(clean, '/', 1) = 'src' THEN coalesce(nullif(split_part(clean, '/', 2), ''), '.') WHEN contains(clean, '/') THEN split_part(clean, '/', 1) ELSE '.' END AS folder,
coalesce(nullif(split_part(rel_path, '/', -1), ''), rel_path) AS name, regexp_replace(split_part(rtrim(url, '/'), '/', -1), '[.]git$', '') AS url_name FROM q""",
    "repo_totals": with_parts(b.PART_SQL) + "SELECT repo, count(*) AS total_files, sum(lines)::BIGINT AS total_lines, count(*) FILTER (lines > 500) AS total_long_files, sum(function_count)::BIGINT AS total_functions, sum(lines)::DOUBLE / count(*) AS average_lines_per_file FROM files GROUP BY repo",
    "long_files_300": with_parts(b.PART_SQL) + "SELECT repo, rel_path, lines FROM files WHERE lines > 300",
    "top3_largest": with_parts(b.PART_SQL) + "SELECT repo, rel_path, lines, row_number() OVER w AS rank FROM files WINDOW w AS (PARTITION BY repo ORDER BY lines DESC, rel_path) QUALIFY row_number() OVER w <= 3",
    "report_top15": with_parts(b.PART_SQL) + "SELECT repo, rel_path, lines, row_number() OVER w AS rank FROM files WHERE lines > 300 WINDOW w AS (PARTITION BY repo ORDER BY lines DESC, rel_path) QUALIFY row_number() OVER w <= 15",
    "size_classes": with_parts(b.PART_SQL, "t AS (SELECT repo, count(*) AS total_files, sum(lines)::BIGINT AS total_lines FROM files GROUP BY repo)", f"k AS (SELECT *, {_CLASS} AS structural_class FROM t)")
    + "SELECT repo, CASE WHEN total_files < 3 THEN 'Micro' WHEN total_files <= 10 THEN 'Small' WHEN total_files <= 50 THEN 'Medium' ELSE 'Large' END AS size, structural_class, CASE structural_class WHEN 'small_project' THEN 'size_small' WHEN 'mid_project' THEN 'size_mid' WHEN 'core_engine' THEN 'core_engine_dense_large' ELSE 'size_large' END AS rule FROM k",
    "argmax_stats": with_parts(b.PART_SQL)
    + "SELECT repo, "
    + ", ".join(f"arg_min(rel_path, {{'n': -{k}, 'p': rel_path}}) AS most_{k}_file, max({k}) AS most_{k}" for k in ("lines", "function_count", "class_count"))
    + " FROM files GROUP BY repo",
    "long_file_penalty": with_parts(b.PART_SQL) + "SELECT repo, sum(CASE WHEN lines > 800 THEN 5 WHEN lines > 500 THEN 2 ELSE 0 END)::BIGINT AS penalty FROM files GROUP BY repo",
    "edges": with_parts(_W) + "SELECT repo, src, dst, count(*) AS n FROM edges GROUP BY repo, src, dst",
    "degrees": with_parts(_W, DEGREES) + "SELECT * FROM degrees",
    "max_in_degree_file": with_parts(_W, DEGREES) + "SELECT repo, arg_min(rel_path, {'n': -in_degree, 'p': rel_path}) AS max_in_degree_file, max(in_degree) AS max_in_degree FROM degrees GROUP BY repo",
    "core_modules": with_parts(_W, DEGREES, "m AS (SELECT repo, greatest(max(in_degree), 1) AS i, greatest(max(out_degree), 1) AS o FROM degrees GROUP BY repo)")
    + "SELECT repo, rel_path AS path, in_degree, out_degree, in_degree::DOUBLE / i AS normalized_in, out_degree::DOUBLE / o AS normalized_out, (in_degree::DOUBLE / i + out_degree::DOUBLE / o) / 2.0::DOUBLE AS centrality_score FROM degrees JOIN m USING (repo) WHERE in_degree > 0 OR out_degree > 0",
    "god_modules": with_parts(_W, DEGREES, *GODS)
    + "SELECT repo, rel_path AS path, lines, in_degree, out_degree FROM g JOIN m USING (repo) WHERE lines > 800 AND degree > median",
    "bottlenecks": with_parts(_W, DEGREES, "g AS (SELECT repo, rel_path, function_count, in_degree, sum(function_count) OVER (PARTITION BY repo) AS f, sum(in_degree) OVER (PARTITION BY repo) AS i FROM degrees JOIN files USING (repo, rel_path))", "h AS (SELECT repo, rel_path AS path, function_count::DOUBLE / nullif(f, 0)::DOUBLE AS function_share, in_degree::DOUBLE / nullif(i, 0)::DOUBLE AS import_share FROM g)")
    + "SELECT * FROM h WHERE function_share >= 0.01 AND import_share >= 0.01",
    "folder_coupling": with_parts(_W, COUPLING) + "SELECT * FROM coupling",
    "cross_folder_ratio": with_parts(_W, RATIOS) + "SELECT *, total_edges > 0 AND cross_folder_ratio = 0 AS possible_import_resolution_issue FROM ratios",
    "layer_violations": with_parts(_W, *LAYERED) + VIOLATIONS,
    "scc": with_parts(_S, SCC, recursive=True) + "SELECT * FROM scc",
    "scc_over_tasks": with_parts(_W, SCC, recursive=True) + "SELECT * FROM scc",
    "cycles": with_parts(_S, SCC, recursive=True) + "SELECT repo, array_to_string(list_append(nodes, nodes[1]), ' -> ') AS cycle FROM cycles",
    "tight_pairs": with_parts(_S, SCC, recursive=True) + "SELECT repo, nodes[1] AS a, nodes[2] AS b FROM cycles WHERE n = 2",
    "cycle_analysis": with_parts(_S, SCC, recursive=True)
    + "SELECT repo, " + f"{CYCLE_TYPE} AS type, n AS length, array_to_string(nodes, ',') AS files, {CYCLE_FOLDERS} AS folders, 2 * n AS risk_score FROM cycles",
    "cycle_penalty": with_parts(_S, SCC, recursive=True) + "SELECT repo, sum(round_even(10 * ln(n) / ln(2.0::DOUBLE), 0))::BIGINT AS penalty, count(*) AS total_cycles FROM cycles GROUP BY repo",
    "coupling_level": with_parts(_S, COUPLING, RATIOS, _TOP) + f"SELECT repo, top_folder, cross_folder_ratio, {_LEVEL} AS coupling_risk_level FROM top JOIN ratios USING (repo)",
    "coupling_level_tests": with_parts(_S, COUPLING, RATIOS, _TOP) + f"SELECT repo, top_folder, cross_folder_ratio, {_LOWER} AS coupling_risk_level FROM top JOIN ratios USING (repo)",
    "growth_and_confidence": with_parts(*SCORED_SQL, score_sql(), recursive=True)
    + "SELECT repo, ((max_lines > 300)::INT + (coalesce(max_functions * 100.0 / nullif(total_functions, 0) > 40, false))::INT + (coalesce(max_in * 100.0 / nullif(total_edges, 0) > 40, false))::INT + (total_files > 2 AND coalesce(max_lines * 100.0 / nullif(total_lines, 0) > 50, false))::INT)::BIGINT AS growth_risk_score, (100 - 25 * (total_files < 5)::INT - 25 * (total_edges < 5)::INT - 25 * (total_files > 50 AND cross_folder_ratio = 0)::INT)::BIGINT AS signal_confidence FROM score",
    "architecture_score": with_parts(*SCORED_SQL, score_sql(), recursive=True) + f"SELECT {_SCORE_COLUMNS} FROM score",
    "architecture_score_custom": with_parts(*SCORED_SQL, score_sql(True), recursive=True) + f"SELECT {_SCORE_COLUMNS} FROM score",
    "benchmark_rows": with_parts(*SCORED_SQL, score_sql(), recursive=True)
    + "SELECT repo, repo AS path, total_files, total_long_files AS long_file_count, total_cycles AS cycle_count, cross_folder_ratio, 100.0::DOUBLE * cross_folder_ratio AS cross_folder_ratio_pct, architecture_health_percentage FROM score",
    "harness_metrics": with_parts(*SCORED_SQL, score_sql(), recursive=True)
    + "SELECT repo, total_files, total_lines, architecture_health_percentage, raw_score, long_file_penalty, circular_dependency_penalty, centralization_penalty, cross_folder_penalty, long_file_ratio, cycle_ratio FROM score",
    "adjusted_score": """WITH x AS (SELECT DISTINCT conv_id, turn FROM conversations)
SELECT conv_id, turn, greatest(0, least(100, (conv_id * 7 + turn * 13) % 101 - (CASE conv_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 15 ELSE 25 END) - (CASE WHEN turn % 5 >= 3 THEN 15 WHEN turn % 5 = 2 THEN 5 ELSE 0 END)
 - (CASE conv_id % 4 WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 0 END)))::BIGINT AS adjusted_score FROM x""",
    "review_lenient": with_parts(_REVIEWS) + "SELECT conv_id, turn, (CASE WHEN turn % 5 <> 4 AND n - 10 BETWEEN 0 AND 100 THEN n - 10 ELSE 0 END)::BIGINT AS architecture_score, CASE WHEN turn % 3 = 2 THEN '' ELSE role END AS key_issues, 0::BIGINT AS n_priorities FROM r",
    "review_strict": with_parts(_REVIEWS)
    + "SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'architecture_score must be an integer, got str' WHEN n - 10 NOT BETWEEN 0 AND 100 THEN 'architecture_score must be between 0 and 100, got ' || (n - 10) WHEN turn % 3 = 2 THEN 'key_issues must be an array, got str' END AS error, (CASE WHEN turn % 5 <> 4 AND n - 10 BETWEEN 0 AND 100 AND turn % 3 <> 2 THEN n - 10 END)::BIGINT AS architecture_score FROM r",
}
