"""Documents and texts per repository, and the sinks that store them."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import rules
from strata.functions.paths import base_name
from strata.operators import graph, metrics
from strata.sources import sink
from strata.sources.files import opened
from strata.storage import discard, written

FOLDER = "architecture_report"
DOCUMENT = "scan.json"
TITLE = "Architecture Report"
CSV_FIELDS = (
    "repo", "url", "total_files", "total_lines", "architecture_health_percentage", "raw_score", "long_file_penalty",
    "circular_dependency_penalty", "centralization_penalty", "cross_folder_penalty", "long_file_ratio", "cycle_ratio",
)


def exact_round(x: Column, digits: int = 4) -> Column:
    """Rounds the exact binary value half to even, as Python does; at sinks only. Stays in the JVM: number formats round so, but
    for values below one unit of the last digit, which are compared with its half: no double equals that."""
    unit, half = 10.0**-digits, 5 * Decimal(10) ** (-digits - 1)
    least = float(half) if Decimal(float(half)) > half else math.nextafter(float(half), 1)  # the least double above the half
    formatted = F.regexp_replace(F.format_number(x, digits), F.lit(","), F.lit("")).try_cast("double")
    tiny = F.signum(x) * F.when(F.abs(x) >= least, unit).otherwise(0.0)
    special = F.isnan(x) | (F.abs(x) >= 1e15)  # nothing to round, or no room for the digits
    return F.when(special, x).when(F.abs(x) < unit, tiny).otherwise(formatted)


def one_decimal(x: Column) -> Column:
    """A percentage as text with one decimal."""
    return exact_round(x, 1).cast("string")


def as_map(rows: DataFrame, key: str, value: Column, name: str, paths: bool = False) -> DataFrame:
    """Per repo a map with its keys in order; with ``paths`` in that of their parts, folder by folder."""
    place = F.split(key, "/") if paths else F.array(key)
    pairs = F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col(key).alias("k"), value.alias("v"))))
    return rows.groupBy("repo").agg(F.map_from_entries(F.transform(pairs, lambda p: F.struct(p.k, p.v))).alias(name))


def as_list(rows: DataFrame, value: Column, name: str, order: Column | None = None) -> DataFrame:
    item = F.struct(value.alias("v")) if order is None else F.struct(order.alias("o"), value.alias("v"))
    return rows.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(item)), lambda p: p.v).alias(name))


@dataclass
class Tables:
    """What a document is made of: one row a repository in ``facts``, one row for each entry elsewhere. Each is made when it is first asked for."""

    stats: DataFrame
    edges: DataFrame
    config: DataFrame | None = None
    repos: DataFrame | None = None
    markers: DataFrame | None = None
    listed: DataFrame | None = None
    known: DataFrame | None = None

    @cached_property
    def nodes(self) -> DataFrame:
        return (self.stats if self.listed is None else self.listed).select("repo", "rel_path")

    @cached_property
    def long(self) -> DataFrame:
        return self.stats.where("lines > 300")

    @cached_property
    def degree(self) -> DataFrame:
        return graph.degrees(self.stats, self.edges)

    @cached_property
    def imports(self) -> DataFrame:
        deps = self.edges.groupBy("repo", F.col("src").alias("rel_path")).agg(F.array_sort(F.collect_list("dst")).alias("deps"))
        return self.nodes.join(deps, ["repo", "rel_path"], "left").select("repo", "rel_path", F.coalesce("deps", F.array().cast("array<string>")).alias("deps"))

    @cached_property
    def cycle(self) -> DataFrame:
        return graph.cycles(graph.strong_components(self.edges)) if self.known is None else self.known

    @cached_property
    def analysis(self) -> DataFrame:
        return graph.cycle_analysis(self.cycle)

    @cached_property
    def coupling(self) -> DataFrame:
        return graph.folder_coupling(self.nodes, self.edges)

    @cached_property
    def tight(self) -> DataFrame:
        return graph.tight_pairs(self.cycle)

    @cached_property
    def core(self) -> DataFrame:
        rounded = (exact_round(F.col(c)).alias(c) for c in ("normalized_in", "normalized_out", "centrality_score"))
        return graph.core_modules(self.degree).select("repo", "path", "in_degree", "out_degree", *rounded, F.col("centrality_score").alias("exact"))

    @cached_property
    def god(self) -> DataFrame:
        return graph.god_modules(self.stats, self.degree)

    @cached_property
    def violations(self) -> DataFrame | None:
        return None if self.config is None else graph.layer_violations(self.edges, self.config.where("size(layer_order) > 0").select("repo", "layer_order"))

    @cached_property
    def facts(self) -> DataFrame:
        kinds = self.analysis.groupBy("repo").agg(*(F.count_if(F.col("type") == t).cast("int").alias(f"{t}_count") for t in ("tight_coupling", "layer_leak", "structural_cycle")))
        x = metrics.score(metrics.repo_facts(self.stats, self.edges, self.cycle, self.config, None if self.repos is None else self.repos.where("valid"))).join(kinds, "repo", "left")
        x = x.na.fill(0, ["tight_coupling_count", "layer_leak_count", "structural_cycle_count"])
        if self.markers is None:
            return x.withColumns({"todo_count": F.lit(0).cast("long"), "fixme_count": F.lit(0).cast("long"), "source_files": F.col("total_files")})
        return x.join(self.markers, "repo", "left").na.fill(0, ["todo_count", "fixme_count", "source_files"])


def document_tables(stats: DataFrame, edges: DataFrame, config: DataFrame | None = None, repos: DataFrame | None = None, markers: DataFrame | None = None, listed: DataFrame | None = None, cycle: DataFrame | None = None) -> Tables:
    """``repos`` adds roots that have no files, ``listed`` files that cannot be read; ``cycle``: the cycles, where they are known."""
    return Tables(stats, edges, config, repos, markers, listed, cycle)


def _meta() -> Column:
    limits = {"SMALL_MAX_FILES": 50, "MID_MAX_FILES": 300, "SMALL_MAX_LINES": 50_000, "MID_MAX_LINES": 200_000, "CORE_ENGINE_MIN_AVG_LINES": 250.0}
    return F.struct(
        "total_files", "total_lines", exact_round(F.col("average_lines_per_file"), 2).alias("average_lines_per_file"), rules.size_rule(F.col("total_files"), F.col("total_lines")).alias("base_class"),
        F.col("class_rule").alias("rule"), F.struct(*(F.lit(v).alias(k) for k, v in limits.items())).alias("thresholds"),
    )


def _score() -> Column:
    profile = ("long_file_ratio", "cycle_ratio", "centralization_score", "cross_folder_ratio")
    return F.struct(
        "raw_score", F.col("architecture_health_percentage").alias("normalized_score"), "architecture_health_percentage", F.lit(metrics.SCORING_VERSION).alias("scoring_version"), "scoring_mode", "scoring_profile",
        F.struct("long_file_penalty", "circular_dependency_penalty", "centralization_penalty", "cross_folder_penalty").alias("risk_breakdown"),
        F.struct(*(exact_round(F.col(c)).alias(c) for c in profile)).alias("structural_profile"),
    )


def _json_text(c: str | Column) -> Column:
    """A string as JSON spells it."""
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _members(*fields: Column | str) -> Column:
    """Members of an object without its braces."""
    text = F.to_json(F.struct(*fields))
    return F.substring(text, F.lit(2), F.length(text) - 2)


#: The order of fragments: the section, then a number, then names.
FRAGMENT_ORDER = ["section", "k1", "k2"]


def _lists() -> dict[str, tuple]:
    """The document's lists and maps by name: table, text, names that order the entries, a number that goes before them; of maps the key in second place."""
    c = F.col
    s = F.struct
    by_folder = F.split("rel_path", "/")
    entry = lambda key, value: F.concat(_json_text(key), F.lit(": "), value)
    return {
        "long_files": ("long", F.to_json(s(c("rel_path").alias("path"), "lines")), F.array("rel_path")),
        "per_file_stats": ("stats", entry("rel_path", F.to_json(s("lines", "function_count", "class_count"))), by_folder),
        "import_map": ("imports", entry("rel_path", F.to_json("deps")), by_folder),
        "in_degree": ("degree", entry("rel_path", c("in_degree").cast("string")), F.array("rel_path")),
        "circular_dependencies": ("cycle", F.to_json(graph.closed("nodes")), c("nodes")),
        "cycles": ("analysis", F.to_json(s("type", "length", "files", "folders", "risk_score")), F.concat(F.array(c("type"), F.lpad(c("length").cast("string"), 20, "0")), c("files"))),
        "folder_coupling": ("coupling", entry("folder", F.to_json(s("external_dependencies", "depends_on"))), F.array("folder")),
        "tight_coupling_pairs": ("tight", F.to_json(F.array("a", "b")), F.array("a", "b")),
        "core_modules": ("core", F.to_json(s("path", "in_degree", "out_degree", "normalized_in", "normalized_out", "centrality_score")), F.array("path"), -c("exact")),
        "god_module_candidates": ("god", F.to_json(s("path", "lines", "in_degree", "out_degree")), F.array("path")),
        "layer_violations": ("violations", F.to_json(s("importer_folder", "imported_folder")), F.array("importer_folder", "imported_folder")),
    }


def document_part(t: Tables, name: str) -> DataFrame | None:
    """The entries of one list or map of the documents: (repo, k1, k2, text), a row each; None where there is no such list. Only what these need is computed."""
    table, text, names, *number = _lists()[name]
    rows = getattr(t, table)
    return None if rows is None else rows.select("repo", *(x.alias("k1") for x in number or [F.lit(0.0)]), names.alias("k2"), text.alias("text"))


def _facts_members() -> dict[str, Column]:
    """The members of a document that its repository's facts hold, by the place where they stand."""
    c = F.col
    return {
        "head": _members(c("repo").alias("path"), F.lit(True).alias("valid"), "source_files", "total_lines", "total_files", "total_long_files", F.coalesce("max_in_degree_file", F.lit("")).alias("max_in_degree_file"), F.coalesce("total_cycles", F.lit(0)).alias("total_cycles")),
        "markers": _members("todo_count", "fixme_count"),
        "kinds": _members("tight_coupling_count", "layer_leak_count", "structural_cycle_count"),
        "cross": _members(c("cross_folder_ratio").alias("cross_folder_dependency_ratio"), "possible_import_resolution_issue"),
        "class": _members("structural_class", _meta().alias("structural_class_meta"), _score().alias("architecture_score")),
    }


def document_facts(t: Tables, kind: str) -> DataFrame:
    """(repo, d): the members of the documents outside their lists, read out of the text by the type ``kind``; those within objects of the text stand beside the others."""
    text = F.concat(F.lit("{"), F.concat_ws(", ", *_facts_members().values()), F.lit("}"))
    return t.facts.select("repo", F.from_json(text, kind).alias("d"))


def placed(entries: DataFrame) -> DataFrame:
    """Entries of :func:`document_part` with ``place``, from 0, in their repository; written.

    They are sorted by ranges over all tasks, so that a repository's entries may be more than a task holds. A place is what earlier tasks hold of the
    repository, a running sum of few rows, and what comes before in its own.
    """
    order = ["repo", *FRAGMENT_ORDER[1:]]
    x = entries.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    x = written(x.select("repo", "text", "at", F.shiftright("at", 33).alias("task")), "entries")
    earlier = Window.partitionBy("repo").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy("repo", "task").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    sums = sums.select("repo", "task", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return x.join(sums, ["repo", "task"]).select("repo", (F.col("at") + F.col("shift")).alias("place"), "text")


def document_fragments(t: Tables, repos: DataFrame | None = None) -> DataFrame:
    """The documents as fragments (repo, section, k1, k2, kind, text): in that order they are the JSON text of each.

    No row holds more than one entry, so documents may be larger than any row or task. ``repos`` adds the documents of roots that are not valid.
    """
    s = F.struct
    facts = _facts_members()
    plan: list = [
        ("open", "{"), ("item", facts["head"]), ("[", "long_files"), ("item", facts["markers"]), ("{", "per_file_stats"),
        ("open", '"dependency_stats": {'), ("{", "import_map"), ("{", "in_degree"), ("[", "circular_dependencies"),
        ("open", '"cycle_analysis": {'), ("item", facts["kinds"]), ("[", "cycles"), ("close", "}"),
        ("{", "folder_coupling"), ("item", facts["cross"]), ("close", "}"),
        ("open", '"architectural_risks": {'), ("[", "tight_coupling_pairs"), ("[", "core_modules"), ("[", "god_module_candidates"), ("[", "layer_violations"), ("close", "}"),
        ("item", facts["class"]), ("close", "}"),
    ]
    own, rows = [], []  # fragments of the facts' rows; tables of entries
    none = F.array().cast("array<string>")

    def fixed(kind: str, text: Column | str) -> None:
        own.append(s(F.lit(len(own) + len(rows)).alias("section"), F.lit(kind).alias("kind"), (F.lit(text) if isinstance(text, str) else text).alias("text")))

    for kind, what in plan:
        if kind not in ("[", "{"):
            fixed(kind, what)
            continue
        fixed("open", f'"{what}": {kind}')
        part = document_part(t, what)
        if part is not None:
            rows.append(part.select("repo", F.lit(len(own) + len(rows)).alias("section"), "k1", "k2", F.lit("item").alias("kind"), "text"))
        fixed("close", "]" if kind == "[" else "}")
    out = t.facts.select("repo", F.inline(F.array(*own))).select("repo", "section", F.lit(0.0).alias("k1"), none.alias("k2"), "kind", "text")
    for part in rows:
        out = out.unionByName(part)
    if repos is not None:
        bad = repos.where("NOT valid").select("repo", F.lit(0).alias("section"), F.lit(0.0).alias("k1"), none.alias("k2"), F.lit("item").alias("kind"), F.to_json(s("path", "valid", "error")).alias("text"))
        out = out.unionByName(bad)
    return out


def scan_documents(stats: DataFrame, edges: DataFrame, config: DataFrame | None = None, repos: DataFrame | None = None, markers: DataFrame | None = None, listed: DataFrame | None = None, cycle: DataFrame | None = None) -> DataFrame:
    """One row per repo: ``document``, the nested scan result, for repositories that fit a row; arguments as in :func:`document_tables`. Roots that are not valid are there, too."""
    t = document_tables(stats, edges, config, repos, markers, listed, cycle)
    s = lambda *c: F.struct(*c)
    parts = [
        as_map(t.stats, "rel_path", s("lines", "function_count", "class_count"), "per_file_stats", paths=True),
        as_list(t.long, s(F.col("rel_path").alias("path"), "lines"), "long_files"),
        as_map(t.imports, "rel_path", F.col("deps"), "import_map", paths=True),
        as_map(t.degree, "rel_path", F.col("in_degree"), "in_degree"),
        as_list(t.cycle, graph.closed("nodes"), "circular_dependencies", F.col("nodes")),
        as_list(t.analysis, s("type", "length", "files", "folders", "risk_score"), "cycles"),
        as_map(t.coupling, "folder", s("external_dependencies", "depends_on"), "folder_coupling"),
        as_list(t.tight, F.array("a", "b"), "tight_coupling_pairs"),
        as_list(t.core, s("path", "in_degree", "out_degree", "normalized_in", "normalized_out", "centrality_score"), "core_modules", s(-F.col("exact"), F.col("path"))),
        as_list(t.god, s("path", "lines", "in_degree", "out_degree"), "god_module_candidates"),
    ]
    if t.violations is not None:
        parts.append(as_list(t.violations, s("importer_folder", "imported_folder"), "layer_violations"))
    x = t.facts
    for part in parts:
        x = x.join(part, "repo", "left")
    if t.violations is None:
        x = x.withColumn("layer_violations", F.lit(None).cast("array<struct<importer_folder: string, imported_folder: string>>"))
    for c, kind in x.dtypes:
        if kind.startswith("array") and c != "layer_order":
            x = x.withColumn(c, F.coalesce(c, F.array().cast(kind)))
    kinds = dict(x.dtypes)
    for c in ("per_file_stats", "import_map", "in_degree", "folder_coupling"):
        x = x.withColumn(c, F.coalesce(c, F.create_map().cast(kinds[c])))
    document = s(
        F.col("repo").alias("path"), F.lit(True).alias("valid"), "source_files", "total_lines", "total_files", "total_long_files",
        F.coalesce("max_in_degree_file", F.lit("")).alias("max_in_degree_file"), "total_cycles", "long_files", "todo_count", "fixme_count", "per_file_stats",
        s("import_map", "in_degree", "circular_dependencies", s("tight_coupling_count", "layer_leak_count", "structural_cycle_count", "cycles").alias("cycle_analysis"),
          "folder_coupling", F.col("cross_folder_ratio").alias("cross_folder_dependency_ratio"), "possible_import_resolution_issue").alias("dependency_stats"),
        s("tight_coupling_pairs", "core_modules", "god_module_candidates", "layer_violations").alias("architectural_risks"),
        "structural_class", _meta().alias("structural_class_meta"), _score().alias("architecture_score"),
    )
    out = x.select("repo", F.to_json(document, {"pretty": "true"}).alias("document"))
    if repos is None:
        return out
    bad = repos.where("NOT valid").select("repo", F.to_json(s("path", "valid", "error"), {"pretty": "true"}).alias("document"))
    return out.unionByName(bad)


def write_documents(fragments: DataFrame) -> None:
    """Store documents, from their fragments, below their roots; roots that are not there are left out. A document may be of any size."""
    held = written(fragments, "fragments")
    path = F.concat("repo", F.lit(f"/{FOLDER}/{DOCUMENT}"))
    sink.write_fragments(held.withColumns({"root": F.col("repo"), "path": path}), FRAGMENT_ORDER)
    discard(held)


def yes(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "Yes").otherwise("No")


def told(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def lines_of(items: Column, form) -> Column:
    return F.transform(items, form)


def overview(stats: DataFrame, edges: DataFrame, config: DataFrame | None = None, markers: DataFrame | None = None, repos: DataFrame | None = None, listed: DataFrame | None = None, cycle: DataFrame | None = None) -> DataFrame:
    """One row per repo with every value that the text reports print; arguments as in :func:`document_tables`, of invalid roots only repo, ``error`` and ``message``."""
    degree = graph.degrees(stats, edges)
    cycle = graph.cycles(graph.strong_components(edges)) if cycle is None else cycle
    nodes = stats if listed is None else listed
    x = metrics.score(metrics.repo_facts(stats, edges, cycle, config, None if repos is None else repos.where("valid")))
    largest = graph.top_rows(stats, 15, F.desc("lines"), "rel_path").select("repo", "rank", "rel_path", "lines")
    if listed is not None:  # files that cannot be read count where folders are looked at
        x = x.drop("only_tests").join(metrics.test_only(listed), "repo", "left").na.fill(False, ["only_tests"])
    coupled = graph.folder_coupling(nodes, edges)
    coupled = graph.top_rows(coupled, 10, F.desc("external_dependencies"), "folder").select("repo", "rank", "folder", "external_dependencies")
    long = long_files_by_path(stats)
    parts = [
        metrics.extremes(stats),
        as_list(long, F.struct("rel_path", "lines"), "long_by_path", F.col("rank")),
        as_list(largest, F.struct("rel_path", "lines"), "largest", F.col("rank")),
        as_list(coupled, F.struct("folder", "external_dependencies"), "coupled", F.col("rank")),
        as_list(graph.bottlenecks(stats, degree), F.col("path"), "bottlenecks"),
        as_list(cycle, graph.closed("nodes"), "circular", F.col("nodes")),
    ]
    parts += [markers] if markers is not None else []
    for part in parts:
        x = x.join(part, "repo", "left")
    if markers is None:
        x = x.withColumns({"todo_count": F.lit(0).cast("long"), "fixme_count": F.lit(0).cast("long"), "source_files": F.col("total_files")})
    x = x.na.fill(0, ["todo_count", "fixme_count", "source_files"])
    x = x.withColumn("coupling_base", rules.coupling_base(F.col("cross_folder_ratio")))
    top = F.col("coupled")[0]["folder"]
    x = x.withColumn("coupling_risk_level", F.when(F.size("coupled") > 0, rules.coupling_level(F.col("cross_folder_ratio"), top)).otherwise("low"))
    x = x.withColumns({"error": F.lit(None).cast("string"), "message": F.lit(None).cast("string")})
    if repos is None:
        return x
    message = F.col("message") if "message" in repos.columns else told("Invalid scan: ", F.coalesce("error", F.lit("Unknown error")), ".")
    return x.unionByName(repos.where("NOT valid").select("repo", "error", message.alias("message")), allowMissingColumns=True)


def long_files_by_path(stats: DataFrame, n: int = 10) -> DataFrame:
    """The first n long files of each repo by path."""
    return graph.top_rows(stats.where("lines > 300"), n, "rel_path").select("repo", "rank", "rel_path", "lines")


def summaries(view: DataFrame) -> DataFrame:
    """The text summary of each repo, from :func:`overview`."""
    c = F.col
    pct = lambda a, b: one_decimal(100.0 * a / F.nullif(b, F.lit(0)))
    none = F.lit(None).cast("array<string>")
    some = lambda condition, *items: F.when(condition, F.array(*items)).otherwise(none)
    growth = metrics.growth_risk("source_files")
    signs = metrics.growth_signs("source_files")
    named = ("  Largest file > 300 lines: ", "  Function share > 40%: ", "  Dependency fan-in share > 40%: ", "  Small+ project dominated by one file (>50% lines): ")
    lowered = c("coupling_base") != c("coupling_risk_level")
    label = F.when(c("coupling_risk_level") == "high", "High coupling risk").when(c("coupling_risk_level") == "moderate", "Moderate coupling").otherwise("Low coupling")
    label = F.concat(label, F.when(lowered, " (dominated by tests/benchmarks)").otherwise(""))
    confidence = metrics.signal_confidence("source_files")
    share = one_decimal(100.0 * c("cross_folder_ratio"))
    blocks = [
        F.array(
            told("Repository: ", c("repo")), told("Project size: ", rules.size_name(c("source_files")), " (", c("source_files"), " source files)"), told("Total files: ", c("source_files")),
            told("Total lines: ", c("total_lines")), told("Total functions: ", c("total_functions")), told("TODO count: ", c("todo_count")), told("FIXME count: ", c("fixme_count")),
            told("Long files (>300 lines): ", c("long_file_count_300")),
        ),
        some(c("total_lines") > 0, told("Largest file share of total lines: ", pct(c("most_lines"), c("total_lines")), "%")),
        some((c("total_functions") > 0) & (c("most_function_count") > 0), told("Most function-heavy file share of total functions: ", pct(c("most_function_count"), c("total_functions")), "%")),
        F.concat(F.array(F.lit(""), F.lit("Top largest files:")), lines_of(F.slice("largest", 1, 3), lambda e: told("  ", e.rel_path, ": ", e.lines, " lines"))),
        some(c("most_function_count") > 0, F.lit(""), told("Most functions: ", c("most_function_count_file"), " (", c("most_function_count"), ")")),
        some(c("max_in_degree") > 0, F.lit(""), told("Most depended-on file: ", c("max_in_degree_file"), " (in-degree ", c("max_in_degree"), ", ", pct(c("max_in_degree"), c("total_edges")), "% of internal imports)")),
        F.array(F.lit(""), told("Growth risk indicators: ", growth, "/4 triggered"), told("  growth_risk_score: ", growth), *(told(n, yes(s)) for n, s in zip(named, signs, strict=True))),
        F.when(
            F.size("coupled") > 0,
            F.concat(
                F.array(
                    F.lit(""), F.lit("Folder-level coupling:"), told("- Cross-folder dependency ratio: ", share, "% (", label, ")"),
                    told("- Top most coupled folder: ", c("coupled")[0]["folder"], " (", c("coupled")[0]["external_dependencies"], " external folders)"), F.lit("- Most externally dependent folders:"),
                ),
                lines_of(F.slice("coupled", 1, 3), lambda e: told("  - ", e.folder, ": ", e.external_dependencies, " external folders")),
                F.when(lowered, F.array(F.lit("High coupling driven primarily by test modules; production architecture impact likely limited."))).otherwise(F.array().cast("array<string>")),
                F.array(told("coupling_risk_level: ", c("coupling_risk_level"))),
            ),
        ),
        F.array(F.lit(""), told("Signal confidence: ", confidence, "%")),
        some(confidence < 50, F.lit("Architecture signal weak due to insufficient structural data.")),
        F.when(F.size("bottlenecks") > 0, F.concat(F.array(F.lit(""), F.lit("Potential architectural bottleneck(s) (high function share and high dependency share):")), lines_of(c("bottlenecks"), lambda p: told("  ", p)))),
        F.when(F.size("circular") > 0, F.concat(F.array(F.lit(""), F.lit("Circular dependencies detected:")), lines_of(c("circular"), lambda n: told("  ", F.array_join(n, " -> "))))).otherwise(F.array(F.lit(""), F.lit("No circular dependencies detected."))),
        some(c("most_class_count") > 0, F.lit(""), told("Most classes: ", c("most_class_count_file"), " (", c("most_class_count"), ")")),
    ]
    empty = F.array().cast("array<string>")
    text = F.array_join(F.concat(*(F.coalesce(b, empty) for b in blocks)), "\n")
    return view.select("repo", F.coalesce("message", text).alias("summary"))


def markdown(view: DataFrame, title: str = TITLE) -> DataFrame:
    """The Markdown report of each repo, from :func:`overview`."""
    c = F.col
    long = F.filter("largest", lambda e: e.lines > 300)
    empty = F.array().cast("array<string>")
    text = F.concat(
        F.array(
            F.lit(f"# {title}"), F.lit(""), F.lit("## Summary"), told("- **Project size:** ", rules.size_name(c("source_files")), " (", c("source_files"), " source files)"),
            told("- **Total lines:** ", c("total_lines")), told("- **Total files:** ", c("source_files")), told("- **Signal confidence:** ", metrics.signal_confidence("source_files"), "%"),
            told("- **Architecture score (deterministic):** ", c("architecture_health_percentage")), F.lit(""), F.lit("## Growth Risks"), told("- **Growth risk indicators:** ", metrics.growth_risk("source_files"), "/4 triggered"),
        ),
        F.when(F.size(long) > 0, F.concat(F.array(F.lit("- **Long files (>300 lines):**")), lines_of(long, lambda e: told("  - `", e.rel_path, "` (", e.lines, " lines)")))).otherwise(F.array(F.lit("- **Long files:** None"))),
        F.array(F.lit(""), F.lit("## Coupling Analysis"), told("- **Cross-folder dependency ratio:** ", one_decimal(100.0 * c("cross_folder_ratio")), "%"), told("- **Coupling risk level:** ", c("coupling_risk_level"))),
        F.when(F.size("coupled") > 0, F.concat(F.array(F.lit("- **Top coupled folders:**")), lines_of(c("coupled"), lambda e: told("  - `", e.folder, "`: ", e.external_dependencies, " external folders")))).otherwise(empty),
        F.array(F.lit(""), F.lit("## Key Issues"), F.lit("- None reported."), F.lit("")),
    )
    return view.where("message IS NULL").select("repo", F.array_join(text, "\n").alias("markdown"))


def audit_rows(view: DataFrame) -> DataFrame:
    """What an audit prints per repo: metric and value in order, with the first ten long files by path; of invalid roots status and error."""
    c = F.col
    good = c("message").isNull()
    shown = F.array_join(F.transform("long_by_path", lambda e: told(e.rel_path, " (", e.lines, ")")), ", ")
    more = c("long_file_count_300") - 10
    pairs = [
        ("Status", F.when(~good, "Invalid")), ("Error", c("error")), ("Path", F.when(good, c("repo"))), ("Source files", c("source_files")), ("Total lines", c("total_lines")), ("Structural class", c("structural_class")), ("TODO", c("todo_count")), ("FIXME", c("fixme_count")),
        ("Files > 300 lines", F.when(c("long_file_count_300") > 0, F.concat(shown, F.when(more > 0, told(" … +", more, " more")).otherwise("")))),
        ("Raw score", c("raw_score")), ("Normalized score", c("architecture_health_percentage")), ("Long file penalty", c("long_file_penalty")), ("Circular dependency penalty", c("circular_dependency_penalty")),
        ("Centralization penalty", c("centralization_penalty")), ("Cross-folder penalty", c("cross_folder_penalty")),
    ]
    rows = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(k).alias("metric"), v.cast("string").alias("value")) for i, (k, v) in enumerate(pairs)))
    return view.select("repo", F.inline(rows)).where("value IS NOT NULL")


def write_per_repo(rows: DataFrame, column: str, name: str, folder: str = FOLDER) -> None:
    """Store one text per repo below its root, which must exist: invalid roots are never created."""
    sink.write_texts(rows, "repo", column, f"{folder}/{name}")


def results_table(harness: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """Harness rows in the fixed columns of the results file, by name; what is missing is empty."""
    x = harness.join(urls, "repo", "left") if urls is not None else harness.withColumn("url", F.lit(None).cast("string"))
    x = x.withColumn("repo", base_name(F.col("repo")))
    return x.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CSV_FIELDS)).orderBy("repo")


def _csv_line(fields: list[Column]) -> Column:
    quoted = lambda v: F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    return F.concat(F.concat_ws(",", *map(quoted, fields)), F.lit("\r\n"))


def _folder_of(path: str) -> tuple[str, str]:
    """The path and its folder, made where it is missing."""
    path = path if "://" in path else os.path.abspath(path)
    folder = path.rpartition("/")[0]
    fs, inner = opened(folder)
    fs.create_dir(inner, recursive=True)
    return path, folder


def write_results(harness: DataFrame, path: str, append: bool = False, urls: DataFrame | None = None) -> int:
    """The results as one CSV file, a line per repository; with ``append`` the file is replaced by itself and the new lines, without a second
    header. Nothing is written for no rows. Returns the number of rows."""
    rows = written(results_table(harness, urls), "results")
    n = rows.count()
    if n:
        path, folder = _folder_of(path)
        x = rows.select(F.lit(folder).alias("root"), F.lit(path).alias("path"), "repo", F.lit("line").alias("kind"), _csv_line([F.col(c) for c in CSV_FIELDS]).alias("text"))
        sink.write_fragments(x, ["repo", "text"], header=",".join(CSV_FIELDS) + "\r\n", append=append)
    discard(rows)
    return n


def write_summary(harness: DataFrame, path: str) -> None:
    """The metrics of all repositories as one JSON array, by name."""
    path, folder = _folder_of(path)
    x = harness.withColumnRenamed("repo", "path").withColumn("repo", base_name(F.col("path")))
    item = F.to_json(F.struct("repo", *(c for c in x.columns if c != "repo")), {"ignoreNullFields": "false"})
    rows = x.select(F.lit(1).alias("section"), "repo", F.col("path").alias("of"), F.lit("item").alias("kind"), item.alias("text"))
    ends = [(0, "", "", "open", "["), (2, "", "", "close", "]")]
    rows = rows.unionByName(harness.sparkSession.createDataFrame(ends, "section int, repo string, of string, kind string, text string"))
    sink.write_fragments(rows.withColumns({"root": F.lit(folder), "path": F.lit(path)}), ["section", "repo", "of"])


def benchmark_table(rows: DataFrame) -> DataFrame:
    """Benchmark rows as texts for display, by repo and path; rows with an error show a dash for every figure, and the error in place of the score."""
    figure = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    pct = one_decimal(F.col("cross_folder_ratio_pct"))
    return rows.orderBy("repo", "path").select(
        "repo", figure(F.col("total_files")).alias("Files"), figure(F.col("long_file_count")).alias("LongFiles"), figure(F.col("cycle_count")).alias("Cycles"),
        figure(pct).alias("CrossFolder%"), figure(F.coalesce("error", F.col("architecture_health_percentage").cast("string"))).alias("Score"),
    )
