"""From source trees to reports: the audit and benchmark drivers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import graph, metrics, report, syntax
from strata.sources import pytree
from strata.storage import written


@dataclass
class Scan:
    """The tables of one scan over any number of repositories."""

    repos: DataFrame
    files: DataFrame
    stats: DataFrame
    edges: DataFrame
    config: DataFrame | None
    markers: DataFrame

    @cached_property
    def cycle(self) -> DataFrame:
        """The cycles, found once and written: scores, documents and reports read them."""
        return written(graph.cycles(graph.strong_components(self.edges)), "cycles")

    def documents(self) -> DataFrame:
        """One row a root, for documents that fit one."""
        return report.scan_documents(self.stats, self.edges, self.config, self.repos, self.markers, self.files, self.cycle)

    def write_documents(self) -> None:
        """Store the documents of all valid roots, of any size."""
        tables = report.document_tables(self.stats, self.edges, self.config, self.repos, self.markers, self.files, self.cycle)
        report.write_documents(report.document_fragments(tables))

    def overview(self) -> DataFrame:
        return report.overview(self.stats, self.edges, self.config, self.markers, self.repos, self.files, self.cycle)

    def scores(self) -> DataFrame:
        """One row per valid root, those without files included."""
        return metrics.score(metrics.repo_facts(self.stats, self.edges, self.cycle, self.config, self.repos.where("valid")))


def scan(spark: SparkSession, roots: list[str], config_name: str = pytree.CONFIG_NAME) -> Scan:
    """List and read once, parse once, and resolve imports. The parsed facts are written: everything after reads them, not the sources."""
    repos = written(pytree.repos(spark, roots), "repos")
    facts = written(syntax.file_facts(pytree.read_trees(spark, repos)), "facts")
    markers = facts.groupBy("repo").agg(F.count("*").alias("source_files"), F.sum("todo").alias("todo_count"), F.sum("fixme").alias("fixme_count"))
    readable = facts.where("parse_status <> 'unreadable'")
    edges = written(syntax.import_edges(readable), "edges")
    stats = readable.select("repo", "rel_path", "lines", "function_count", "class_count", "parse_status")
    config = written(pytree.read_config(spark, roots, config_name), "config")
    return Scan(repos, facts, stats, edges, config, markers.na.fill(0))


FILE = "lines long, function_count int, class_count int"
DOCUMENT = """source_files long, total_files long, total_lines long, todo_count long, fixme_count long,
architecture_score struct<raw_score: double, architecture_health_percentage: double, normalized_score: double,
  risk_breakdown: struct<long_file_penalty: double, circular_dependency_penalty: double, centralization_penalty: double, cross_folder_penalty: double>,
  structural_profile: struct<long_file_ratio: double, cycle_ratio: double>>"""


def stored_texts(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Stored documents of roots: repo, text, and message (why there is none to use)."""
    paths = {f"{root}/{report.FOLDER}/{report.DOCUMENT}": root for root in pytree.absolute(roots)}
    names = spark.createDataFrame(list(paths.items()), "path string, repo string")
    return pytree.read_scans(spark, list(paths)).join(names, "path").select("repo", "message", "text")


def stored_scan(spark: SparkSession, roots: list[str]) -> Scan:
    """The tables of a scan from stored documents instead of sources, each document's entries as rows; roots without one are not valid."""
    x = written(stored_texts(spark, roots), "stored")
    good = x.where("message IS NULL").select("repo", F.try_parse_json("text").alias("v"))
    files = entries(good, "per_file_stats").select("repo", F.col("key").alias("rel_path"), F.from_json(F.to_json("value"), FILE).alias("s")).select("repo", "rel_path", "s.*")
    imports = entries(good, "dependency_stats.import_map").select("repo", F.col("key").alias("src"), F.from_json(F.to_json("value"), "array<string>").alias("to"))
    edges = imports.select("repo", "src", F.explode("to").alias("dst"))
    zero = lambda c: F.coalesce(F.col(f"d.{c}"), F.lit(0)).alias(c)
    counts = ("source_files", "todo_count", "fixme_count")
    markers = x.where("message IS NULL").select("repo", F.from_json("text", ", ".join(f"{c} long" for c in counts)).alias("d")).select("repo", *map(zero, counts))
    repos = x.select("repo", F.col("repo").alias("path"), F.col("message").isNull().alias("valid"), F.regexp_replace("message", F.lit("^Invalid scan: |[.]$"), F.lit("")).alias("error"), "message")
    listed = imports.select("repo", F.col("src").alias("rel_path")).unionByName(files.select("repo", "rel_path")).distinct()
    return Scan(repos, listed, files, edges, None, markers)


def entries(documents: DataFrame, path: str) -> DataFrame:
    """(repo, key, value): the members of an object within documents (repo, v); none where it is no object."""
    member = F.try_variant_get("v", f"$.{path}", "variant")
    held = documents.select("repo", F.when(F.schema_of_variant(member).startswith("OBJECT"), member).alias("o"))
    return held.lateralJoin(held.sparkSession.tvf.variant_explode(F.col("o").outer())).select("repo", "key", "value")


def stored_metrics(spark: SparkSession, roots: list[str]) -> DataFrame:
    """The recorded metrics of stored documents; what one lacks is taken from its nearest substitute, else 0, ratios are left out."""
    x = stored_texts(spark, roots).where("message IS NULL").select("repo", F.from_json("text", DOCUMENT).alias("d"))
    first = lambda name, *fields: F.coalesce(*(F.col(f"d.{f}").cast("long") for f in fields), F.lit(0)).alias(name)
    score = "architecture_score."
    points = ("long_file_penalty", "circular_dependency_penalty", "centralization_penalty", "cross_folder_penalty")
    return x.select(
        "repo", first("total_files", "total_files", "source_files"), first("total_lines", "total_lines"),
        first("architecture_health_percentage", score + "architecture_health_percentage", score + "normalized_score"), first("raw_score", score + "raw_score"),
        *(first(k, f"{score}risk_breakdown.{k}") for k in points), *(F.col(f"d.{score}structural_profile.{k}").alias(k) for k in ("long_file_ratio", "cycle_ratio")),
    )


def audit(spark: SparkSession, root: str, with_markdown: bool = False) -> dict[str, str]:
    """Scan one repository and store its document (and Markdown); returns the texts. An invalid root stores nothing."""
    s = scan(spark, [root])
    view = written(s.overview(), "overview")  # computed once
    texts = {"summary": report.summaries(view).first()["summary"]}
    texts["table"] = "\n".join(f"{r.metric}: {r.value}" for r in report.audit_rows(view).orderBy("place").collect())
    s.write_documents()
    if with_markdown:
        report.write_per_repo(report.markdown(view), "markdown", "report.md")
    return texts


def benchmark(spark: SparkSession, roots: list[str]) -> DataFrame:
    """One row per root, by repo and path; invalid roots have an error instead of figures."""
    from strata.functions.paths import base_name

    s = scan(spark, roots)
    rows = metrics.benchmark_rows(s.scores())
    bad = s.repos.where("NOT valid").select(base_name(F.col("path")).alias("repo"), "path", "error")
    return rows.unionByName(bad, allowMissingColumns=True).orderBy("repo", "path")


def harness(spark: SparkSession, roots: list[str], store: bool = False) -> DataFrame:
    """The recorded metrics of all valid roots. With ``store`` their documents and reports are stored first, and the metrics are read from them."""
    s = scan(spark, roots)
    if not store:
        return metrics.harness_rows(s.scores())
    s.write_documents()
    report.write_per_repo(report.markdown(s.overview()), "markdown", "report.md")
    return stored_metrics(spark, roots)
