"""Per-repository metrics: totals, classes, penalties, the health score, confidence, growth and coupling risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import rules
from strata.functions.paths import base_name, top_folder
from strata.functions.rules import ratio
from strata.operators import graph

SCORING_VERSION = "2.0"
#: Scoring keys with their types and defaults, fixed values of the scoring model.
SCORING = {
    "long_file_threshold_low": ("bigint", 500),
    "long_file_threshold_high": ("bigint", 800),
    "long_file_penalty_low": ("bigint", 2),
    "long_file_penalty_high": ("bigint", 5),
    "cycle_penalty_2_node": ("bigint", 10),
    "centralization_threshold_ratio": ("double", 0.05),
    "centralization_penalty": ("bigint", 10),
    "cross_folder_threshold_low": ("double", 0.2),
    "cross_folder_threshold_high": ("double", 0.4),
    "cross_folder_penalty_low": ("bigint", 10),
    "cross_folder_penalty_high": ("bigint", 20),
}
#: Penalty scale and least health of each structural class; fixed values.
CLASS_SCALE = {"small_project": 1.0, "mid_project": 1.0, "large_framework": 0.7, "core_engine": 0.6}
CLASS_FLOOR = {"small_project": 20, "mid_project": 20, "large_framework": 25, "core_engine": 30}
CONFIG_TYPE = (
    "layer_order array<string>, scoring struct<"
    + ", ".join(f"{k}: {t}" for k, (t, _) in SCORING.items())
    + ", structural_class_penalty_scale: map<string, double>, structural_class_health_floor: map<string, bigint>, scoring_profile: string>"
)


def settings(text: Column) -> Column:
    """A settings text as layer_order and scoring. Numbers are cast as Python's int() and float() do: texts of numbers count, and
    int() cuts fractions off. What cannot be cast is the default. No object, or an empty one, is no scoring."""
    v = F.try_parse_json(text)
    at = lambda path, kind="variant": F.try_variant_get(v, path, kind)

    def number(x: Column, kind: str) -> Column:
        said = F.regexp_replace(F.try_variant_get(x, "$", "string"), F.lit(r"(?U)^\s+|\s+$"), F.lit(""))
        plain = F.regexp_replace(said, F.lit(r"(?<=\d)_(?=\d)"), F.lit(""))  # a line between digits
        text = F.schema_of_variant(x) == "STRING"
        if kind == "double":
            special = F.regexp_replace(F.lower(plain), F.lit("^([+-]?)(infinity|inf|nan)$"), F.lit("$1$2"))
            words = F.when(special.isin("nan", "+nan", "-nan"), F.lit(float("nan"))).when(special.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf"))).when(special.isin("-inf", "-infinity"), F.lit(float("-inf")))
            number = F.when(plain.rlike(r"^[+-]?(\d+[.]?\d*|[.]\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))
            return F.when(text, F.coalesce(words, number)).otherwise(F.try_variant_get(x, "$", "double"))
        digits = F.when(plain.rlike(r"^[+-]?\d+$"), plain.try_cast("bigint"))
        cut = F.coalesce(F.try_variant_get(x, "$", "bigint"), F.try_variant_get(x, "$", "double").try_cast("bigint"))
        return F.when(text, digits).otherwise(cut)

    def each(path: str, kind: str) -> Column:
        return F.transform_values(at(path, "map<string,variant>"), lambda _, x: number(x, kind))

    fields = [number(at(f"$.scoring.{k}"), t).alias(k) for k, (t, _) in SCORING.items()]
    fields += [each("$.scoring.structural_class_penalty_scale", "double").alias("structural_class_penalty_scale"), each("$.scoring.structural_class_health_floor", "bigint").alias("structural_class_health_floor")]
    fields.append(at("$.scoring.scoring_profile", "string").alias("scoring_profile"))
    filled = F.size(at("$.scoring", "map<string,variant>")) > 0
    return F.struct(at("$.layer_order", "array<string>").alias("layer_order"), F.when(filled, F.struct(*fields)).alias("scoring"))


def per_class(kind: Column, given: Column, defaults: dict, other) -> Column:
    """A class's value: the given one unless it is missing or 0, else the default."""
    own = F.lit(other)
    for name, value in defaults.items():
        own = F.when(kind == name, value).otherwise(own)
    return F.coalesce(F.nullif(F.element_at(given, kind), F.lit(0)), own)


def with_config(repos: DataFrame, config: DataFrame | None) -> DataFrame:
    """Every repo with its scoring settings as columns: the configured ones, else the defaults."""
    if config is None:
        x = repos.withColumn("scoring", F.lit(None).cast(config_struct())).withColumn("layer_order", F.lit(None).cast("array<string>"))
    else:
        x = repos.join(config.select("repo", "layer_order", "scoring"), "repo", "left")
    for key, (kind, default) in SCORING.items():
        x = x.withColumn(key, F.coalesce(F.col("scoring")[key], F.lit(default).cast(kind)))
    filled = F.col("scoring").isNotNull()
    x = x.withColumn("scoring_mode", F.when(filled, "custom").otherwise("default"))
    profile = F.coalesce(F.nullif(F.col("scoring")["scoring_profile"], F.lit("")), F.lit("custom"))
    return x.withColumn("scoring_profile", F.when(filled, profile).otherwise("v2_default"))


def config_struct() -> str:
    return CONFIG_TYPE.split("scoring ", 1)[1]


def only_tests() -> Column:
    return F.bool_and(F.lower(top_folder(F.col("rel_path"))).isin(*rules.TEST_FOLDERS)).alias("only_tests")


def test_only(listed: DataFrame) -> DataFrame:
    """(repo, only_tests): whether every listed file, readable or not, lies in a folder of tests."""
    return listed.groupBy("repo").agg(only_tests())


def totals(stats: DataFrame, long_lines: int = 500) -> DataFrame:
    """Sums per repo. stats: repo, rel_path, lines, function_count, class_count."""
    s = stats.groupBy("repo").agg(
        F.count("*").alias("total_files"),
        F.sum(F.col("lines").cast("long")).alias("total_lines"),
        F.count_if(F.col("lines") > long_lines).alias("total_long_files"),
        F.count_if(F.col("lines") > 300).alias("long_file_count_300"),
        F.sum(F.col("function_count").cast("long")).alias("total_functions"),
        F.max("lines").alias("max_lines"),
        F.max("function_count").alias("max_functions"),
        only_tests(),
    )
    return s.withColumn("average_lines_per_file", ratio(F.col("total_lines"), F.col("total_files")))


def extremes(stats: DataFrame) -> DataFrame:
    """Per repo the file with most lines, functions and classes; ties go to the smaller path."""
    top = lambda c: F.min(F.struct((-F.col(c)).alias("n"), F.col("rel_path").alias("path"))).alias(c)
    cols = ("lines", "function_count", "class_count")
    x = stats.groupBy("repo").agg(*map(top, cols))
    return x.select("repo", *(f for c in cols for f in (F.col(c)["path"].alias(f"most_{c}_file"), (-F.col(c)["n"]).alias(f"most_{c}"))))


def repo_facts(stats: DataFrame, edges: DataFrame, cycle: DataFrame | None = None, config: DataFrame | None = None, repos: DataFrame | None = None) -> DataFrame:
    """One row per repo with everything the score needs. ``repos``: all valid ones, those without files included."""
    degree = graph.degrees(stats, edges)
    cycle = graph.cycles(graph.strong_components(edges)) if cycle is None else cycle
    x = totals(stats)
    if repos is not None:
        sums = [c for c, kind in x.dtypes if kind == "bigint"]
        x = repos.select("repo").distinct().join(x, "repo", "left").na.fill(0, sums).na.fill(0.0, ["average_lines_per_file"]).na.fill(False, ["only_tests"])
    x = with_config(x, config)
    x = x.join(graph.edge_totals(edges), "repo", "left").join(graph.max_in_degree_file(degree), "repo", "left")
    sized = cycle.select("repo", F.size("nodes").alias("n"), F.col("nodes")[0].alias("first"))
    settings = x.select("repo", "cycle_penalty_2_node", "long_file_threshold_low", "long_file_threshold_high", "long_file_penalty_low", "long_file_penalty_high")
    c = graph.with_facts(sized, settings, "first").groupBy("repo").agg(
        F.count("*").alias("total_cycles"), F.sum(rules.cycle_penalty(F.col("n"), F.col("cycle_penalty_2_node"))).alias("circular_dependency_penalty")
    )
    long = rules.long_penalty(F.col("lines"), *(F.col(f"long_file_{k}") for k in ("threshold_low", "threshold_high", "penalty_low", "penalty_high")))
    lines = graph.with_facts(stats.select("repo", "rel_path", "lines"), settings).groupBy("repo").agg(
        F.sum(long).cast("long").alias("long_file_penalty"), F.count_if(F.col("lines") > F.col("long_file_threshold_low")).alias("long_count")
    )
    x = x.join(c, "repo", "left").join(lines, "repo", "left")
    zero = ["total_edges", "cross_edges", "total_cycles", "circular_dependency_penalty", "long_file_penalty", "long_count", "max_in_degree"]
    return x.na.fill(0, zero).na.fill(0.0, ["cross_folder_ratio"]).na.fill(False, ["possible_import_resolution_issue"])


def score(facts: DataFrame) -> DataFrame:
    """Adds classes, penalties, the raw score, the health percentage and the structural profile (unrounded)."""
    c = F.col
    n = c("total_files")
    x = facts.withColumn("structural_class", rules.structural_class(n, c("total_lines")))
    x = x.withColumn("class_rule", rules.class_rule(c("structural_class")))
    x = x.withColumn("centralization_penalty", F.when(c("max_in_degree") > n * c("centralization_threshold_ratio"), c("centralization_penalty")).otherwise(0))
    cross = rules.cross_penalty(c("cross_folder_ratio"), *(c(f"cross_folder_{k}") for k in ("threshold_low", "threshold_high", "penalty_low", "penalty_high")))
    x = x.withColumn("cross_folder_penalty", cross)
    x = x.withColumn("raw_score", (c("long_file_penalty") + c("circular_dependency_penalty") + c("centralization_penalty") + c("cross_folder_penalty")).cast("long"))
    for name, top in (("long_file_ratio", "long_count"), ("cycle_ratio", "total_cycles"), ("centralization_score", "max_in_degree")):
        x = x.withColumn(name, ratio(c(top), n))
    scale = per_class(c("structural_class"), c("scoring")["structural_class_penalty_scale"], CLASS_SCALE, 1.0)
    floor = per_class(c("structural_class"), c("scoring")["structural_class_health_floor"], CLASS_FLOOR, 15)
    scaled = scale * (c("long_file_penalty") * c("long_file_ratio") + c("circular_dependency_penalty") * c("cycle_ratio")) + c("centralization_penalty") + c("cross_folder_penalty")
    health = F.rint(F.greatest(F.lit(0.0), 100.0 - scaled))
    return x.withColumn("architecture_health_percentage", F.greatest(floor.cast("double"), F.least(F.lit(100.0), health)).cast("long"))


def signal_confidence(files: str = "total_files") -> Column:
    """100 less 25 for each: few files, few imports, only test folders, a large repo without imports across folders.

    ``files``: the column with the number of files, listed ones where unreadable ones count.
    """
    c = F.col
    signs = (c(files) < 5, c("total_edges") < 5, F.coalesce(c("only_tests"), F.lit(False)), (c(files) > 50) & (c("cross_folder_ratio") == 0))
    off = sum((F.when(s, 25).otherwise(0) for s in signs), F.lit(0))
    return F.greatest(F.lit(0), F.lit(100) - off)


def growth_signs(files: str = "total_files") -> tuple[Column, ...]:
    """A long largest file, one file with over 40 % of the functions, of the imports, or over half of the lines."""
    c = F.col
    return (
        c("max_lines") > 300,
        (c("total_functions") > 0) & (c("max_functions") > 0) & (100.0 * c("max_functions") / F.nullif(c("total_functions"), F.lit(0)) > 40.0),
        (c("total_edges") > 0) & (c("max_in_degree") > 0) & (100.0 * c("max_in_degree") / F.nullif(c("total_edges"), F.lit(0)) > 40.0),
        (rules.size_name(c(files)) != "Micro") & (c("total_lines") > 0) & (100.0 * c("max_lines") / F.nullif(c("total_lines"), F.lit(0)) > 50.0),
    )


def growth_risk(files: str = "total_files") -> Column:
    return sum((F.coalesce(s, F.lit(False)).cast("int") for s in growth_signs(files)), F.lit(0))


def zero_scores(repos: DataFrame) -> DataFrame:
    """What stands in place of a score for roots that are not valid: no points and no health."""
    zero = lambda c: F.lit(0).cast("long").alias(c)
    points = ("raw_score", "architecture_health_percentage", "long_file_penalty", "circular_dependency_penalty", "centralization_penalty", "cross_folder_penalty")
    return repos.where("NOT valid").select("repo", *map(zero, points), F.lit("default").alias("scoring_mode"), F.lit("v2_default").alias("scoring_profile"))


def coupling_risk(stats: DataFrame, edges: DataFrame, tests: tuple[str, ...] = rules.TEST_FOLDERS) -> DataFrame:
    """Level per repo, lowered where its most coupled folder is a test folder."""
    coupling = graph.folder_coupling(stats, edges)
    top = coupling.groupBy("repo").agg(F.min(F.struct((-F.col("external_dependencies")).alias("n"), "folder"))["folder"].alias("top_folder"))
    x = top.join(graph.edge_totals(edges).select("repo", "cross_folder_ratio"), "repo", "left").na.fill(0.0, ["cross_folder_ratio"])
    return x.select("repo", "top_folder", "cross_folder_ratio", rules.coupling_level(F.col("cross_folder_ratio"), F.col("top_folder"), tests).alias("coupling_risk_level"))


def benchmark_rows(scored: DataFrame) -> DataFrame:
    """One line per repo for comparison; its name is the last part of ``path``."""
    return scored.select(
        base_name(F.col("repo")).alias("repo"), F.col("repo").alias("path"), "total_files",
        F.col("total_long_files").alias("long_file_count"), F.col("total_cycles").alias("cycle_count"), "cross_folder_ratio",
        (100.0 * F.col("cross_folder_ratio")).alias("cross_folder_ratio_pct"), "architecture_health_percentage",
    )


def harness_rows(scored: DataFrame) -> DataFrame:
    """The ten recorded metrics."""
    return scored.select(
        "repo", "total_files", "total_lines", "architecture_health_percentage", "raw_score", "long_file_penalty",
        "circular_dependency_penalty", "centralization_penalty", "cross_folder_penalty", "long_file_ratio", "cycle_ratio",
    )
