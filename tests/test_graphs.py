"""Components of large graphs, joins by repository, medians, first rows, rounding."""

import random
import re
from decimal import ROUND_HALF_EVEN, Decimal
from statistics import median_high

import pytest
from pyspark.sql import functions as F

from strata.operators import graph, metrics, report
from strata.plans import scan as plans
from strata.storage import shared_dir
from tests.test_scan import tree


def edges_of(spark, pairs, repo="r"):
    return spark.createDataFrame([(repo, a, b) for a, b in pairs], "repo string, src string, dst string")


def shared_folders(spark):
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return {f.getPath().getName() for f in fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs)}


def test_components_agree(spark):
    """Over all tasks as in one; nothing but the result stays behind."""
    r = random.Random(7)
    pairs = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(60)] + [("z", "z"), ("y", "z")]
    pairs += [(f"f{k}/a{i}", f"f{k}/a{(i + 1) % 6}") for k in range(4) for i in range(6)] + [("f0/a0", "f1/a1"), ("f1/a3", "f2/a2"), ("f2/a4", "f0/a5"), ("f2/a1", "f3/a0")]
    df = edges_of(spark, pairs).unionByName(edges_of(spark, pairs[:30], "s"))
    small = sorted(map(tuple, graph.strong_components(df).collect()))
    before = shared_folders(spark)
    large = graph.strong_components(df, local_edges=0, part_edges=5)
    left = shared_folders(spark) - before
    assert sorted(map(tuple, large.collect())) == small and len(left) == 1 and "scc-components" in left.pop()


def test_condensed_graph_is_solved_in_one_task(spark):
    """Folders condense where they lie; what is left fits the bound of a task, and no round is needed."""
    n = 30
    pairs = [(f"p{k:03}/m{i}", f"p{k:03}/m{(i + 1) % n}") for k in range(40) for i in range(n)] + [(f"p{k:03}/m0", f"p{(k + 1) % 40:03}/m1") for k in range(40)]
    log: list[str] = []
    got = graph.strong_components(edges_of(spark, pairs), local_edges=200, part_edges=200, log=log)
    assert {r.component for r in got.collect()} == {"p000/m0"} and got.count() == 40 * n and log == []


def test_rounds_of_a_ring(spark):
    """A ring that no task can condense takes rounds in the order of its length's logarithm, whatever its nodes are called."""
    n = 100_000
    ids = spark.range(n).select(F.col("id").alias("i"), F.format_string("n%06d", n - F.col("id")).alias("p"))
    ring = ids.select("i", F.col("p").alias("src")).join(ids.select(F.pmod(F.col("i") - 1, F.lit(n)).alias("i"), F.col("p").alias("dst")), "i")
    log: list[str] = []
    got = graph.strong_components(ring.select(F.lit("r").alias("repo"), "src", "dst"), local_edges=0, part_edges=n // 4, log=log)
    assert got.select("component").distinct().collect() == [("n000001",)] and got.count() == n
    assert len(log) <= 100, len(log)


def test_a_single_repository_is_dealt_out(spark):
    """With all files in one repository no rows are exchanged by repo alone: only sums, of which each task has one a repository."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = F.concat(F.lit("r"), F.col("id") % 1)
        stats = spark.range(500).select(one.alias("repo"), F.concat(F.lit("a/f"), "id").alias("rel_path"), (F.col("id") * 7 % 900).alias("lines"), F.col("id").cast("int").alias("function_count"), F.lit(1).alias("class_count"))
        edges = spark.range(900).select(one.alias("repo"), F.concat(F.lit("a/f"), F.col("id") % 500).alias("src"), F.concat(F.lit("a/f"), F.col("id") * 3 % 500).alias("dst"))
        degree = graph.degrees(stats, edges)
        cycle = graph.cycles(edges.where("false").select("repo", F.col("src").alias("component"), F.col("src").alias("rel_path")))
        for made in (graph.core_modules(degree), graph.god_modules(stats, degree), graph.bottlenecks(stats, degree, 0.001), metrics.repo_facts(stats, edges, cycle)):
            plan = made._jdf.queryExecution().executedPlan().toString().split("\n")
            for i, line in enumerate(plan):
                if re.search(r"Exchange hashpartitioning\(repo#\d+, \d+\)", line):
                    feeds = next(x for x in plan[i + 1 :] if "Project" not in x)
                    assert re.search("Aggregate|Generate|WindowGroupLimit|Union", feeds), (line, feeds)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_salted_join_is_the_join(spark):
    rows = spark.range(1000).select(F.concat(F.lit("r"), F.col("id") % 3).alias("repo"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("rel_path"))
    facts = spark.createDataFrame([("r0", 1), ("r2", 2), ("r9", 3)], "repo string, v int")
    key = lambda x: sorted(map(tuple, x.select("repo", "rel_path", "v").collect()), key=repr)
    assert key(graph.with_facts(rows, facts)) == key(rows.join(facts, "repo"))


def test_upper_median(spark):
    r = random.Random(2)
    groups = {f"g{n}": [r.randrange(6) for _ in range(n)] for n in range(1, 40)}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "repo string, degree long")
    assert {x.repo: x.median for x in graph.upper_median(df, "degree").collect()} == {g: median_high(v) for g, v in groups.items()}


def test_first_rows_are_cut_before_the_exchange(spark):
    one = F.concat(F.lit("r"), F.col("id") % 1)
    df = spark.range(10_000).select(one.alias("repo"), F.col("id").alias("lines"), F.col("id").cast("string").alias("rel_path")).repartition(4)
    top = graph.top_rows(df, 3, F.desc("lines"), "rel_path")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit", plan.index("Exchange hashpartitioning(repo")) > 0 and "Partial" in plan
    assert [r.lines for r in top.orderBy("rank").collect()] == [9999, 9998, 9997]


def test_rounding_is_pythons(spark):
    """All ratios up to 400, ties in binary and decimal, large and odd values."""
    values = [a / b for b in range(1, 401) for a in range(b + 1)]
    values += [x * k for x in (0.5, 0.25, 0.125, 0.00005, 0.00015, 0.03125, 1.00005, 2.675, 1e-5, 4.99995) for k in (1, -1, 3, 7, 1001)] + [0.0, -0.0, 1e14 + 0.5, 1e22, 12345678.00005, -1234567.125]
    r = random.Random(3)
    values += [r.uniform(0, 100) for _ in range(5000)] + [r.randrange(10**6) / 2**14 for _ in range(5000)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    for digits in (4, 2, 1):
        got = {x.i: x.r for x in df.select("i", report.exact_round(F.col("v"), digits).alias("r")).collect()}
        assert all(got[i] == round(v, digits) == float(Decimal(v).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN)) for i, v in enumerate(values) if abs(v) < 1e15), digits
        assert got[values.index(1e22)] == 1e22
    odd = spark.createDataFrame([(0, None), (1, float("nan"))], "i int, v double").select("i", report.exact_round(F.col("v")).alias("r"))
    assert [str(r.r) for r in odd.orderBy("i").collect()] == ["None", "nan"]


def test_documents_have_no_python(spark):
    stats = spark.createDataFrame([("r", "a.py", 1, 1, 1)], "repo string, rel_path string, lines long, function_count int, class_count int")
    edges = edges_of(spark, [("a.py", "a.py")])
    cycle = spark.createDataFrame([], "repo string, nodes array<string>")
    for made in (report.scan_documents(stats, edges, cycle=cycle), report.document_fragments(report.document_tables(stats, edges, cycle=cycle)), report.summaries(report.overview(stats, edges, cycle=cycle))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_numbers_in_settings_to_the_end(spark):
    """Numbers as Python reads them: lines between digits, exponents, signs, whole numbers beyond 32 bits."""
    kinds = {"cross_folder_threshold_low": ("0_1", "1e-1", " +.5 ", "5.", "1_0.2_5", "inf", "0x1", "1__0", "_1", "1f", "", "nan "), "cycle_penalty_2_node": (3_000_000_000, "3_000_000_000", "-7", "+8", 1e3, "1e3", "1.5", True)}
    default = {"cross_folder_threshold_low": 0.2, "cycle_penalty_2_node": 10}
    for key, given in kinds.items():
        import json

        rows = [(str(i), json.dumps({"scoring": {key: v}})) for i, v in enumerate(given)]
        x = spark.createDataFrame(rows, "repo string, text string").select("repo", metrics.settings(F.col("text")).alias("c")).select("repo", "c.*")
        got = {r.repo: r[key] for r in metrics.with_config(spark.createDataFrame([(r[0],) for r in rows], "repo string"), x).collect()}
        for i, v in enumerate(given):
            try:
                want = (float if key.startswith("cross") else int)(v)
            except ValueError:
                want = default[key]
            assert repr(got[str(i)]) == repr(want), (key, v)


def test_folders_of_unreadable_files(spark, tmp_path):
    """A folder whose files cannot be read is in the summary as in the document, and counts for test-only repositories."""
    root = tree(tmp_path, {"a/x.py": "import tests.t\n", "tests/t.py": ""})
    s = plans.scan(spark, [root])
    listed = s.files.select("repo", "rel_path").unionByName(spark.createDataFrame([(root, "b/y.py")], "repo string, rel_path string"))
    s.files = listed
    text = report.summaries(s.overview()).first().summary
    assert "  - b: 0 external folders" in text and "  - a: 1 external folders" in text
    only = lambda files: report.overview(s.stats.where("rel_path LIKE 'tests/%'"), s.edges.where("false"), s.config, s.markers, s.repos, files, s.cycle).first().only_tests
    assert only(listed.where("rel_path LIKE 'tests/%'")) is True and only(listed) is False


def test_error_in_the_table(spark):
    rows = spark.createDataFrame([("b", "/b", 3, 1, 0, 12.25, 77, None), ("a", "/a", None, None, None, None, None, "Not a directory")], "repo string, path string, total_files long, long_file_count long, cycle_count long, cross_folder_ratio_pct double, architecture_health_percentage long, error string")
    assert [tuple(r) for r in report.benchmark_table(rows).collect()] == [("a", "-", "-", "-", "-", "Not a directory"), ("b", "3", "1", "0", "12.2", "77")]
