"""Boundary rows of scalar functions, held against Python where it defines them."""

import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from strata.functions import paths, rules, text
from strata.operators import review


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in rows.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_line_count(spark):
    texts = ["", "a", "a\n", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029", "a\n\n"]
    assert column(spark, texts, "string", text.line_count) == [len(t.splitlines()) for t in texts]


def test_markers(spark):
    texts = ["TODO", "todo: x", "TODOs", "_TODO", "éTODO", "TODO TODO"]
    assert column(spark, texts, "string", lambda c: text.marker_count(c, "TODO")) == [len(re.findall(r"\bTODO\b", t, re.I)) for t in texts]
    assert column(spark, ["fıxme"], "string", lambda c: text.marker_count(c, "FIXME")) == [1]


def test_module_name(spark):
    given = ["a.b.py", "d.x/m.py", ".py", "src.py", "src/__init__.py", "a/b/c.py", "src/copaw/a.py"]

    def python(p):
        parts = list(PurePosixPath(p).with_suffix("").parts)
        return ".".join(parts[1:] if parts[:1] == ["src"] else parts)

    assert column(spark, given, "string", paths.module_name) == [python(p) for p in given]


def test_top_folder(spark):
    given = ["src/copaw/a.py", "src/foo.py", "src", "foo.py", "a/b/c.py", "", "/x/y.py", "w\\z.py"]
    assert column(spark, given, "string", paths.top_folder) == ["copaw", "foo.py", ".", ".", "a", ".", "x", "w"]
    assert column(spark, ["https://h/x/repo.git/", "repo"], "string", paths.url_name) == ["repo", "repo"]


def test_sizes(spark):
    assert column(spark, [0, 2, 3, 10, 11, 50, 51], "int", rules.size_name) == ["Micro", "Micro", "Small", "Small", "Medium", "Medium", "Large"]
    rows = [(50, 50_000), (50, 50_001), (51, 1), (300, 200_000), (301, 75_249), (301, 75_250)]
    got = spark.createDataFrame(rows, "n int, l int").select(rules.structural_class(F.col("n"), F.col("l")).alias("k")).collect()
    assert [r.k for r in got] == ["small_project", "mid_project", "mid_project", "mid_project", "large_framework", "core_engine"]


def test_cycles(spark):
    n = [2, 3, 4, 5, 6, 8, 16]
    assert column(spark, n, "int", lambda c: rules.cycle_penalty(c, F.lit(10))) == [10, 16, 20, 23, 26, 30, 40]
    assert column(spark, n, "int", rules.cycle_type) == ["tight_coupling", "layer_leak", "layer_leak", "layer_leak", *["structural_cycle"] * 3]


def test_levels(spark):
    shares = [0.25, 0.2501, 0.4, 0.4001]
    assert column(spark, shares, "double", lambda c: rules.coupling_level(c, F.lit("api"))) == ["low", "moderate", "moderate", "high"]
    assert column(spark, shares, "double", lambda c: rules.coupling_level(c, F.lit("Tests"))) == ["low", "low", "low", "moderate"]
    points = lambda c: rules.cross_penalty(c, *map(F.lit, (0.2, 0.4, 10, 20)))
    assert column(spark, [0.2, 0.2001, 0.4, 0.4001], "double", points) == [0, 10, 10, 20]


@pytest.mark.parametrize(("cycles", "growth", "level", "want"), [(0, 0, "low", 50), (1, 2, "moderate", 25), (2, 3, "HIGH", 0), (2, 9, "x", 10), (0, 1, None, 50)])
def test_adjusted(spark, cycles, growth, level, want):
    x = spark.createDataFrame([(50, cycles, growth, level)], "s int, c int, g int, l string")
    assert x.select(rules.adjusted_score(*(F.col(k) for k in "scgl")).alias("r")).first().r == want


def test_reviews(spark):
    given = ['{"architecture_score": 50, "key_issues": ["a", 1], "improvement_priorities": []}', '{"architecture_score": 101, "key_issues": "x"}', '{"architecture_score": "5"}', "{", "[1]", '{"architecture_score": 5, "key_issues": null}']
    rows = spark.createDataFrame(list(enumerate(given)), "i int, answer string")
    got = review.parse_lenient(rows).orderBy("i").collect()
    assert [r.architecture_score for r in got] == [50, 0, 0, 0, 0, 5]
    assert got[0].key_issues == ["a", "1"] and got[1].key_issues == []
    errors = [r.error for r in review.parse_strict(rows).orderBy("i").collect()]
    assert errors[0] is None and errors[3] == "Invalid JSON" and errors[4] == "Expected a JSON object" and errors[5] == "Missing required key: key_issues"
    assert "between 0 and 100" in errors[1] and "integer" in errors[2]
    asked = review.ask(rows.select("i", review.simple_prompt(F.col("answer")).alias("p")), "p")
    assert {r.answer for r in asked.collect()} == {review.EMPTY_REVIEW}
    with pytest.raises(Exception, match="between 0 and 100"):
        review.require_valid(review.parse_strict(rows.where("i = 1"))).collect()


def test_review_messages_and_prompts(spark):
    answers = ['{"architecture_score": "5"}', '{"architecture_score": 1.5}', '{"architecture_score": [1]}', '{"architecture_score": 1, "key_issues": {"a": 1}}', '{"architecture_score": 1, "key_issues": [], "improvement_priorities": 7}']
    rows = spark.createDataFrame(list(enumerate(answers)), "i int, answer string")
    errors = [r.error for r in review.parse_strict(rows).orderBy("i").collect()]
    assert errors == [
        "architecture_score must be an integer, got str", "architecture_score must be an integer, got float", "architecture_score must be an integer, got list",
        "key_issues must be an array, got dict", "improvement_priorities must be an array, got int",
    ]
    text = rows.select(review.full_prompt(F.lit("SUMMARY")).alias("a"), review.full_prompt(F.lit("S"), "Only risks.").alias("b"), review.simple_prompt(F.lit("S")).alias("c")).first()
    assert text.a.endswith("Repository summary:\n\nSUMMARY") and review.FORM in text.a
    assert text.b.startswith("Only risks. Answer with ") and text.c == "Repository summary:\n\nS\n\nProvide the analysis as JSON only."
