"""Lists and maps of the documents are read entry by entry, whatever a document's size."""

import re

import pytest
from pyspark.sql import functions as F

from strata.operators import report
from strata.plans import documents
from tests.compare import same

SF = "/root/testdata/sf0.001"
#: Queries that once read their part out of a whole document in one row.
PARTS = ("document_core_modules", "document_folders", "document_god_modules", "document_imports", "document_layer_violations", "document_long_files")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PARTS)
def test_no_row_holds_a_whole_list(spark, monkeypatch, name):
    """Rows as SQL has them; no plan that runs collects a repository's entries, or sorts them in one task."""
    plans, kept = [], report.written
    monkeypatch.setattr(report, "written", lambda df, *a: plans.append(plan_of(df)) or kept(df, *a))

    def query(s, d):
        plans.append(plan_of(x := documents.QUERIES[name](s, d)))
        return x

    same(spark, query, documents.ORACLE_SQL[name], SF)
    for plan in plans:
        assert not re.search(r"keys=\[repo#\d+\], functions=\[[^\n]*collect_(list|set)", plan), plan
        rows = [line for line in plan.split("\n") if re.search(r"Window .*row_number", line)]
        assert not rows, rows


@pytest.mark.parametrize("name", ["document_folders", "document_layer_violations"])
def test_edges_read_once_are_not_written(spark, monkeypatch, name):
    """No copy of all edges goes to the shared folder where they are read a single time."""
    names, kept = [], documents.written
    for module in (documents, report):
        monkeypatch.setattr(module, "written", lambda df, name, *a: names.append(name) or kept(df, name, *a))
    same(spark, documents.QUERIES[name], documents.ORACLE_SQL[name], SF)
    assert "edges" not in names, names


def test_places_over_tasks(spark):
    """Entries of a repository that lie in several tasks are numbered through, by number, then names."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        i = F.col("id")
        name = F.format_string("n%04d", (i * 7919 + 3) % 3000)
        x = spark.range(3000).select(F.when(i % 10 == 0, "s").otherwise("r").alias("repo"), (-(i % 5)).cast("double").alias("k1"), F.array(name).alias("k2"), name.alias("text"))
        got = report.placed(x)
        held = {}
        for r in x.collect():
            held.setdefault(r.repo, []).append((r.k1, r.k2, r.text))
        want = {(k, p, t) for k, v in held.items() for p, (_, _, t) in enumerate(sorted(v))}
        assert {tuple(r) for r in got.select("repo", "place", "text").collect()} == want
        assert sum(f.endswith(".parquet") for f in got.inputFiles()) > 1  # over several tasks
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
