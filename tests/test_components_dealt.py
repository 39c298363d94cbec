"""Components of repositories of very different sizes, none of whose edges are brought together in one task."""

import random
import re

from strata.operators import graph
from strata.plans import bridge


def test_no_task_reads_a_repository(spark, monkeypatch):
    """With one repository over the bound and one below it: the same rows as in one task each, and no join by repository alone in any plan that runs."""
    r = random.Random(11)
    large = [("r", f"n{r.randrange(60):02}", f"n{r.randrange(60):02}") for _ in range(90)] + [("r", "own", "own")]
    small = [("s", "a", "b"), ("s", "b", "a"), ("s", "b", "c"), ("s", "c", "d"), ("s", "z", "z")]
    df = spark.createDataFrame(large + small, "repo string, src string, dst string")
    want = sorted(map(tuple, graph.strong_components(df).collect()))
    plans, kept = [], graph.written
    monkeypatch.setattr(graph, "written", lambda x, *a: plans.append(x._jdf.queryExecution().executedPlan().toString()) or kept(x, *a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for bound, part in ((20, 1000), (20, 7), (4, 3)):
            got = graph.strong_components(df, local_edges=bound, part_edges=part)
            plans.append(got._jdf.queryExecution().executedPlan().toString())
            assert sorted(map(tuple, got.select("repo", "component", "rel_path").collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for plan in plans for line in plan.split("\n") if re.search(r"(SortMerge|ShuffledHash)Join", line)]
    assert joins and not [j for j in joins if re.search(r"Join \[repo#\d+\], \[repo#\d+\]", j)]


def test_dense_edges_take_no_round(spark, monkeypatch):
    """Dense parts whose names mix, so that no task holds a cycle: the rounds of joins see a few edges of every node, and the rows are those of one task."""
    r = random.Random(5)
    pairs = {(f"n{i:02}-{k}", f"n{j:02}-{k}") for k in range(8) for i in range(24) for j in range(24) if r.random() < 0.6} | {("n00-0", "n00-1"), ("n01-1", "n01-2"), ("n02-2", "n02-1"), ("own", "own")}
    df = spark.createDataFrame([("r", a, b) for a, b in sorted(pairs)], "repo string, src string, dst string")
    want = sorted(map(tuple, graph.strong_components(df).collect()))
    seen, kept = [], graph.least_reaching
    monkeypatch.setattr(graph, "least_reaching", lambda nodes, edges, *a, **b: seen.append(edges.count()) or kept(nodes, edges, *a, **b))
    got = graph.strong_components(df, local_edges=0, part_edges=40)
    assert sorted(map(tuple, got.select("repo", "component", "rel_path").collect())) == want
    assert seen and max(seen) < len(pairs) / 2, (seen, len(pairs))


def test_numbered_suppliers_are_the_named_ones(spark, tmp_path):
    """Lines of unknown suppliers and of none make no edge; suppliers that share a key have no numbers."""
    d = f"file://{tmp_path}"
    spark.createDataFrame([(0, "A"), (1, "B")], "r_regionkey long, r_name string").write.parquet(f"{d}/region.parquet")
    spark.createDataFrame([(0, "X", 0), (1, "Y", 1)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{d}/nation.parquet")
    spark.createDataFrame([(k, k % 2) for k in (0, 1, 2, 3, 10)] + [(None, 0)], "s_suppkey long, s_nationkey long").write.parquet(f"{d}/supplier.parquet")
    orders = [(0, 1), (1, 0), (1, 77), (77, 2), (2, 77), (77, 1), (2, 3), (None, 2), (10, 10), (3, None), (1 << 62, 3)]
    rows = [(o, n, s, 50.0 - o % 2 * 40) for o, pair in enumerate(orders) for n, s in enumerate(pair)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    want = sorted(map(tuple, graph.strong_components(bridge.supplier_edges(spark, d, bridge.WIDE)).collect()))
    got = graph.numbered_components(*bridge.supplier_numbers(spark, d, bridge.WIDE), local_edges=0)
    assert sorted(map(tuple, got.select("repo", "component", "rel_path").collect())) == want and len(want) > 5
    spark.createDataFrame([(3, 0)], "s_suppkey long, s_nationkey long").write.mode("append").parquet(f"{d}/supplier.parquet")
    assert bridge.supplier_numbers(spark, d, bridge.WIDE) is None
