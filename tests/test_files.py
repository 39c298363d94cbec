"""Listing, packing and reading files; the sink that commits; documents made of fragments."""

import json
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strata.plans import scan as plans
from strata.sources import files, pytree, sink
from tests.test_scan import MINI, QUIRKS, tree


def names(rows):
    return sorted((os.path.basename(r.repo), r.rel_path, r.size) for r in rows.collect())


@pytest.mark.parametrize("scheme", ["", "file://"])
@pytest.mark.parametrize("most", [500, 1, 3])
def test_listing_in_rounds(spark, tmp_path, scheme, most):
    """However few folders a task opens, every file comes once; by path and by URI alike."""
    made = {f"src/pkg{i}/sub{j}/m{k}.py": "x" * k for i in range(3) for j in range(3) for k in range(3)} | {"__init__.py": "", ".h.py": "1", "venv/no.py": "", "a/.git/no.py": "", "a/B.PY": ""}
    root = tree(tmp_path / "one", made)
    tree(tmp_path / "two", {"z.py": "zz"})
    os.symlink(root, tmp_path / "two/link")
    os.symlink(tmp_path / "nowhere", tmp_path / "two/gone.py")
    os.symlink(tmp_path / "two/z.py", tmp_path / "two/again.py")
    roots = spark.createDataFrame([(scheme + root,), (f"{scheme}{tmp_path}/two",), (f"{scheme}{tmp_path}/none",)], "repo string")
    want = [("one", p, len(t)) for p, t in made.items() if p.endswith(".py") and ".git" not in p and "venv" not in p] + [("two", "z.py", 2), ("two", "again.py", 2)]
    assert names(files.listed(roots, ".py", pytree.PRUNED, most)) == sorted(want)


def test_no_files(spark, tmp_path):
    assert pytree.read_trees(spark, [tree(tmp_path, {"x.txt": ""}), str(tmp_path / "none")]).collect() == []


def test_scan_by_uri(spark, tmp_path):
    root = tree(tmp_path / "mini", MINI)
    by_path, by_uri = plans.scan(spark, [root]), plans.scan(spark, ["file://" + root, f"file://{tmp_path}/none"])
    pick = lambda s: sorted(tuple(r)[1:] for r in s.scores().drop("scoring", "layer_order").collect())
    assert pick(by_path) == pick(by_uri)
    by_uri.write_documents()
    document = json.load(open(f"{root}/architecture_report/scan.json"))
    assert document["path"] == "file://" + root and document["architectural_risks"]["layer_violations"] == [{"importer_folder": "data", "imported_folder": "api"}]
    assert [r.repo for r in plans.stored_scan(spark, ["file://" + root]).scores().collect()] == ["file://" + root]


def part_weights(rows):
    weight = defaultdict(int)
    for r in rows.collect():
        weight[r.part] += max(r.size, 0) + files.OPEN_BYTES
    return weight


def listing(spark, sizes):
    from strata.storage import written

    rows = spark.createDataFrame([("r", f"f{i}.py", n) for i, n in enumerate(sizes)], "repo string, rel_path string, size long")
    return written(rows.repartition(3), "test-files")


@pytest.mark.parametrize("size", [lambda i: i % 3000, lambda i: i * 7919 % 20_000, lambda i: 2000])
def test_partitions_of_equal_bytes(spark, size):
    """One folder of 100,000 small files and one file of 200 MB: all partitions are within a factor of two in bytes."""
    rows, n = files.packed(listing(spark, [200 << 20, *map(size, range(100_000))]), 8)
    held = {r.part: r.n for r in rows.groupBy("part").agg(F.sum("size").alias("n")).collect()}
    assert sorted(held) == list(range(n)) and n >= 2 and max(held.values()) <= 2 * min(held.values())
    assert rows.count() == 100_001 and rows.select("rel_path").distinct().count() == 100_001


@pytest.mark.parametrize("sizes", [[5], [5] * 10, [100] * 5000, [0] * 40_000, [1 << 20] * 3])
def test_packing_alike_sizes(spark, sizes):
    """Small files alone make as many parts as their weight asks for."""
    rows, n = files.packed(listing(spark, sizes), 8)
    weight = part_weights(rows)
    total = sum(s + files.OPEN_BYTES for s in sizes)
    most = files.partition_weight(total, max(sizes) + files.OPEN_BYTES, 8)
    assert sorted(weight) == list(range(n)) and 0.5 * total / most <= n <= 2 * total / most + 1 and max(weight.values()) <= 1.5 * most


@pytest.mark.parametrize("seed", range(8))
def test_packing_random_sizes(spark, seed):
    r = random.Random(seed)
    sizes = [int(2 ** r.uniform(0, (23, 16)[seed % 2])) for _ in range(r.randrange(1, 900))] + [0] * r.randrange(50) + [600 << 20] * r.randrange(3)
    rows, n = files.packed(listing(spark, sizes), 8)
    most = files.partition_weight(sum(s + files.OPEN_BYTES for s in sizes), max(sizes) + files.OPEN_BYTES, 8)
    weight = part_weights(rows)
    assert set(weight) <= set(range(n)) and n - len(weight) <= 1 and rows.count() == len(sizes)
    shared = sorted(w for w in weight.values() if w < 600 << 20)
    assert all(w <= 1.5 * most for w in shared) and sum(w <= 0.45 * most for w in shared) <= 1


def test_each_partition_reads_its_own_files(spark, tmp_path):
    root = tree(tmp_path, {f"p{i}/m{j}.py": "x" * (20_000 * j) for i in range(5) for j in range(8)})
    rows = pytree.read_trees(spark, [root])
    got = rows.select("rel_path", F.length("content").alias("n"), F.spark_partition_id().alias("p")).collect()
    assert sorted((r.rel_path, r.n) for r in got) == sorted((f"p{i}/m{j}.py", 20_000 * j) for i in range(5) for j in range(8))
    by = defaultdict(int)
    for r in got:
        by[r.p] += r.n + files.OPEN_BYTES
    assert len(by) > 5 and max(by.values()) <= files.LEAST_BYTES


def test_files_beyond_a_row_are_listed_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ROW_BYTES", 10)
    root = tree(tmp_path, {"big.py": "x" * 11, "small.py": "x" * 10})
    assert {r.rel_path: (r.readable, r.content) for r in pytree.read_trees(spark, [root]).collect()} == {"big.py": (False, None), "small.py": (True, b"x" * 10)}


# --- the sink ---


def fragments(spark, rows):
    return spark.createDataFrame(rows, "root string, path string, k int, kind string, text string")


def test_documents_of_many_roots_are_written_by_tasks(spark, tmp_path):
    roots = [str(tmp_path / f"r{i}") for i in range(1000)]
    for r in roots[:-1]:
        os.mkdir(r)
    rows = spark.createDataFrame([(r, f"text of {r}\n") for r in roots], "repo string, t string").repartition(7)
    sink.write_texts(rows, "repo", "t", "made/doc.txt")
    assert all(open(f"{r}/made/doc.txt").read() == f"text of {r}\n" for r in roots[:-1])
    assert not os.path.exists(roots[-1]) and all(os.listdir(f"{r}/made") == ["doc.txt"] for r in roots[:-1])


@pytest.mark.parametrize("parts", [1, 2, 9])
def test_json_across_tasks(spark, tmp_path, parts):
    """Commas are right wherever a file is cut into tasks."""
    rows = []
    for name, n in (("a", 40), ("b", 0), ("c", 1)):
        steps = [("open", "{"), ("item", '"x": 1, "y": 2'), ("open", '"list": ['), *(("item", str(i)) for i in range(n)), ("close", "]"), ("open", '"in": {'), ("close", "}"), ("item", '"z": "' + "é" * 50 + '"'), ("close", "}")]
        rows += [(str(tmp_path), f"{tmp_path}/{name}.json", k, *s) for k, s in enumerate(steps)]
    random.Random(1).shuffle(rows)
    sink.write_fragments(fragments(spark, rows), ["k"], parts=parts)
    for name, n in (("a", 40), ("b", 0), ("c", 1)):
        assert json.load(open(tmp_path / f"{name}.json")) == {"x": 1, "y": 2, "list": list(range(n)), "in": {}, "z": "é" * 50}
    assert sorted(os.listdir(tmp_path)) == ["a.json", "b.json", "c.json"]


def test_a_failed_write_leaves_old_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("old a")
    (tmp_path / "z.txt").write_text("old z")
    rows = fragments(spark, [(str(tmp_path), f"{tmp_path}/{n}.txt", k, "line", "new") for n in "az" for k in range(50)])
    broken = rows.withColumn("text", F.when((F.col("k") == 49) & F.col("path").endswith("z.txt"), F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        sink.write_fragments(broken, ["k"], parts=4)
    assert (tmp_path / "a.txt").read_text() == "old a" and (tmp_path / "z.txt").read_text() == "old z"
    assert sorted(os.listdir(tmp_path)) == ["a.txt", "z.txt"]


def test_abort_takes_away_what_tasks_made(tmp_path):
    w = sink.FragmentWriter({})
    (tmp_path / "a.txt").write_text("old")
    for name in (f".a.txt.{w.job}-0-0-0", f".a.txt.{w.job}-1-0-0", ".a.txt.other-0"):
        (tmp_path / name).write_text("part")
    w.abort([None, sink.Parts([sink.Part(f"{tmp_path}/a.txt", 0, f"{tmp_path}/.a.txt.{w.job}-0-0-0", "line", "line")], False)])
    assert sorted(os.listdir(tmp_path)) == [".a.txt.other-0", "a.txt"] and (tmp_path / "a.txt").read_text() == "old"


def test_append_replaces_the_file_at_once(spark, tmp_path):
    rows = fragments(spark, [(str(tmp_path), f"{tmp_path}/r.csv", k, "line", f"{k}\n") for k in range(30)])
    for parts in (1, 5):
        before = os.stat(tmp_path / "r.csv").st_ino if parts == 5 else None
        sink.write_fragments(rows, ["k"], header="h\n", append=True, parts=parts)
        assert os.stat(tmp_path / "r.csv").st_ino != before  # another file was put in its place
    lines = "".join(f"{k}\n" for k in range(30))
    assert (tmp_path / "r.csv").read_text() == "h\n" + lines * 2
    sink.write_fragments(rows, ["k"], header="h\n")
    assert (tmp_path / "r.csv").read_text() == "h\n" + lines


# --- documents from fragments ---


def test_fragments_make_the_same_documents(spark, tmp_path):
    """A document put together from its fragments is the one that a row holds, keys in the same order."""
    layers = {".architecture.json": '{"layer_order": ["pkg", "."], "scoring": {"long_file_threshold_low": 3}}'}
    odd = {'we"ird\\/é.py': "import os\n", "n\nl/x.py": "x\n" * 400, "a/x.py": "import b.y\n", "b/y.py": "import a.x\n"}
    trees = {"mini": MINI, "quirks": QUIRKS | layers, "odd": odd, "empty": {}, "long": {f"f{i}.py": "x = 1\n" * (290 + i) for i in range(40)}}
    roots = [tree(tmp_path / n, {"README": ""} | t) for n, t in trees.items()] + [str(tmp_path / "none")]
    s = plans.scan(spark, roots)
    s.write_documents()
    for row in s.documents().collect():
        path = f"{row.repo}/architecture_report/scan.json"
        if row.repo == roots[-1]:
            assert not os.path.exists(row.repo)
            continue
        assert json.dumps(json.loads(open(path).read())) == json.dumps(json.loads(row.document)), row.repo
        assert os.listdir(f"{row.repo}/architecture_report") == ["scan.json"]


def test_stored_documents_by_the_thousand(spark, tmp_path):
    """Read in tasks, one row for each that cannot be used, entries as rows."""
    roots = [str(tmp_path / f"r{i}") for i in range(2000)]
    for i, r in enumerate(roots):
        os.makedirs(f"{r}/architecture_report")
        text = "{" if i % 100 == 0 else json.dumps({"source_files": i, "per_file_stats": {"a.py": {"lines": i, "function_count": "x", "class_count": 1}, "b.py": 3}, "dependency_stats": {"import_map": {"a.py": ["b.py"], "b.py": "no"} if i % 2 else []}})
        with open(f"{r}/architecture_report/scan.json", "w") as f:
            f.write(text)
    s = plans.stored_scan(spark, roots)
    assert s.repos.where("valid").count() == 1980 and s.repos.where("message LIKE 'Invalid scan data: %'").count() == 20
    got = {(os.path.basename(r.repo), r.rel_path): (r.lines, r.function_count, r.class_count) for r in s.stats.collect()}
    assert len(got) == 2 * 1980 and got["r7", "a.py"] == (7, None, 1) and got["r7", "b.py"] == (None, None, None)
    assert {(r.src, r.dst) for r in s.edges.collect()} == {("a.py", "b.py")} and s.edges.count() == 1000
    assert s.markers.agg(F.sum("source_files")).first()[0] == sum(i for i in range(2000) if i % 100)
