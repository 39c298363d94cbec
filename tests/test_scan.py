"""Mini repositories with hand-derived results."""

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from strata.operators import metrics, parse, report, syntax
from strata.plans import scan as plans
from strata.sources import pytree

MINI = {
    ".architecture.json": '{"layer_order": ["data","domain","api"]}',
    "api/__init__.py": "",
    "api/views.py": "from domain import models\nfrom data.store import get\n",
    "domain/__init__.py": "from . import models\n",
    "domain/models.py": "import data.store\nfrom .rules import check\n",
    "domain/rules.py": "from domain.models import M\n",
    "data/__init__.py": "",
    "data/store.py": "import api.views\n",
    "src/core/a.py": "from . import b\n",
    "src/core/b.py": "from .a import x\n",
    "top.py": "import src.core.a\nimport core.a\n",
}
QUIRKS = {
    "pkg/__init__.py": "from pkg import x\nimport pkg.__init__\n",
    "pkg/m.py": "import pkg\nimport pkg.__init__\nfrom . import *\nfrom ....far import z\n",
    "pkg.py": "import os\n",
    "foo.py": "import pkg.m\n",
    "src/foo.py": "from . import far\n",
    "far.py": "import foo\n",
    "bad.py": "def (\n",
    "solo.py": "import solo\n",
}


def tree(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return os.path.realpath(root)


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("repos")
    sizes = {f"f{n}.py": "x = 1\n" * n for n in (300, 301, 500, 501, 800, 801)}
    many = {f"f{n:02}.py": "x = 1\n" * (400 + n) for n in range(20)}
    apart = {"a/x.py": "import os\n", "b/y.py": "import a.x\n"}
    roots = {n: tree(base / n, f) for n, f in (("mini", MINI), ("quirks", QUIRKS), ("sizes", sizes), ("many", many), ("apart", apart), ("empty", {"notes.txt": ""}))}
    roots["gone"] = str(base / "gone")
    return roots, plans.scan(spark, list(roots.values()))


@pytest.fixture(scope="module")
def documents(scanned):
    roots, s = scanned
    back = {v: k for k, v in roots.items()}
    return {back[r.repo]: json.loads(r.document) for r in s.documents().collect()}


def test_mini(documents):
    d = documents["mini"]
    assert (d["source_files"], d["total_files"], d["total_lines"]) == (10, 10, 11)
    assert d["max_in_degree_file"] == "data/store.py"
    stats = d["dependency_stats"]
    assert sum(map(len, stats["import_map"].values())) == 10
    assert stats["import_map"]["top.py"] == ["src/core/a.py"]
    assert {k: v for k, v in stats["in_degree"].items() if v} == {
        "domain/models.py": 2, "data/store.py": 2, "src/core/a.py": 2, "api/views.py": 1, "domain/__init__.py": 1, "domain/rules.py": 1, "src/core/b.py": 1
    }
    five = ["api/views.py", "data/store.py", "domain/__init__.py", "domain/models.py", "domain/rules.py"]
    assert stats["circular_dependencies"] == [[*five, five[0]], ["src/core/a.py", "src/core/b.py", "src/core/a.py"]]
    kinds = {c["type"]: c for c in stats["cycle_analysis"]["cycles"]}
    assert kinds["layer_leak"]["risk_score"] == 10 and kinds["layer_leak"]["folders"] == ["api", "data", "domain"]
    assert kinds["tight_coupling"]["folders"] == ["core"]
    assert {k: v["depends_on"] for k, v in stats["folder_coupling"].items()} == {".": ["core"], "api": ["data", "domain"], "core": [], "data": ["api"], "domain": ["data"]}
    risks = d["architectural_risks"]
    assert risks["tight_coupling_pairs"] == [["src/core/a.py", "src/core/b.py"]]
    assert risks["layer_violations"] == [{"importer_folder": "data", "imported_folder": "api"}]
    assert [(c["path"], c["centrality_score"]) for c in risks["core_modules"]] == [
        ("domain/models.py", 1.0), ("api/views.py", 0.75), ("data/store.py", 0.75), ("src/core/a.py", 0.75),
        ("domain/__init__.py", 0.5), ("domain/rules.py", 0.5), ("src/core/b.py", 0.5), ("top.py", 0.25),
    ]
    score = d["architecture_score"]
    assert (score["raw_score"], score["normalized_score"]) == (63, 63)
    assert score["structural_profile"] == {"long_file_ratio": 0.0, "cycle_ratio": 0.2, "centralization_score": 0.2, "cross_folder_ratio": 0.5}
    assert (score["scoring_mode"], score["scoring_profile"], d["structural_class"]) == ("default", "v2_default", "small_project")


def test_sizes(documents):
    d = documents["sizes"]
    assert [x["lines"] for x in d["long_files"]] == [301, 500, 501, 800, 801]
    assert d["total_long_files"] == 3
    assert d["architecture_score"]["risk_breakdown"]["long_file_penalty"] == 9
    assert d["architecture_score"]["normalized_score"] == 96
    assert d["architectural_risks"]["god_module_candidates"] == []
    assert d["dependency_stats"]["folder_coupling"] == {".": {"external_dependencies": 0, "depends_on": []}}


def test_folders_that_import_nothing(scanned, documents):
    want = {"a": {"external_dependencies": 0, "depends_on": []}, "b": {"external_dependencies": 1, "depends_on": ["a"]}}
    assert documents["apart"]["dependency_stats"]["folder_coupling"] == want
    roots, s = scanned
    view = s.overview().where(F.col("repo") == roots["apart"])
    assert "  - b: 1 external folders\n  - a: 0 external folders" in report.summaries(view).first().summary
    assert "  - `a`: 0 external folders" in report.markdown(view).first().markdown


def test_empty_root(scanned, documents):
    """A valid root without source files has a whole document, scores and texts."""
    d = documents["empty"]
    assert (d["valid"], d["source_files"], d["total_files"], d["total_lines"], d["long_files"], d["per_file_stats"], d["max_in_degree_file"]) == (True, 0, 0, 0, [], {}, "")
    stats = d["dependency_stats"]
    assert (stats["import_map"], stats["in_degree"], stats["circular_dependencies"], stats["folder_coupling"], stats["cross_folder_dependency_ratio"]) == ({}, {}, [], {}, 0.0)
    assert (d["structural_class"], d["architecture_score"]["normalized_score"], d["architecture_score"]["raw_score"]) == ("small_project", 100, 0)
    roots, s = scanned
    view = s.overview().where(F.col("repo") == roots["empty"])
    text = report.summaries(view).first().summary
    assert "Total files: 0" in text and "Signal confidence: 50%" in text and "Top largest files:" not in text
    assert "- **Long files:** None" in report.markdown(view).first().markdown
    assert s.scores().where(F.col("repo") == roots["empty"]).first().total_files == 0


def test_keys_in_the_order_of_paths(documents):
    """Files come folder by folder: a folder's files before a file whose name only begins like the folder's."""
    assert list(documents["quirks"]["per_file_stats"]) == ["bad.py", "far.py", "foo.py", "pkg/__init__.py", "pkg/m.py", "pkg.py", "solo.py", "src/foo.py"]
    assert list(documents["quirks"]["dependency_stats"]["import_map"]) == list(documents["quirks"]["per_file_stats"])
    assert list(documents["quirks"]["dependency_stats"]["in_degree"]) == sorted(documents["quirks"]["per_file_stats"])


def test_first_long_files_by_path(scanned):
    roots, s = scanned
    view = s.overview().where(F.col("repo") == roots["many"])
    row = report.audit_rows(view).where("metric = 'Files > 300 lines'").first().value
    assert row == ", ".join(f"f{n:02}.py ({400 + n})" for n in range(10)) + " … +10 more"


def test_quirks(documents):
    d = documents["quirks"]
    m = d["dependency_stats"]["import_map"]
    assert m["pkg/__init__.py"] == ["pkg/__init__.py"] * 2
    assert m["pkg/m.py"] == ["far.py", "pkg/__init__.py", "pkg/__init__.py"]
    assert m["far.py"] == ["src/foo.py"] and m["src/foo.py"] == ["far.py"] and m["solo.py"] == ["solo.py"]
    assert d["dependency_stats"]["circular_dependencies"] == [["far.py", "src/foo.py", "far.py"]]
    assert {k: v["depends_on"] for k, v in d["dependency_stats"]["folder_coupling"].items()} == {".": ["foo.py", "pkg"], "foo.py": ["."], "pkg": ["."]}
    assert (d["architecture_score"]["raw_score"], d["architecture_score"]["normalized_score"]) == (40, 69)
    assert d["per_file_stats"]["bad.py"] == {"lines": 1, "function_count": 0, "class_count": 0}


def test_invalid_root(scanned, documents):
    roots, _ = scanned
    assert documents["gone"] == {"path": roots["gone"], "valid": False, "error": "Not a directory"}
    assert not os.path.exists(roots["gone"])
    s = scanned[1]
    view = s.overview().where(F.col("repo") == roots["gone"])
    assert report.summaries(view).first().summary == "Invalid scan: Not a directory." and report.markdown(view).count() == 0
    assert [(r.metric, r.value) for r in report.audit_rows(view).orderBy("place").collect()] == [("Status", "Invalid"), ("Error", "Not a directory")]
    zero = metrics.zero_scores(s.repos).first()
    assert (zero.repo, zero.raw_score, zero.architecture_health_percentage, zero.scoring_profile) == (roots["gone"], 0, 0, "v2_default")


def test_reports(scanned):
    roots, s = scanned
    view = s.overview().cache()
    text = {r.repo: r.summary for r in report.summaries(view).collect()}[roots["mini"]]
    assert "Signal confidence: 100%" in text and "coupling_risk_level: high" in text
    assert "  src/core/a.py -> src/core/b.py -> src/core/a.py" in text
    sizes = {r.repo: r.summary for r in report.summaries(view).collect()}[roots["sizes"]]
    assert "Largest file share of total lines: 25.0%" in sizes and "Signal confidence: 75%" in sizes
    report.write_per_repo(report.markdown(view), "markdown", "report.md")
    made = [p for r in roots.values() if os.path.isfile(p := f"{r}/{report.FOLDER}/report.md")]
    assert len(made) == 6 and all(open(p).read().startswith("# Architecture Report") for p in made)
    assert report.audit_rows(view).where("metric = 'Raw score'").count() == 6


def test_benchmark_rows(scanned, tmp_path):
    roots, s = scanned
    rows = metrics.benchmark_rows(s.scores())
    assert {r.repo: r.architecture_health_percentage for r in rows.collect() if r.repo in ("mini", "quirks", "sizes", "empty")} == {"mini": 63, "quirks": 69, "sizes": 96, "empty": 100}
    table = {r.repo: r for r in report.benchmark_table(rows.withColumn("error", F.lit(None).cast("string"))).collect()}
    assert (table["mini"].Files, table["mini"].Cycles, table["mini"].Score) == ("10", "2", "63")


def test_results_files(scanned, tmp_path):
    _, s = scanned
    some = metrics.harness_rows(s.scores().where(F.col("repo").rlike("mini$|sizes$")))
    path = str(tmp_path / "made/results.csv")
    assert report.write_results(some.limit(0), path) == 0 and not os.path.exists(path)
    assert report.write_results(some, path, append=True) == 2
    assert report.write_results(some, path, append=True) == 2
    with open(path, newline="") as f:
        lines = list(csv.reader(f))
    assert lines[0] == list(report.CSV_FIELDS) and [x[0] for x in lines[1:]] == ["mini", "sizes"] * 2
    assert lines[1][1:5] == ["", "10", "11", "63"]
    report.write_summary(some, str(tmp_path / "made/summary.json"))
    items = json.load(open(tmp_path / "made/summary.json"))
    assert [(x["repo"], x["architecture_health_percentage"]) for x in items] == [("mini", 63), ("sizes", 96)] and items[0]["path"].endswith("/mini")


def test_stored_documents(spark, scanned):
    """What is read from stored documents is what the scan has; missing values have substitutes."""
    roots, s = scanned
    s.write_documents()
    again = plans.stored_scan(spark, list(roots.values()))
    assert {r.repo: r.summary for r in report.summaries(again.overview()).collect() if r.repo != roots["gone"]} == {
        r.repo: r.summary for r in report.summaries(s.overview()).collect() if r.repo != roots["gone"]
    }
    gone = report.summaries(again.overview()).where(F.col("repo") == roots["gone"]).first().summary
    assert gone == f"Scan data not found at {roots['gone']}/{report.FOLDER}/{report.DOCUMENT}."
    live = {r.repo: r for r in metrics.harness_rows(s.scores()).collect()}
    kept = {r.repo: r for r in plans.stored_metrics(spark, list(roots.values())).collect()}
    assert {r.repo: r for r in plans.harness(spark, [roots["mini"]], store=True).collect()} == {roots["mini"]: kept[roots["mini"]]}
    assert kept.keys() == live.keys() and all(kept[k][c] == pytest.approx(live[k][c], abs=1e-4) for k in kept for c in kept[k].asDict() if c != "repo")


def test_substitutes_in_stored_documents(spark, tmp_path):
    texts = {
        "a": '{"source_files": 7, "architecture_score": {"normalized_score": 55}}',
        "b": '{"valid": false, "error": "Not a directory"}',
        "c": "{",
        "d": "{}",
    }
    roots = [tree(tmp_path / n, {f"{report.FOLDER}/{report.DOCUMENT}": t}) for n, t in texts.items()]
    rows = {os.path.basename(r.repo): r for r in plans.stored_metrics(spark, roots).collect()}
    assert (rows["a"].total_files, rows["a"].architecture_health_percentage, rows["a"].raw_score, rows["a"].long_file_ratio) == (7, 55, 0, None)
    assert rows.keys() == {"a", "d"} and rows["d"].total_files == 0
    text = {os.path.basename(r.repo): r.summary for r in report.summaries(plans.stored_scan(spark, roots).overview()).collect()}
    assert text["b"] == "Invalid scan: Not a directory." and text["c"].startswith("Invalid scan data: ") and "Total files: 7" in text["a"]


def test_unreadable_files_are_listed(spark, tmp_path):
    """A file that cannot be read counts as a source file and has no facts."""
    rows = [("r", "a.py", b"import b\n", True), ("r", "b.py", None, False)]
    facts = syntax.file_facts(spark.createDataFrame(rows, pytree.SCHEMA))
    got = {r.rel_path: (r.lines, r.parse_status) for r in facts.collect()}
    assert got == {"a.py": (1, "ok"), "b.py": (None, "unreadable")}
    good = facts.where("parse_status = 'ok'")
    row = report.scan_documents(good, syntax.import_edges(good), listed=facts).first()
    assert json.loads(row.document)["dependency_stats"]["import_map"] == {"a.py": [], "b.py": []} and list(json.loads(row.document)["per_file_stats"]) == ["a.py"]
    x = spark.createDataFrame([(4, 5, 9, False, 0.0)], "total_files long, source_files long, total_edges long, only_tests boolean, cross_folder_ratio double")
    assert x.select(metrics.signal_confidence().alias("a"), metrics.signal_confidence("source_files").alias("b")).first() == (75, 100)


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from strata.__main__ import main

    metrics_of = {"total_files": 2, "total_lines": 5, "architecture_health_percentage": 90, "raw_score": 1, "long_file_penalty": 0, "circular_dependency_penalty": 0, "centralization_penalty": 0, "cross_folder_penalty": 1, "long_file_ratio": 0.0, "cycle_ratio": 0.0}
    kind = "repo string, " + ", ".join(f"{k} {'double' if k.endswith('ratio') else 'long'}" for k in metrics_of)
    asked = []

    root = tree(tmp_path / "one", {"a.py": "import b\n", "b.py": ""})
    tree(tmp_path / "two", {"c.py": ""})
    main(["version"])
    main(["audit", root, "--markdown-report"])
    out = capsys.readouterr().out
    assert "Source files: 2" in out and "Repository: " + root in out and os.path.isfile(f"{root}/{report.FOLDER}/report.md")
    main(["audit", str(tmp_path / "none")])
    assert "Error: Not a directory" in capsys.readouterr().out
    main(["summary", root])
    assert "Total files: 2" in capsys.readouterr().out
    main(["benchmark", root, str(tmp_path / "none"), "--json"])
    assert [x["total_files"] for x in json.loads(capsys.readouterr().out)] == [None, 2]
    (tmp_path / "urls").write_text("# list\nhttps://host/x/one.git\n\nhttps://host/x/nine\n")
    import strata.plans.scan as driver

    monkeypatch.setattr(driver, "harness", lambda s, roots, store: asked.append((roots, store)) or s.createDataFrame([(r, *metrics_of.values()) for r in roots], kind))
    args = ["harness", str(tmp_path), "two", "--url-file", str(tmp_path / "urls"), "--results", str(tmp_path / "r.csv"), "--summary", str(tmp_path / "s.json")]
    main(args)
    lines = (tmp_path / "r.csv").read_text().splitlines()
    assert [x.split(",")[:3] for x in lines[1:]] == [["one", "https://host/x/one.git", "2"], ["two", "", "2"]] and asked[0] == ([str(tmp_path / "one"), str(tmp_path / "two")], True) and len(json.loads((tmp_path / "s.json").read_text())) == 2
    main(["harness", str(tmp_path), "nothing", "--results", str(tmp_path / "none.csv")])
    assert "No results" in capsys.readouterr().out


def test_listing(spark, tmp_path):
    kept = ["pkg/__init__.py", "pkg/__main__.py", "pkg/empty.py", "pkg/m.py", "_priv/q.py", ".dot.py", ".venvx/h.py", "top.py"]
    gone = [".git/h.py", "venv/v.py", ".venv/v.py", "env/v.py", ".env/v.py", "B.PY", "notes.txt"]
    root = tree(tmp_path, dict.fromkeys([*kept, *gone], "") | {"bad.py": b"x = '\xff'\n"})
    rows = pytree.read_trees(spark, [root])
    assert sorted(r.rel_path for r in rows.collect()) == sorted([*kept, "bad.py"])
    assert syntax.file_facts(rows).where("rel_path = 'bad.py'").first().lines == 1


def test_syntax():
    source = "import a.b.c as q, d\nfrom . import x, y as z\nasync def f():\n    import e\n    def g(): pass\nclass A:\n    class B:\n        def m(self): from ..p import *\n"
    functions, classes, status, found = parse.parse(source)
    assert (functions, classes, status) == (2, 2, "ok")
    assert {(i["level"], i["module"], tuple(i["names"])) for i in found} == {(0, "a.b.c", ()), (0, "d", ()), (1, None, ("x", "y")), (0, "e", ()), (2, "p", ("*",))}
    assert parse.parse("\0")[2] != "ok" and parse.parse("def (")[:3] == (0, 0, "syntax_error")


@pytest.mark.parametrize(
    ("text", "mode", "profile", "floor"),
    [
        (None, "default", "v2_default", 20),
        ("{", "default", "v2_default", 20),
        ("[1]", "default", "v2_default", 20),
        ('{"scoring": {}}', "default", "v2_default", 20),
        ('{"scoring": {"scoring_profile": "x"}}', "custom", "x", 20),
        ('{"scoring": {"structural_class_health_floor": {"small_project": 0}}}', "custom", "custom", 20),
        ('{"scoring": {"structural_class_health_floor": {"small_project": 99}}}', "custom", "custom", 99),
        ('{"scoring": {"structural_class_health_floor": {"small_project": "31"}, "scoring_profile": ""}}', "custom", "custom", 31),
        ('{"scoring": []}', "default", "v2_default", 20),
    ],
)
def test_config(spark, tmp_path, text, mode, profile, floor):
    root = tree(tmp_path, {"a.py": ""} | ({".architecture.json": text} if text else {}))
    config = pytree.read_config(spark, [root])
    facts = metrics.with_config(spark.createDataFrame([(root,)], "repo string"), config).first()
    assert (facts.scoring_mode, facts.scoring_profile) == (mode, profile)
    x = metrics.with_config(spark.createDataFrame([(root, "small_project")], "repo string, kind string"), config)
    got = x.select(metrics.per_class(F.col("kind"), F.col("scoring")["structural_class_health_floor"], metrics.CLASS_FLOOR, 15).alias("f")).first().f
    assert got == floor


def test_numbers_in_settings(spark):
    text = """{"layer_order": ["a", "b"], "scoring": {"long_file_threshold_low": "400", "long_file_threshold_high": 7.9, "long_file_penalty_low": -2.5, "long_file_penalty_high": true,
        "cycle_penalty_2_node": " 1_0 ", "centralization_penalty": "x", "cross_folder_threshold_low": "0.25", "cross_folder_threshold_high": 1, "cross_folder_penalty_low": "7.9"}}"""
    x = spark.createDataFrame([("r", text)], "repo string, text string").select("repo", metrics.settings(F.col("text")).alias("c")).select("repo", "c.*")
    got = metrics.with_config(spark.createDataFrame([("r",)], "repo string"), x).first()
    assert got.layer_order == ["a", "b"]
    want = {"long_file_threshold_low": 400, "long_file_threshold_high": 7, "long_file_penalty_low": -2, "long_file_penalty_high": 1, "cycle_penalty_2_node": 10, "centralization_penalty": 10,
            "cross_folder_threshold_low": 0.25, "cross_folder_threshold_high": 1.0, "cross_folder_penalty_low": 10, "cross_folder_penalty_high": 20, "centralization_threshold_ratio": 0.05}
    assert {k: got[k] for k in want} == want
