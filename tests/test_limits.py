"""Parses that are kept within limits, and reviews that are paid for once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from strata.operators import parse, review, syntax


def test_a_parse_does_not_take_its_worker_along():
    """Huge literals, deep nesting and endless work give a status each; what comes after them is parsed as ever."""
    with parse.Parser(memory=512 << 20, seconds=30) as p:
        assert p("import a\ndef f(): pass\n") == (1, 0, "ok", [{"level": 0, "module": "a", "names": []}])
        first = p.child.pid
        assert p("x = '" + "y" * (200 << 20) + "'")[2] == "too_large"
        assert p("class A: pass\n")[:3] == (0, 1, "ok")
        for deep in ("(" * 1_000_000, "-" * 1_000_000 + "1", "[" * 1_000_000 + "]" * 1_000_000, "x" + ".y" * 1_000_000):
            assert p(deep)[2] in ("too_large", "syntax_error", "RecursionError"), deep[:3]
            assert p("from . import é\n")[3] == [{"level": 1, "module": None, "names": ["é"]}]
        assert p("def (")[2] == "syntax_error" and p("\0")[2] != "ok" and p("") == (0, 0, "ok", [])
        p.child.kill()  # as the system does where memory runs out
        p.child.wait()
        assert p("x = 1")[2] == "too_large" and p("x = 1")[2] == "ok" and p.child.pid != first
    assert p.child is None


def test_a_parse_that_takes_too_long():
    with parse.Parser(seconds=0.2) as p:
        assert p("x = 1\n" * 200_000)[2] == "timed_out"
        p.seconds = 30
        assert p("x = 1\n")[2] == "ok"


def test_all_other_files_have_their_facts(spark):
    rows = [("r", f"f{i}.py", b"import os\ndef f(): pass\n", True) for i in range(20)] + [("r", "wide.py", b"x = 1\n" * 400_000, True), ("r", "deep.py", b"(" * 500_000, True), ("r", "none.py", None, False)]
    facts = syntax.file_facts(spark.createDataFrame(rows, "repo string, rel_path string, content binary, readable boolean").coalesce(1), memory=150 << 20)
    got = {r.rel_path: (r.function_count, r.parse_status, len(r.imports)) for r in facts.drop("repo").collect()}
    assert all(got[f"f{i}.py"] == (1, "ok", 1) for i in range(20)) and got["none.py"] == (None, "unreadable", 0)
    assert got["wide.py"] == (0, "too_large", 0) and got["deep.py"][0] == 0 and got["deep.py"][1] in ("too_large", "syntax_error")


class Counted:
    """A reviewer that keeps a file for each call, and fails every third one of a task."""

    def __init__(self, folder, fails=3, dies=None):
        self.folder, self.fails, self.dies, self.n = str(folder), fails, dies, 0

    def __call__(self, prompt):
        self.n += 1
        failed = self.fails and self.n % self.fails == 0
        with open(f"{self.folder}/{'failed' if failed else 'paid'}-{os.getpid()}-{self.n}-{os.urandom(4).hex()}", "w") as f:
            f.write(prompt)
        if self.dies and prompt == self.dies and not os.path.exists(f"{self.folder}/died"):
            open(f"{self.folder}/died", "w").close()
            os._exit(1)
        if failed:
            raise RuntimeError("busy")
        return json.dumps({"architecture_score": len(prompt), "key_issues": [], "improvement_priorities": []})


def paid(folder):
    return sorted(open(f"{folder}/{n}").read() for n in os.listdir(folder) if n.startswith("paid"))


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path / "calls"


def test_answers_are_paid_once(spark, tmp_path, calls):
    store = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(i, f"summary {i % 40}") for i in range(100)] + [(100, None)], "i int, p string").withColumn("key", F.lit("k"))
    got = review.ask_once(rows, "p", Counted(calls), store, tasks=3).collect()
    assert len(got) == 101 and all((r.answer is None) == (r.p is None) and r.error is None and r.key == "k" for r in got)
    assert paid(calls) == sorted(f"summary {i}" for i in range(40))  # each prompt once, in spite of failures
    assert review.parse_strict(review.ask_once(rows, "p", Counted(calls), store).where("p IS NOT NULL").drop("error")).where("error IS NULL").count() == 100
    assert len(paid(calls)) == 40  # a rerun calls nobody
    more = rows.unionByName(spark.createDataFrame([(200, "new", "k")], "i int, p string, key string"))
    assert review.ask_once(more, "p", Counted(calls), store).where("answer IS NULL").count() == 1
    assert len(paid(calls)) == 41


def test_prompts_that_fail_have_an_error(spark, tmp_path, calls):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "i int, p string")
    got = review.ask_once(rows, "p", Counted(calls, fails=1), store, retries=2).collect()
    assert {(r.answer, r.error) for r in got} == {(None, "RuntimeError: busy")} and len(os.listdir(calls)) == 4
    assert review.ask_once(rows, "p", Counted(calls, fails=0), store).where("error IS NULL AND answer IS NOT NULL").count() == 2
    assert rows.where("false").transform(lambda x: review.ask_once(x, "p", Counted(calls), store)).count() == 0


def test_a_lost_task_asks_for_one_batch_again_at_most(spark, tmp_path, calls):
    store = str(tmp_path / "store")
    rows = spark.range(40).select(F.concat(F.lit("s"), F.col("id")).alias("p"))
    with pytest.raises(Exception):  # noqa: B017  the worker dies; a local session runs no task twice
        review.ask_once(rows, "p", Counted(calls, fails=0, dies="s30"), store, batch=5, tasks=1)
    before = len(paid(calls))
    assert review.ask_once(rows, "p", Counted(calls, fails=0), store, batch=5, tasks=1).where("answer IS NULL").count() == 0
    assert set(paid(calls)) == {f"s{i}" for i in range(40)} and 40 <= len(paid(calls)) <= 45 and before > 0
    assert not [n for n in os.listdir(store) if n.startswith(".") and not n.endswith(".crc")]
