"""The entry without the subpackage for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print(len(e.queries()), sorted(e.oracle_sql())[:1], any(n.startswith('op') for n in e.queries()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_llm(tmp_path, pipeline):
    here = tmp_path / "copy"
    shutil.copytree(REPO, here, ignore=lambda d, names: {"llm", ".git", "__pycache__"} & set(names))
    if not pipeline:
        (here / "corpus_pipeline.py").unlink()
    out = subprocess.run([sys.executable, "-c", ASK], cwd=here, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 30 and out[-1] == "False"


def test_missing_package_inside_llm_shows(tmp_path):
    """Only an absent folder counts as absent: an import that fails inside it is an error."""
    here = tmp_path / "copy"
    shutil.copytree(REPO, here, ignore=lambda d, names: {"tests", ".git", "__pycache__"} & set(names))
    if not (here / "strata/llm").is_dir():
        pytest.skip("no such folder here")
    (here / "strata/llm/queries.py").write_text("import not_there\n")
    run = subprocess.run([sys.executable, "-c", ASK], cwd=here, capture_output=True, text=True)
    assert run.returncode != 0 and "not_there" in run.stderr
