"""The registry without the training-data folder, with an empty leftover of it, or without a module it needs."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys, warnings
{before}
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    import __spark_entry__ as e
    names, sql = set(e.queries()), set(e.oracle_sql())
assert sql <= names and "p2_screen_to_calls" in names and len(names) > 100, len(names)
assert not any(n.startswith("op") or n == "pipeline" for n in names), names
print([str(w.message) for w in said])
"""


@pytest.mark.parametrize("case", ["gone", "leftover", "blocked"])
def test_core_queries_without_the_training_data_operators(tmp_path, case):
    shutil.copytree(ROOT / "strandloom", tmp_path / "strandloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    before = ""
    if case == "leftover":
        (tmp_path / "strandloom/llm/__pycache__").mkdir(parents=True)
    if case == "blocked":
        if not (ROOT / "strandloom/llm/queries.py").exists():
            pytest.skip("the folder is not there")
        shutil.copytree(ROOT / "strandloom/llm", tmp_path / "strandloom/llm", ignore=shutil.ignore_patterns("__pycache__"))
        before = "sys.modules['xxhash'] = None"
    run = subprocess.run([sys.executable, "-B", "-c", SCRIPT.format(before=before)], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    assert "left out" in run.stdout


def test_a_missing_pipeline_leaves_the_operators(tmp_path):
    if not (ROOT / "strandloom/llm/queries.py").exists():
        pytest.skip("the folder is not there")
    shutil.copytree(ROOT / "strandloom", tmp_path / "strandloom", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    script = "import __spark_entry__ as e; n = set(e.queries()); assert 'op4_exact_dedup' in n and 'pipeline' not in n"
    assert subprocess.run([sys.executable, "-B", "-c", script], cwd=tmp_path, capture_output=True, timeout=120).returncode == 0
