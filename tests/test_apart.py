"""What is left when the training-data folders are deleted."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import __spark_entry__ as e
found, sql = e.queries(), e.oracle_sql()
assert "ppr_rbac" in found and set(sql) <= set(found)
assert not any(q.startswith("op") and "_" in q and q[2:].split("_")[0].isdigit() for q in found) and "pipeline" not in found
"""


@pytest.mark.parametrize("pipeline_stays", [False, True])
def test_the_rest_imports_without_the_training_data_folders(tmp_path, pipeline_stays):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(copy / "skein/llm", ignore_errors=True)
    shutil.rmtree(copy / "tests/llm", ignore_errors=True)
    if not pipeline_stays:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    env = os.environ | {"PYTHONPATH": f"{copy}:{os.environ.get('PYTHONPATH', '')}", "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env=env, check=True)
    if not pipeline_stays:
        # Of the tests that stay, some that are quick enough to be run twice; the others are imported.
        ran = subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_operators.py", "tests/test_imports.py"], cwd=copy, env=env, capture_output=True, text=True)
        assert ran.returncode == 0, ran.stdout[-2000:]
    collected = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, env=env, capture_output=True, text=True)
    assert collected.returncode == 0, collected.stdout[-2000:]
