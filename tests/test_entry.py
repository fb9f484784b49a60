from __future__ import annotations

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names_in(folder) -> list[str]:
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    env = {**os.environ, "PYTHONPATH": str(folder)}
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, check=True)
    return done.stdout.split()


def test_entry_works_without_the_training_data_package(tmp_path):
    """Also with corpus_pipeline.py left behind, and with a folder that holds compiled files only."""
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py"))
    without = names_in(copy)
    assert "revenue_summary" in without and "pipeline" not in without and not any(n.startswith("op1") for n in without)
    (copy / "saleslake" / "llm" / "__pycache__").mkdir(parents=True)
    assert names_in(copy) == without
    if os.path.exists(f"{REPO}/corpus_pipeline.py"):
        shutil.copy(f"{REPO}/corpus_pipeline.py", copy)
        assert names_in(copy) == without
