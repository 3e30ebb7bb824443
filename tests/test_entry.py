"""The entry file with and without its optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q, s = set(e.queries()), set(e.oracle_sql()); assert s <= q; print(*sorted(q))"


def registered(tmp_path, without):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "roadpulse", copy / "roadpulse", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, copy)
    for name in without:
        gone = copy / name
        (shutil.rmtree if gone.is_dir() else os.remove)(gone)
    env = os.environ | {"PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}
    run = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return set(run.stdout.split())


@pytest.mark.skipif(not (ROOT / "roadpulse" / "llm").exists(), reason="already without them")
@pytest.mark.parametrize("without", [["roadpulse/llm"], ["roadpulse/llm", "corpus_pipeline.py"]])
def test_all_other_queries_are_registered_without_the_training_data_operators(tmp_path, without):
    from roadpulse.plans.queries import all_queries

    assert registered(tmp_path, without) == set(all_queries())
