"""The library without the operators for training data."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOOK = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n == 'pipeline' or n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_imports_without_them(tmp_path, pipeline):
    for name in ("catalog", "nearfold"):
        shutil.copytree(os.path.join(HERE, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(HERE, "__spark_entry__.py"), tmp_path)
    if pipeline:  # with the pipeline's file but not what it is made of
        (tmp_path / "corpus_pipeline.py").write_text("from nearfold.llm import quality\n")
    done = subprocess.run([sys.executable, "-c", LOOK], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
