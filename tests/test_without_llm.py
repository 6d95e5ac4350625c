"""The rest of the repository without the folders of the text subpackage: it imports, and its tests pass."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.skipif("TRELLIQ_WITHOUT_LLM" in os.environ, reason="runs itself")
def test_the_rest_works_alone(tmp_path):
    ignored = shutil.ignore_patterns("llm", "__pycache__")
    for name in ("trelliq", "tests"):
        shutil.copytree(REPO / name, tmp_path / name, ignore=ignored)
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p5_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    # Quick ones of each kind; the whole suite runs without the folders in the same way.
    some = ["tests/test_text.py", "tests/test_skew.py", "tests/test_queries_match_sql.py", "-k", "test_rules or test_figures or p5_ or load_counts or every_sql or entry"]
    subprocess.run([sys.executable, "-m", "pytest", "-x", "-q", *some], cwd=tmp_path, check=True, env=os.environ | {"TRELLIQ_WITHOUT_LLM": "1"})
