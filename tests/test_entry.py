"""The library without its training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q == 'pipeline' or q[:2] == 'op' and q[2:3].isdigit() for q in e.queries()))"


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_other_queries_remain_without_the_subpackage(tmp_path, pipeline_stays):
    copy = tmp_path / "repo"
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline_stays else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, copy, ignore=left_out)
    out = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 80 and int(out[1]) > 60
    assert out[2] == "False"
