"""The log engine works in a copy of the repository without the corpus operators, with and without their pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'summary' in q; print(sum(k.startswith('op') or k == 'pipeline' for k in q))"


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_corpus(tmp_path, pipeline):
    leave = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=leave)
    done = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "0"
