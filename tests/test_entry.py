"""The entry module with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), set(s) <= set(q))"


@pytest.mark.parametrize("gone", [["tabmine/llm", "corpus_pipeline.py"], ["tabmine/llm"]])
def test_entry_without_the_corpus_part(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        elif (copy / name).exists():
            (copy / name).unlink()
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 90 and out[1:] == ["0", "True"]
