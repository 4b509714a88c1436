import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOWN = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("gone", [["velum/llm", "tests/llm", "corpus_pipeline.py"], ["velum/llm", "tests/llm"], ["corpus_pipeline.py"]])
def test_queries_without_the_training_data_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", SHOWN], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, some = said.stdout.split()
    assert int(n) > 100 and (some == "False" or "velum/llm" not in gone)
