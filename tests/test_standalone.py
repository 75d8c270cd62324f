"""The library without its optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_training_data_queries(tmp_path):
    """A copy without the subpackage, with and without the pipeline, lists all other queries."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = (
        "import __spark_entry__ as e; q = e.queries(); "
        "assert e.llm is None and e.corpus_pipeline is None; "
        "assert 'pipeline' not in q and not any(n.startswith('op1') for n in q); "
        "assert set(e.oracle_sql()) <= set(q); print(len(q))"
    )
    env = {**os.environ, "PYTHONPATH": str(copy)}
    for gone in (None, "corpus_pipeline.py"):
        if gone and (copy / gone).exists():
            (copy / gone).unlink()
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        assert int(done.stdout) > 70
