"""The registry without the folders of the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_stands_alone(tmp_path):
    """A copy without the folders, with and without the pipeline file: every other query is there."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", "*.json", "*.md"))
    ask = "import __spark_entry__ as e; n = set(e.queries()); print(len(n), len([x for x in n if x.startswith('op') or x == 'pipeline']), set(e.oracle_sql()) <= n)"
    for there in (True, False):
        if not there and (copy / "corpus_pipeline.py").exists():
            (copy / "corpus_pipeline.py").unlink()
        done = subprocess.run([sys.executable, "-c", ask], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        total, ours, whole = done.stdout.split()
        assert int(total) > 150 and ours == "0" and whole == "True"
