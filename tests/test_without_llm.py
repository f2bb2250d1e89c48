"""The library, its queries and their SQL without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

CODE = "import __spark_entry__ as e; q = e.queries(); assert 'dta_compress' in q and not any(k.startswith('op') or k == 'pipeline' for k in q), sorted(q); assert set(e.oracle_sql()) <= set(q); import bench"


def test_queries_without_the_corpus_operators(tmp_path):
    root = tmp_path / "repo"
    shutil.copytree(Path(__file__).parents[1], root, ignore=shutil.ignore_patterns("llm", ".*", "__pycache__", "*.json"))
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            (root / name).unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", CODE], cwd=root, check=True, env={**os.environ, "PYTHONPATH": str(root)})
