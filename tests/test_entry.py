"""The entry points, also in a copy of the tree from which the training-data subpackage has been deleted."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).parent.parent


def test_queries_have_names_and_sql():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values())


def test_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "fieldpress", tmp_path / "fieldpress", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(q[:2] == 'op' or q == 'pipeline' for q in [*e.queries(), *e.oracle_sql()]))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) > 40 and out.stdout.split()[1] == "0"


def test_other_import_errors_are_raised(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "fieldpress", tmp_path / "fieldpress", ignore=shutil.ignore_patterns("__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import not_there_at_all\n")
    env = {**os.environ, "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode != 0 and "not_there_at_all" in out.stderr
