"""The entry point in copies of the repository that lack the removable parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
COUNT = """
import __spark_entry__ as e
from corpusmill.plans.queries import QUERIES
named, sql = e.queries(), e.oracle_sql()
assert set(QUERIES) <= set(named), set(QUERIES) - set(named)
assert set(sql) <= set(named)
print(len(named) - len(QUERIES))
"""


@pytest.mark.parametrize("absent", [("corpusmill/llm", "corpus_pipeline.py"), ("corpusmill/llm",), ("corpus_pipeline.py",)])
def test_core_queries_load_without_the_removable_parts(tmp_path, absent):
    copy = tmp_path / "copy"
    copy.mkdir()
    for name in ("corpusmill", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if name in absent or not source.exists():
            continue
        if source.is_dir():
            left_out = [a.split("/")[1] for a in absent if a.startswith(f"{name}/")]
            shutil.copytree(source, copy / name, ignore=shutil.ignore_patterns("__pycache__", *left_out))
        else:
            shutil.copy(source, copy / name)
    ran = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    extra = int(ran.stdout)
    assert extra == 0 if not (copy / "corpusmill/llm").exists() else extra > 0
