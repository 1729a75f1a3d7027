"""The registered queries without the operations that may be absent."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
PROGRAM = """
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 60 and set(e.oracle_sql()) <= names
assert not [n for n in names if n == "pipeline" or n[:2] == "op" and n[2].isdigit()]
"""


def test_import_without_the_training_data_package(tmp_path):
    left_out = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "tests")
    shutil.copytree(REPO, tmp_path / "repo", ignore=left_out)
    subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path / "repo", check=True, timeout=100)


def test_nothing_else_imports_the_package():
    for path in (REPO / "corpusloom").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "corpusloom.llm" not in path.read_text()
