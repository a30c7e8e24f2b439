import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def names(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)})
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


@pytest.mark.parametrize("gone", [["llm"], ["llm", "corpus_pipeline.py"]])
def test_entry_stands_without_the_corpus_operators(tmp_path, gone):
    whole = names(ROOT)
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    left = names(copy)
    assert "clone_pairs" in left and not any(n.startswith("op") or n == "pipeline" for n in left)
    assert set(left) <= set(whole)


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "codeloam")):
        if os.sep + "llm" in folder:
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "llm" not in f.read(), name
