"""The driver's entry with and without the optional modules."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = set(e.queries()); assert set(e.oracle_sql()) <= q; print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


def loaded(folder, code=COUNT) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p and p != ROOT)}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=120).stdout.strip()


@pytest.fixture()
def copy(tmp_path):
    for name in ("duplika", "__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(source := f"{ROOT}/{name}"):
            (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    return tmp_path


@pytest.mark.parametrize("gone", [["duplika/llm", "corpus_pipeline.py"], ["duplika/llm"]], ids=["both", "folder"])
def test_without_the_document_operators(copy, gone):
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    count, ops, pipeline = loaded(copy).split()
    assert int(count) > 20 and ops == "0" and pipeline == "False"


def test_broken_imports_are_not_hidden(copy):
    if not os.path.isdir(copy / "duplika/llm"):
        pytest.skip("no document operators")
    with open(copy / "duplika/llm/queries.py", "a") as f:
        f.write("\nimport a_module_that_is_not_there\n")
    assert loaded(copy) == ""
