import importlib
import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_names(spark):
    driver = importlib.import_module("__spark_entry__")
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_the_rest_without_the_training_data_operators(tmp_path):
    """The repository without their two folders and the pipeline: it imports, its other tests are found, and some run."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    assert not (copy / "tensorloom" / "llm").exists() and not (copy / "tests" / "llm").exists()
    code = """
import __spark_entry__ as e
names = set(e.queries())
assert "pipeline" not in names and not any(n.startswith("op1_") for n in names) and len(names) > 200, len(names)
assert set(e.oracle_sql()) <= names
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True)
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=copy, env=env, capture_output=True, text=True)
    assert found.returncode == 0, found.stdout[-2000:]
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_linalg.py"], cwd=copy, env=env, check=True)


def test_nothing_else_imports_the_training_data_operators():
    for folder, _, files in os.walk(os.path.join(REPO, "tensorloom")):
        for f in files:
            if f.endswith(".py") and not folder.endswith("llm"):
                text = open(os.path.join(folder, f)).read()
                assert "tensorloom.llm" not in text and "corpus_pipeline" not in text, f


def test_no_local_folder_on_a_cluster():
    from tensorloom.sources import cut

    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError):
        cut.shared_folder(Session)
