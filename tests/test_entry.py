"""The registration of queries without the training-data part."""

import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT

SHOW = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def _registered(repo):
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=repo, capture_output=True, text=True, check=True).stdout.splitlines()
    return out[0].split(), out[1].split()


def _copy(to, *without):
    shutil.copytree(ROOT, to, ignore=lambda at, names: [
        n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(at, n), ROOT) in without])
    return to


def test_own_queries_without_the_training_data_folders(tmp_path):
    from revlens.plans.queries import QUERIES

    for i, gone in enumerate([("revlens/llm", "tests/llm", "corpus_pipeline.py"), ("revlens/llm", "tests/llm")]):
        queries, sql = _registered(_copy(tmp_path / str(i), *gone))
        assert queries == sorted(QUERIES) and set(sql) <= set(queries)
