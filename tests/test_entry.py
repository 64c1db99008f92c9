"""The driver's contract with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), len(s), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q, set(s) <= set(q))"


def said(folder, *more):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", "".join(more) + SAY], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.split()


def copied(folder, *without):
    shutil.copytree(ROOT, folder, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(d, n), ROOT) in without])
    return folder


@pytest.fixture(scope="module")
def rest(tmp_path_factory):
    return copied(tmp_path_factory.mktemp("rest") / "repo", "strandlake/llm", "tests/llm")


def test_without_the_subpackage_the_catalog_stays(rest):
    from strandlake.plans import catalog

    assert said(rest) == [str(len(catalog.QUERIES)), str(len(catalog.SQL)), "0", "False", "True"]


def test_without_the_pipeline_file_the_catalog_stays(tmp_path):
    from strandlake.plans import catalog

    n, _, _, pipeline, known = said(copied(tmp_path / "repo", "strandlake/llm", "tests/llm", "corpus_pipeline.py"))
    assert int(n) == len(catalog.QUERIES) and (pipeline, known) == ("False", "True")


def test_without_a_library_the_catalog_stays():
    from strandlake.plans import catalog

    gone = "import sys; sys.modules['public_tokenizers'] = None; "
    assert said(ROOT, gone)[0] == str(len(catalog.QUERIES))
