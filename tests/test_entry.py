"""The entry point loads without the optional training-data package, or without what that package needs."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), sum(n.startswith('op') for n in q))"
BLOCK = "import sys; sys.modules['public_tokenizers'] = None; "


def counted(code, folder):
    run = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert not run.returncode, run.stderr
    return tuple(map(int, run.stdout.split()))


@pytest.fixture(scope="module")
def bare(tmp_path_factory):
    to = tmp_path_factory.mktemp("bare") / "repo"
    shutil.copytree(REPO, to, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    return to


def test_without_the_package(bare):
    n, optional = counted(COUNT, bare)
    assert n >= 113 and optional == 0


def test_with_the_pipeline_file_gone_too(bare, tmp_path):
    to = tmp_path / "repo"
    shutil.copytree(bare, to, ignore=shutil.ignore_patterns("corpus_pipeline.py"))
    assert counted(COUNT, to) == counted(COUNT, bare)


def test_without_the_tokenizers():
    n, optional = counted(BLOCK + COUNT, REPO)
    assert n >= 113 and optional == 0
