"""The contract module without the training-data operators or their libraries."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]

_WITHOUT = """
import sys, warnings
sys.path.insert(0, {root!r})
sys.modules.update(dict.fromkeys({missing!r}))
with warnings.catch_warnings(record=True) as caught:
    warnings.simplefilter("always")
    import __spark_entry__ as contract
names = set(contract.queries())
print(len([n for n in names if n.startswith("op") or n == "pipeline"]), len(names), set(contract.oracle_sql()) <= names)
print([str(w.message) for w in caught if "training-data" in str(w.message)])
"""


def run(root, missing=()):
    code = _WITHOUT.format(root=str(root), missing=list(missing))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd="/")
    return done.returncode, done.stdout.strip().splitlines(), done.stderr


@pytest.fixture
def copy(tmp_path):
    """The library alone, as it is when both folders are taken out."""
    shutil.copytree(ROOT / "basketflow", tmp_path / "basketflow", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_both_folders_and_the_pipeline_deleted(copy):
    status, printed, error = run(copy)
    assert status == 0, error
    operators, queries, covered = printed[0].split()
    assert operators == "0" and int(queries) >= 46 and covered == "True"
    assert printed[1] == "[]"


@pytest.mark.parametrize("library", ["xxhash", "tiktoken", "zstandard"])
def test_missing_library_takes_only_the_operators_that_need_it(library):
    if not (ROOT / "basketflow" / "llm").exists():
        pytest.skip("taken out")
    status, printed, error = run(ROOT, [library])
    assert status == 0, error
    assert printed[0].split()[0] == "0" and int(printed[0].split()[1]) >= 46
    assert library in printed[1]


def test_other_missing_modules_are_errors():
    status, _, error = run(ROOT, ["pyspark"])
    assert status != 0 and "pyspark" in error
