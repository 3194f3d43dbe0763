"""The entry works in copies of the repository with and without the training-data part."""
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q), set(o) - set(q)
print(len(q), sum(n[:2] == "op" and n[2].isdigit() or n == "pipeline" for n in q))
"""


def listed(folder):
    done = subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    return tuple(map(int, done.stdout.split()))


@pytest.mark.parametrize("gone", [("kinweave/llm",), ("kinweave/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_without_the_training_data_part(tmp_path, gone):
    copy = tmp_path / "copy"
    skip = shutil.ignore_patterns(".git", "__pycache__", "*.json", "tests")
    shutil.copytree(ROOT, copy, ignore=skip)
    whole = listed(copy)
    for name in gone:
        target = copy / name
        shutil.rmtree(target, ignore_errors=True) if target.is_dir() else target.unlink(missing_ok=True)
    rest = listed(copy)
    assert rest[0] - rest[1] == whole[0] - whole[1] >= 240
    assert rest[1] == 0 or gone == ("corpus_pipeline.py",)


def test_other_absences_are_raised(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "tests"))
    (copy / "corpus_pipeline.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, capture_output=True, text=True)
    assert done.returncode != 0 and "no_such_module" in done.stderr
