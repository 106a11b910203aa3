"""The entry without the optional subpackage."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _copy_without(folder, *left_out):
    def ignore(path, names):
        here = os.path.relpath(path, REPO)
        return [n for n in names if n in (".git", "__pycache__") or os.path.normpath(os.path.join(here, n)) in left_out]

    shutil.copytree(REPO, folder, ignore=ignore)


def _entry_keys(folder):
    code = "import __spark_entry__ as e; print(sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120,
                          env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    return done.stdout


def test_entry_without_the_corpus_folders(tmp_path):
    """Both folders gone, the pipeline file left or gone as well: the other queries stay."""
    for name, extra in (("kept", ()), ("gone", ("corpus_pipeline.py",))):
        folder = tmp_path / name
        _copy_without(folder, "tidings/llm", "tests/llm", *extra)
        keys = _entry_keys(folder)
        assert "'company_tag'" in keys and "op1_simhash" not in keys and "'pipeline'" not in keys


def test_entry_with_an_emptied_corpus_folder(tmp_path):
    folder = tmp_path / "empty"
    _copy_without(folder, "tidings/llm", "tests/llm")
    (folder / "tidings" / "llm").mkdir()
    assert "'pipeline'" not in _entry_keys(folder)
