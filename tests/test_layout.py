"""The suite is collected whole, with the folders for training data and without them."""

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("without", [(), ("ruleloom/llm", "tests/llm", "corpus_pipeline.py")], ids=["whole", "without"])
def test_every_test_file_is_collected(tmp_path, without):
    left = shutil.ignore_patterns(".git", "__pycache__", "*.json", ".pytest_cache", "spark-warehouse")
    copy = shutil.copytree(TOP, tmp_path / "copy", ignore=lambda folder, names: left(folder, names) | {
        name for name in names if os.path.relpath(os.path.join(folder, name), TOP) in without
    })
    run = subprocess.run(
        [sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "tests"],
        cwd=copy, capture_output=True, text=True, timeout=300,
    )
    assert run.returncode == 0, run.stdout[-2000:]
    for folder, _, files in os.walk(copy / "tests"):
        for name in files:
            if name.startswith("test_") and name.endswith(".py"):
                assert f"{os.path.relpath(os.path.join(folder, name), copy)}::" in run.stdout, name
