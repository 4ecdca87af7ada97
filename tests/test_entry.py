"""The entry without its optional parts."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


def test_the_rest_works_without_the_pipeline(tmp_path):
    """Also where an empty folder is left of the subpackage."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    for left in (False, True):
        if left:
            (copy / "marlpit" / "llm" / "__pycache__").mkdir(parents=True)
        out = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0, out.stderr
        core, optional = map(int, out.stdout.split())
        assert core > 45 and optional == 0
