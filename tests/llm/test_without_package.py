"""Executors need no copy of the package: every query runs from a folder that does not have it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_of_tests", sys.argv[1])
driver = importlib.util.module_from_spec(spec)
spec.loader.exec_module(driver)
from marlpit.runtime import local_session
spark = local_session("4")
spark.sparkContext.setLogLevel("OFF")
for name, run in driver.queries().items():
    if name.startswith("op") or name == "pipeline":
        try:
            run(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        except Exception as error:
            print("FAILED", name, str(error).splitlines()[-5:])
print("ALL RAN")
"""


def test_queries_run_from_a_foreign_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(
        [sys.executable, "-c", SCRIPT, os.path.join(ROOT, "__spark_entry__.py")],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900,
    ).stdout
    assert "ALL RAN" in out and "FAILED" not in out, out[-3000:]
