"""Queries with Python workers run wherever the driver was started."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from contentgauge.session import local_session
import __spark_entry__ as entry
spark = local_session(2)
print("rows", entry.queries()["h19_salvaged_questions"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0 and "rows" in done.stdout, done.stderr[-2000:]
