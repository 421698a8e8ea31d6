"""Workers need no copy of the package: its functions travel with the tasks."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from fieldloom.session import local_session
spark = local_session(2, 2)
for name in ("n11_ema", "w01_assemble_stream", "s04_decode_npy"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_queries_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE, str(REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]
