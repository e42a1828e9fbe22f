"""Queries with Python workers, started from a folder where nothing of the library lies."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

PROGRAM = """
import importlib.util, sys
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
# The driver finds the library, the workers that are forked later do not.
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry

sys.path.remove({repo!r})
queries = entry.queries()
for name in {names!r}:
    print(name, queries[name](spark, {sf_dir!r}).count(), flush=True)
"""


def test_workers_need_no_path(tmp_path):
    names = [f"op{n}_" for n in (1, 2, 3, 4, 6, 7, 10, 11, 13)]
    sys.path.insert(0, REPO)
    import __spark_entry__ as entry

    chosen = [q for q in entry.queries() if q.startswith(tuple(names))] + ["pipeline", "log_mel", "map_windows", "sync_lag", "job_state_stream"]
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    program = PROGRAM.format(repo=REPO, names=chosen, sf_dir=SF_DIR)
    run = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-3000:]
    assert len(run.stdout.split("\n")) > len(chosen)
