"""Every query of the corpus operators, and the pipeline, on executors that cannot import the package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])
JOB = """
import sys
sys.path.insert(0, {root!r})  # the driver alone has the package
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
known = entry.queries()
for name in [n for n in known if n.startswith("op") and n[2].isdigit()] + ["pipeline"] + [n for n in ("average_cost", "backtest_fills") if n in known]:
    try:
        known[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("done", name, flush=True)
    except Exception as e:
        print("failed", name, str(e)[-400:], flush=True)
"""


def test_queries_where_executors_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", JOB.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    lines = ran.stdout.splitlines()
    assert not [x for x in lines if x.startswith("failed")], lines
    done = {x.split()[1] for x in lines if x.startswith("done")}
    assert {"pipeline", "op3_url_filter", "op8_benchmark_decontamination", "op13_vector_codes"} <= done and len(done) >= 14, ran.stderr[-2000:]
