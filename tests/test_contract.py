"""The driver contract works from any working directory (fresh process)."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_mod", "{REPO}/__spark_entry__.py")
mod = importlib.util.module_from_spec(spec); spec.loader.exec_module(mod)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
df = mod.entry(spark)
rows = df.collect()
q = mod.queries(); o = mod.oracle_sql()
assert set(o) <= set(q) and len(o) >= 100
assert all(k.startswith('op') or k == 'pipeline' for k in set(q) - set(o))
cos = q["cosine_topk"](spark, "/root/testdata/sf0.001").collect()
print("OK", len(rows), df.columns, len(cos))
"""


def test_entry_contract_from_another_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    assert "OK" in out.stdout, out.stderr[-2000:]
