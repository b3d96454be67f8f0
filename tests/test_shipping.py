"""Queries with Python helpers, run by workers that find the package only because it is shipped."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
from quillon import catalogue
for name in sys.argv[1:]:
    catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    print("done", name, flush=True)
"""
QUERIES = """bootstrap_paired bootstrap_stratified run_comparison_intervals paired_inference collected_answers near_duplicate_sequence
ordered_id_digest file_manifest stop_strings nested_violations exact_duplicate_groups_full_key""".split()


def test_workers_without_the_repository(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", SCRIPT, *QUERIES], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert [line.split()[1] for line in ran.stdout.splitlines() if line.startswith("done ")] == QUERIES, ran.stderr[-3000:]
