"""The operators ship their code: workers that can't import the package run them all the same."""

import os
import subprocess
import sys


def test_workers_get_the_package(sf, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from lexispark.session import build_session
import __spark_entry__ as entry
spark = build_session(master="local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
for name in ("op8_substring_dedup", "op9_token_counts", "op10_simhash", "op1_kd_top_k", "op2_sentencepiece"):
    assert entry.queries()[name](spark, {sf!r}).count() > 0, name
"""
    path = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
