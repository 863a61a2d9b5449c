"""The bench runs to its end and prints one line with a time for every name."""

import json
import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_bench_prints_its_times():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"BENCH_SF_DIR": SF, "BENCH_CPUS": "4", "BENCH_REPEATS": "1", "BENCH_DRIVER_MEMORY": "4g"}
    run = subprocess.run([sys.executable, "bench.py"], cwd=root, env=env, capture_output=True, text=True, timeout=1200)
    assert run.returncode == 0, run.stderr[-2000:]
    said = json.loads(run.stdout.strip().splitlines()[-1])
    assert said["unit"] == "sec" and said["sf"] == "0.001" and said["value"] > 0
    assert {"read_paragraphs", "dataset_generation", "model_report", "streaming_rolling_context"} <= set(said["queries"])
    assert all(t > 0 for t in said["queries"].values())
