"""Executors do not have this package on their path."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from larder.functions.objective import compile_objective
from larder.plans.diets import optimize_diets
from larder.runtime import local_session
from larder.sources.html import extract_tables
spark = local_session("2", 2, "1g")
pages = spark.createDataFrame([(1, "<tbody><tr><td>a</td></tr></tbody>")], "p int, h string")
assert extract_tables(pages, "p", "h").first().cells == ["a"]
df = spark.createDataFrame([("s", 1, 2.0, 4.0)], "scenario string, item long, objective double, fat double")
assert df.select(compile_objective("gamma(fat) + gcd(item, 2)", df.schema)).first()[0] == 7.0
bounds = spark.createDataFrame([("s", "fat", 8.0, None)], "scenario string, nutrient_id string, lower double, upper double")
assert optimize_diets(df, bounds, ["fat"]).scenarios.first().objective == 4.0
"""


def test_functions_travel_with_their_job(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False
    )
    assert run.returncode == 0, run.stderr[-2000:]
