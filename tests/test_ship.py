"""Library functions find the package on workers that don't have it on their path."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys, tempfile
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from marlstone.functions import scalars
from marlstone.sources import connectors, readers
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
asked = sys.argv[2] + "/asked"
def fetch(url):
    with open(asked, "a") as f:
        f.write(url + "\\n")
    return (404, "") if url == "u3" else (200, "body of " + url)
wanted = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("b", "u2"), ("c", "u3"), ("d", "u4")], "key string, url string")
cache = spark.createDataFrame([("d", "old", 5)], "key string, value string, created_at long")
out = connectors.read_through(wanted, cache, fetch, 9)
print("ROWS", sorted(tuple(r) for r in out.collect()), out.count(), sorted(open(asked).read().split()))
html = spark.createDataFrame([(1, "<table><tr><td>x</td><td>y</td></tr></table>")], "id int, h string")
print("HTML", [list(r.cells) for r in readers.html_rows(html, "id", "h").collect()])
print("TERMS", html.select(scalars.matched_terms(F.lit("a b"), ["b", "c"]).alias("m")).first().m)
"""


def test_without_the_package_on_the_workers_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = str(Path(__file__).resolve().parent.parent)
    (tmp_path / "work").mkdir()
    (tmp_path / "script.py").write_text(SCRIPT)
    run = subprocess.run([sys.executable, str(tmp_path / "script.py"), repo, str(tmp_path)], cwd=tmp_path / "work", env=env, capture_output=True, text=True, timeout=200)
    assert run.returncode == 0, run.stderr[-2000:]
    assert "ROWS [('a', 'body of u1', 9), ('b', 'body of u2', 9), ('d', 'old', 5)] 3 ['u1', 'u2', 'u3']" in run.stdout
    assert "HTML [['x', 'y']]" in run.stdout and "TERMS ['b']" in run.stdout
