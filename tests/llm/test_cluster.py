"""Workers without a copy of the package, and tasks that are lost: in a process of its own, whose workers do not find the package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
HEAD = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3")
    .config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.driver.memory", "2g").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
SF = "/root/testdata/sf0.001"
def found(batches):
    import importlib.util
    import pyarrow as pa
    for _ in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("quillframe") is not None])], names=["x"])
assert [r["x"] for r in spark.range(1).mapInArrow(found, "x boolean").collect()] == [False]
"""


def run(code, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", HEAD + code, str(folder)], cwd=folder, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


def test_workers_without_the_package(tmp_path):
    out = run(
        """
import corpus_pipeline
from quillframe.llm import queries
for name, query in {**queries.QUERIES, "pipeline": corpus_pipeline.run}.items():
    print(name, query(spark, SF).count())
""",
        tmp_path,
    )
    assert len(out.split("\n")) == 15


@pytest.mark.parametrize("after", ["write", "normalise"])
def test_pages_count_once_when_a_task_is_lost(tmp_path, after):
    """A task that dies after it has closed its first archive runs again; what it left is not read."""
    out = run(
        f"""
import os
from quillframe.llm import warc
mark, after, close = sys.argv[1] + "/died", {after!r}, warc._File.close
def dies(self):
    close(self)
    own = "warc-raw" in self.place if after == "write" else self.place.endswith(".warc.gz") and "warc-raw" not in self.place
    if own and not os.path.exists(mark):
        open(mark, "w").close()
        raise OSError("lost")
warc._File.close = dies
write = warc.write_archives
warc.write_archives = lambda pages, folder: write(pages, folder, roll=20_000)
pages = spark.createDataFrame([(i, f"http://x/{{i}}", f"body {{i}} " * 200) for i in range(200)], "page_id long, url string, html string")
rows = warc.round_trip(pages).collect()
assert os.path.exists(mark)
print(len(rows), len({{r["page_id"] for r in rows}}))
""",
        tmp_path,
    )
    assert out.split() == ["200", "200"]
