"""Executors need no copy of this repository: every query runs with the package
on the driver's path only."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DRIVER = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as E
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.driver.host", "127.0.0.1").getOrCreate())

def there(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("chainlake") is not None] * b.num_rows)], ["there"])

assert spark.range(4).mapInArrow(there, "there boolean").where("there").count() == 0, "workers see the package"
for name in {names!r}:
    E.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("ran", name)
"""


def test_workers_without_the_package(tmp_path):
    names = [f"op{i}" for i in (1, 2, 4, 5, 6, 8, 9, 11, 13)]
    sys.path.insert(0, ROOT)
    import __spark_entry__ as E

    full = [q for q in E.queries() if q.split("_")[0] in names] + ["pipeline"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", DRIVER.format(root=ROOT, names=full)], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=900)
    assert [f"ran {n}" for n in full] == [x for x in run.stdout.splitlines() if x.startswith("ran ")], run.stderr[-3000:]
