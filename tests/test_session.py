"""A session without any configured checkpoint folder works locally (in a process of its own)."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from cohortlens.session import ensure_checkpoint_dir, get_spark, materialize
spark = get_spark(master="local[1]", shuffle_partitions=1)
assert materialize(spark.range(3), "t").count() == 3
assert spark.range(3).checkpoint().count() == 3

class Cluster:
    class conf:
        get = staticmethod(lambda key, default: default)
    class sparkContext:
        master = "spark://host:7077"

try:
    ensure_checkpoint_dir(Cluster)
except RuntimeError as e:
    assert "spark.checkpoint.dir" in str(e)
else:
    raise SystemExit("no error on a cluster without a shared folder")
"""


def test_without_a_configured_folder():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True, timeout=300, env=os.environ | {"BENCH_DRIVER_MEMORY": "1g"})
