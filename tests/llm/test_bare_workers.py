"""All operator queries where Python workers have no copy of the library."""
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from riskloom.session import get_session
import __spark_entry__ as E
spark = get_session("bare-workers", 4, 4, {{"spark.driver.memory": "3g"}})

def there(_):
    import importlib.util
    return [importlib.util.find_spec("riskloom") is not None]

assert spark.sparkContext.parallelize([0], 1).mapPartitions(there).collect() == [False]
for name, fn in E.queries().items():
    if name.startswith("op"):
        print(name, fn(spark, {data!r}).count(), flush=True)
"""


def test_workers_need_no_copy_of_the_library(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, data=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1200)
    assert out.returncode == 0, out.stderr[-3000:]
    done = dict(line.split() for line in out.stdout.splitlines() if line.startswith("op"))
    assert {int(n[2:].split("_")[0]) for n in done if n[2:].split("_")[0].isdigit()} == set(range(1, 14)) and all(int(n) > 0 for n in done.values())
