import os
import subprocess
import sys

from pyspark import cloudpickle

from pairloom.plans.moments import coordinate_descent

LOAD = "import pickle, sys; print(pickle.load(sys.stdin.buffer).__name__)"


def test_functions_load_where_the_package_is_missing(tmp_path):
    env = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", LOAD], input=cloudpickle.dumps(coordinate_descent), cwd=tmp_path, env=env, capture_output=True
    )
    assert done.stdout.strip() == b"coordinate_descent", done.stderr
