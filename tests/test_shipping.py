"""Functions that run in tasks must load where the package is not installed."""

from __future__ import annotations

import subprocess
import sys

import pytest
from pyspark import cloudpickle

from econspark.functions import dist
from econspark.operators import normality, ols
from econspark.plans import moments


@pytest.mark.parametrize(
    "fn",
    [
        normality._shapiro_p_col.func,
        dist.t_two_sided_col.func,
        dist.f_sf_col.func,
        dist.chi2_sf_col.func,
        moments._partial_moments(["a", "b"]),
        moments._merge_rows(["a", "b"]),
        ols._fit_function("y", ["x"], True, 10),
        ols._link_coefficients,
    ],
    ids=lambda f: f.__qualname__,
)
def test_loads_without_the_package(fn, tmp_path):
    data = cloudpickle.dumps(fn)
    code = "import pickle, sys; sys.path[:] = [p for p in sys.path if p]; pickle.load(sys.stdin.buffer)"
    done = subprocess.run([sys.executable, "-c", code], input=data, capture_output=True, cwd=tmp_path, timeout=60)
    assert done.returncode == 0, done.stderr.decode()[-500:]
