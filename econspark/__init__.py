"""Descriptive statistics and econometrics on Spark DataFrames of any size."""

import sys

from pyspark import cloudpickle

# The small helpers that run inside tasks travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
