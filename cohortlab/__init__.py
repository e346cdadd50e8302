"""Cohort analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task-side helpers travel with the job; executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
