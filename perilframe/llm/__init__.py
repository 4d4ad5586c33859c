"""Operators for training-data pipelines: deduplication, decontamination, scans, classifiers, packing, formatting."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, which then need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
