"""Operators for preparing training data: deduplication, scoring, mixing, packing, search."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors as code, so that these need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
