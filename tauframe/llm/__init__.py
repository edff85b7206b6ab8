"""Operators for training-data pipelines over document and page tables."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
