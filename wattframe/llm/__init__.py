"""Operators of a training-data pipeline: de-duplication, decontamination, extraction, mixing, scoring.

Nothing else in the library imports this package.  Functions that run in Python workers are sent to
them by value, so a cluster needs none of these files on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
