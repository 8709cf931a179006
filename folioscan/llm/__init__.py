"""Operators for preparing training text: search, extraction, packing, filters and near-duplicates.

Their functions travel to the executors with the jobs, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
