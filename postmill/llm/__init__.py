"""Operators for training-data pipelines.

Task code is pickled by value, so workers need no copy of this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
