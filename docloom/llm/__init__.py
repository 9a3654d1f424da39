"""Operators for training-data pipelines, each on plain DataFrames.

Functions that run on executors travel by value, so that executors need only
numpy, pyarrow and the third-party libraries, never a copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
