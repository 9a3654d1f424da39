"""A document validation, transformation and rule engine on Spark Columns.

What runs in Python on executors travels by value, registries included: executors need
neither this package nor the modules in which functions were registered.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
