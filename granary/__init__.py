"""Image-inventory and table analytics, expressed as Spark plans.

The package pickles its Python kernels by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
