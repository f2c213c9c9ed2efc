"""Analytics over property graphs, and operators for training data, on PySpark.

Functions that run on executors are pickled by value, so that a cluster needs no
installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
