"""Document retrieval, term mining and term-graph analytics as plain PySpark DataFrame functions.

Functions of this package that run on executors are pickled by value, so a cluster
needs no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
