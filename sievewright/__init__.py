"""A Spark-native evidence-retrieval and corpus-preparation engine.

Python functions that run on executors are pickled by value, so that a
cluster does not need this package installed on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
