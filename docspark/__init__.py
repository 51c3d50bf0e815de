"""docspark: a PySpark-native engine for collections of JSON documents."""

import sys

from pyspark import cloudpickle

# Python workers get the functions that they run by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
