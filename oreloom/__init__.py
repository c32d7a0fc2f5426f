"""oreloom: a PySpark-native analytics engine for technical-report corpora and plant scenarios."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to Python workers by value, so that executors need no installed copy of it.
register_pickle_by_value(sys.modules[__name__])
