"""Spark-native data processing for labelled text corpora.

Subpackages: ``functions`` (column expressions), ``sources`` (strict readers), ``operators``
(DataFrame to DataFrame), ``streaming`` (Structured Streaming), ``plans`` (named queries).
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
