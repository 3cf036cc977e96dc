"""lexweave: Spark-native analytics for study texts, word lists and the records around them.

Every operator takes and returns DataFrames; nothing is executed before the
caller asks for it, except where an operator states that it first measures
something bounded (heavy keys, accepted delimiters, Bloom filters).
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the plan, so the package
# needn't be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
