"""Operators for preparing training text: deduplication, classification, mixing, tokens and vector search."""

import sys

from pyspark import cloudpickle

# workers get these modules with the functions sent to them and need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
