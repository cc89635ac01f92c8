"""Operators that prepare text corpora for training: one module per operator, queries in ``queries``."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the query, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
