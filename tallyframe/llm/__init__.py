"""Operators for large text and embedding corpora (see registry.py).

Functions of this package that run in Python workers are sent by value, so
executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
