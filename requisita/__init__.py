"""Reconciliation of scanned requisitions with a movement ledger, on PySpark.

Functions that run on executors are pickled by value, so a cluster needs no copy
of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
