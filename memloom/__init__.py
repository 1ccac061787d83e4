"""memloom: conversation-memory analytics on PySpark.

Every operator takes DataFrames and returns a DataFrame; nothing is executed
until the caller asks for rows, except where a docstring says that an operator
runs a bounded aggregate first.

Functions of this package travel to the executors by value, so they need not
have it installed.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
