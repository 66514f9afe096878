"""quirefold: analytics over ordered-document corpora, written for Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame.  Python code that runs on
executors is pickled by value, so a cluster needs only the listed third-party packages.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
