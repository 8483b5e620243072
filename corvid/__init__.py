"""corvid: corpus audit, curation and evaluation operators on Spark DataFrames.

Functions that run in Python workers are pickled by value, so a cluster needs
no installed copy of this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
