"""textsim: corpus-scale text similarity, copy detection and style scoring on Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python helpers used inside UDFs travel with the task (pickled by value), so
# executors need no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
