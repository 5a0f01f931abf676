"""Operators for building training corpora.

Nothing else in the library imports this package.  The functions that run on
executors travel with the job (pickled by value), so the executors need no
copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
