"""Operators of a training-data pipeline: filtering, deduplication, scoring and tokenising of document tables.

Nothing else in the library imports this subpackage. Its functions are pickled by value, so executors need no
installed copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
