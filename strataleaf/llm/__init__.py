"""Operators for preparing training data: ten stages from language ID to HTML extraction.

Nothing outside this package imports it. Functions that run in Python workers
are pickled by value, so executors need no copy of this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
