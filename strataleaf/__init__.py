"""A Spark engine for document structure: records in, section trees and tables out."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# Decoders run in Python workers; pickled by value, they need no copy of the package there.
register_pickle_by_value(sys.modules[__name__])
