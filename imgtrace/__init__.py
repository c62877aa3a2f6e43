"""Picture provenance on Spark: catalog merges, nearest-neighbour search,
coverage and fleet analytics, retrieval evaluation.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing is collected unless its docstring says so and checks a size.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Task closures carry this package's functions by value, so executors need no
# installed copy and no --py-files.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
