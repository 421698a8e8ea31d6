"""fieldloom: Spark operators for large gridded fields and their latent codes.

Every operator is a plain ``DataFrame -> DataFrame`` function that works with
``df.transform(...)``.  Two table layouts are used throughout:

``cells``   one row per grid cell: key columns, ``i``, ``j`` and a value
``fields``  one row per (sample, channel): key columns and ``values``, a
            row-major array of one whole field

Operators that only look at a cell by itself take ``cells``.  Operators that
look at neighbours or at a field's own extremes take ``fields``, because a
packed row already holds everything they need and nothing has to be shuffled.
``operators.layout`` converts between the two.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions of this package travel to the executors by value, so workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
