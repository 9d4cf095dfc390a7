"""Training-data operators: deduplication, decontamination, search, quality,
sharding, packing, HTML extraction and licence scans.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that these
# need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
