"""A PySpark-native analytics engine for annotation, similarity-network, spatial and raster pipelines."""

import sys

from pyspark import cloudpickle

# functions travel to the executors whole, so workers need no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
