"""De novo clustering of DNA reads into taxonomic units, as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors get the few NumPy functions with the job and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
