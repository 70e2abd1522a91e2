"""Field-measurement analytics on Spark: versioned ingest, curated mart, profiling and model evaluation."""

import sys

from pyspark import cloudpickle

# Helper functions used inside tasks travel with the task, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
