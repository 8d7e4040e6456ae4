"""Web-crawl analytics expressed as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Executors get the few Python functions with the job, so nothing has to be
# installed or shipped to them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
