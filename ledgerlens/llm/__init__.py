"""Training-data operators: contamination, duplicates, language, personal
data, urls, quality, token counts and byte-pair encoding, each as one Spark
job over whole tables. Nothing else in the library imports this package.

Functions that run in tasks are shipped with the job (by value), so executors
need not have the library installed; broadcast values are plain arrays,
tuples and dicts for the same reason.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
