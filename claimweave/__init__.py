"""Spark-native analytics for insurance claims, policy taxonomies, policy text,
embeddings, concept graphs and payment events.

Every operator is a plain function from DataFrames to DataFrames.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel with the plan, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
