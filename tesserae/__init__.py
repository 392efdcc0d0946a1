"""Dataset curation, auditing and model-evaluation analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task code travels with the job, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
