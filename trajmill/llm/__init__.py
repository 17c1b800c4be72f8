"""Operations of a training-data pipeline, one module each, and their queries.

Functions that run in tasks are sent by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
