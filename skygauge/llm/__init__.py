"""Operators of a training-data pipeline. Nothing outside this folder imports it but the entry module.

Their Python helpers travel with the tasks, so that workers need not have this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
