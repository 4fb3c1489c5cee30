"""wardline: prompt-security analytics as lazy PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python helpers travel to the executors inside their UDF, so the package need not
# be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
