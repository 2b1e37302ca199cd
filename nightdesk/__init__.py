"""nightdesk: security-event, web-access and service-desk analytics on PySpark.

Every public operator is a DataFrame -> DataFrame function.  Nothing here runs
an action: plans stay lazy until the caller writes or collects them.
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the plan, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
