"""Medical-text classification as Spark jobs.

Sub-packages: ``sources`` (readers and writers), ``functions`` (column expressions and the page
parser), ``operators`` (DataFrame-to-DataFrame steps and learners), ``plans`` (scale helpers and
the dataset / classifier front end) and ``streaming``.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job: the package is needed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
