"""spoorlens: trail-level biometric analytics as Spark DataFrame plans.

Sub-packages

* ``functions``  column expressions (labels, numbers, geometry, distances)
* ``sources``    readers, sinks and written stages
* ``operators``  relational and statistical operators on DataFrames
* ``plans``      composed pipelines and the registered queries
* ``streaming``  incremental counterparts
* ``llm``        training-data operators; optional, imported by nothing here
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to Python workers travel with the task, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
