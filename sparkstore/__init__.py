"""A content store on Spark: files, blobs, extents and journals as tables."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
