"""faultlens: sensor-fault analytics for machine fleets, written as Spark jobs."""

import sys

from pyspark import cloudpickle

from faultlens.schema import ANALOGUE, DIGITAL, SENSORS
from faultlens.session import checkpoint_dir, session

__all__ = ["ANALOGUE", "DIGITAL", "SENSORS", "checkpoint_dir", "session"]

# Ship our helper functions with the tasks: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
