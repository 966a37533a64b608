"""tamis: keyword search over schemaless JSON rows and documents, planned by Spark."""

import os
import sys
from pathlib import Path

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers see PYTHONPATH. Where this package isn't on it, they get the functions themselves, which costs
# what workers otherwise keep from task to task.
if not any(p and Path(p).resolve() == Path(__file__).resolve().parents[1] for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
