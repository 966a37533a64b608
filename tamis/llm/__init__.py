"""Operators for training-data pipelines. Nothing outside this folder imports it."""

import os
from pathlib import Path

from pyspark import cloudpickle

import tamis

# Python workers see PYTHONPATH. Where this package isn't on it, they get the functions themselves, which costs
# what workers otherwise keep from task to task.
if not any(p and Path(p).resolve() == Path(tamis.__file__).resolve().parents[1] for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
    cloudpickle.register_pickle_by_value(tamis)
