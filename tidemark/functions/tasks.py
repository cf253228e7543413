"""Functions that run in Python tasks."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(module: str) -> None:
    """Send the module's functions to executors inside the task, so none needs the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
