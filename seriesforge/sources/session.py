"""What a session needs before Python runs in its tasks."""

from __future__ import annotations

import sys
from types import ModuleType

from pyspark import cloudpickle


def ship_code(*packages: ModuleType) -> None:
    """Send the functions of these packages along with the tasks that call them.

    For clusters whose executors do not have the packages installed. This package always goes along.
    """
    for package in (sys.modules["seriesforge"], *packages):
        if package.__name__ not in cloudpickle.list_registry_pickle_by_value():
            cloudpickle.register_pickle_by_value(package)
