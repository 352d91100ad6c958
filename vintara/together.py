"""Independent Spark actions submitted side by side.

A small fit or a summary rarely fills a cluster; submitting independent ones from
separate threads lets the scheduler overlap them.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def together(*actions: Callable) -> list:
    """Run the actions concurrently and return their results in order."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=len(actions)) as pool:
        return [f.result() for f in [pool.submit(inherit(a)) for a in actions]]
