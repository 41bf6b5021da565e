"""A deadline for queries: what runs longer is cancelled on the cluster."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Late(TimeoutError):
    pass


def within(spark: SparkSession, seconds: float, run: Callable[[], object]) -> object:
    """run()'s result; Late if its jobs take longer. Only the jobs that run() starts in this thread are cancelled."""
    context = spark.sparkContext
    tag, late = f"deadline-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        out = run()
    except Exception as error:
        if late.is_set():
            raise Late(f"more than {seconds} s") from error
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    return out
