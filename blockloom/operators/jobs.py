"""Long jobs (dedupe runs, backups) that can be stopped: each runs in a job group of its own."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Job:
    """A function of no arguments, run in another thread under a job group."""

    def __init__(self, spark: SparkSession, name: str, work: Callable[[], Any]):
        self.spark, self.name, self.result, self.error, self.aborted = spark, name, None, None, False

        def run() -> None:
            spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
            try:
                self.result = work()
            except Exception as e:  # given to whoever waits
                self.error = e

        self.thread = InheritableThread(target=run, daemon=True)
        self.thread.start()

    def state(self) -> str:
        if self.thread.is_alive():
            return "running"
        return "aborted" if self.aborted and self.error else "failed" if self.error else "done"

    def abort(self, wait: float = 30.0) -> str:
        """Cancels what runs; what it hasn't published doesn't exist."""
        self.aborted = True
        end = wait
        while self.thread.is_alive() and end > 0:
            self.spark.sparkContext.cancelJobGroup(self.name)
            self.thread.join(0.5)
            end -= 0.5
        return self.state()

    def wait(self) -> Any:
        self.thread.join()
        if self.error:
            raise self.error
        return self.result
