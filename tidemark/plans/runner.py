"""Jobs of which only the latest counts: a newer one for the same name ends the older."""

from __future__ import annotations

import itertools
import threading
from collections.abc import Callable
from concurrent.futures import CancelledError, Future

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Runner:
    """Runs actions in the background, each under a name.

    Starting an action under a name that has one running interrupts that one's Spark jobs and drops its result: its
    future is cancelled. Futures of the latest actions hold their results or errors.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._numbers, self._lock = spark, itertools.count(), threading.Lock()
        self._latest: dict[str, tuple[str, Future]] = {}

    def run(self, name: str, action: Callable[[], object], then: Callable[[object], None] | None = None) -> Future:
        """Start action; then gets its result unless a newer action under that name has begun."""
        self.cancel(name)
        tag, future = f"tidemark-{id(self)}-{next(self._numbers)}", Future()
        with self._lock:
            self._latest[name] = (tag, future)

        def work() -> None:
            self.spark.addTag(tag)
            try:
                result = action()
            except Exception as error:  # noqa: BLE001
                self._settle(future, lambda: future.set_exception(error))
            else:
                if self._settle(future, lambda: future.set_result(result)) and then:
                    then(result)
            finally:
                self.spark.removeTag(tag)

        InheritableThread(target=work, daemon=True, session=self.spark).start()
        return future

    def _settle(self, future: Future, act: Callable[[], None]) -> bool:
        with self._lock:
            if future.cancelled():
                return False
            act()
            return True

    def cancel(self, name: str) -> None:
        """End what runs under a name, if anything does."""
        with self._lock:
            tag, future = self._latest.pop(name, (None, None))
            if future is None or future.done():
                return
            future.cancel()
        self.spark.interruptTag(tag)

    def cancel_all(self) -> None:
        for name in list(self._latest):
            self.cancel(name)

    def result(self, name: str, timeout: float | None = None) -> object:
        """What the latest action under a name gave; CancelledError if there is none."""
        held = self._latest.get(name)
        if held is None:
            raise CancelledError(name)
        return held[1].result(timeout)
