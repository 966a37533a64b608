"""An index whose log of commits is in the driver's memory, for tests and for indexes that live as long as a session."""

from __future__ import annotations

import threading
import time

from pyspark.sql import SparkSession

from tamis.sources.store import HadoopStore, State


class MemoryStore(HadoopStore):
    """Rows and metadata are files, as ever; which of them are live is known to this object alone."""

    def __init__(self, spark: SparkSession, root: str, cached: bool = True):
        super().__init__(spark, root, cached)
        self._states: list[tuple[float, State]] = []
        self._guard = threading.Lock()

    def _commits(self) -> dict[int, float]:
        return {s.number: at for at, s in self._states}

    def state(self, number: int | None = None) -> State:
        with self._guard:
            return next((s for _, s in reversed(self._states) if number is None or s.number <= number), State())

    def _publish(self, state: State, change: dict | None = None) -> bool:
        with self._guard:
            if self._states and self._states[-1][1].number >= state.number:
                return False
            self._states.append((time.time(), state))
            return True

    def _whole(self, commits: dict[int, float], old: int) -> int:
        return old

    def _forget(self, number: int) -> None:
        with self._guard:
            self._states = [x for x in self._states if x[1].number != number]
