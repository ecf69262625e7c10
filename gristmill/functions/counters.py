"""Counters of a run: what passes through its stages, observed while the run's own jobs do their work."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Counters:
    """Counts and sums of named stages. They fill when an action runs what was watched; no job is added."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        """Forgets all stages, as for the next run."""
        self._seen: dict[str, Observation] = {}
        self._began = time.time()

    def watch(self, rows: DataFrame, stage: str, **measures: Column) -> DataFrame:
        """The rows, whose number and further aggregates are kept under the stage's name; each name once in a run."""
        if stage in self._seen:
            raise ValueError(f"stage {stage!r} is watched already")
        self._seen[stage] = Observation(stage)
        return rows.observe(self._seen[stage], F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in measures.items()])

    def snapshot(self, wait: float = 2.0) -> dict[str, dict | None]:
        """What each stage has counted, in the order they were watched; None for one that has not run whole.

        Counts arrive shortly after the action that fills them, so this waits up to `wait` seconds for missing ones.
        """
        until = time.time() + wait
        while time.time() < until and not all(o._jo.future().isCompleted() for o in self._seen.values()):
            time.sleep(0.02)
        return {name: dict(o.get) if o._jo.future().isCompleted() else None for name, o in self._seen.items()}

    def attach(self, metadata: Mapping) -> dict:
        """Metadata of a run with its counters and seconds so far."""
        return {**metadata, "counters": self.snapshot(), "seconds": round(time.time() - self._began, 3)}


def timed(counters: Counters, stage: str, **measures: Column):
    """A decorator of functions that return a DataFrame: the result is watched under the stage's name."""

    def wrap(f):
        def run(*args, **kwargs) -> DataFrame:
            return counters.watch(f(*args, **kwargs), stage, **measures)

        return run

    return wrap
