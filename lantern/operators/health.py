"""Health of an index: canary queries that must find known sections, checked again after a day or a change."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TTL_SECONDS = 24 * 3600
TOP = 8


def failures(canaries: DataFrame, results: DataFrame) -> DataFrame:
    """Canaries (query_id, expected) without their section among the results."""
    found = results.select(F.col("query_id").alias("f_query"), F.col("section_id").alias("f_section"))
    return canaries.join(found, (F.col("query_id") == F.col("f_query")) & (F.col("expected") == F.col("f_section")), "left_anti")


@dataclass
class HealthCheck:
    """Runs ``check`` (which returns failures) when due: at first, after ``ttl`` seconds, or for another index."""

    check: Callable[[], DataFrame]
    ttl: float = TTL_SECONDS
    clock: Callable[[], float] = time.monotonic
    checked: float | None = None
    fingerprint: tuple | None = None
    lock: Lock = field(default_factory=Lock)

    def due(self, fingerprint: tuple) -> bool:
        return self.fingerprint != fingerprint or self.checked is None or self.clock() - self.checked >= self.ttl

    def ensure(self, fingerprint: tuple) -> bool:
        """Whether a check was run; an error if canaries failed."""
        if not self.due(fingerprint):
            return False
        with self.lock:
            if not self.due(fingerprint):
                return False
            bad = [tuple(r) for r in self.check().limit(20).collect()]
            if bad:
                raise RuntimeError(f"the index no longer finds what it should: {bad}")
            self.fingerprint, self.checked = fingerprint, self.clock()
            return True
