"""A timer and scoped settings for the driver."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

UNITS = {"ns": 1, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000}


class Timing(contextlib.ContextDecorator):
    """Wall-clock time of a block, as self.took in a unit; on_exit gets it."""

    def __init__(self, prefix: str = "", on_exit: Callable[[float], object] | None = None, enabled: bool = True, unit: str = "ms", say: Callable[[str], object] = print):
        self.prefix, self.on_exit, self.enabled, self.unit, self.say, self.took = prefix, on_exit, enabled, unit, say, 0.0

    def __enter__(self) -> Timing:
        self._from = time.perf_counter_ns()
        return self

    def __exit__(self, *_: object) -> None:
        self.took = (time.perf_counter_ns() - self._from) / UNITS[self.unit]
        if self.enabled:
            self.say(f"{self.prefix}{self.took:.2f} {self.unit}")
        if self.on_exit:
            self.on_exit(self.took)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: object) -> Iterator[None]:
    """Session settings (dots as __) that hold inside a block and are put back after it."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, str(v).lower() if isinstance(v, bool) else str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
