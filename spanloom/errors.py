"""Errors and optional limits."""

from __future__ import annotations

import signal
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


#: Seconds that a cancelled job has to end before the driver is interrupted.
GRACE = 1.0


class InputError(Exception):
    """Input or settings that no result can be made from; not a ValueError, so that checks of single values never swallow it."""


class LimitError(InputError):
    """A guard was exceeded."""


@dataclass(frozen=True)
class Limits:
    """Guards for interactive use; None is no limit. They are counted, never used to cut a result."""

    input_bytes: int | None = 8 << 20
    files: int | None = 32
    line_bytes: int | None = 65_536
    events: int | None = 5_000
    occurrences: int | None = 20_000
    pairs: int | None = 20_000
    report_bytes: int | None = 8 << 20
    periods: int | None = 20_000
    intervals: int | None = 100_000
    windows: int | None = 20_000
    candidates: int | None = 200_000
    resolutions: int | None = 200_000

    @classmethod
    def none(cls) -> Limits:
        return cls(*[None] * len(fields(cls)))

    @classmethod
    def lowered(cls, **given: int | None) -> Limits:
        """Limits with some of them lowered; those given as None stay. They are positive and never over the usual ones."""
        for name, value in given.items():
            if value is not None and not 0 < value <= getattr(cls(), name):
                raise InputError(f"the {name} limit is positive and at most {getattr(cls(), name)}")
        return cls(**{k: v for k, v in given.items() if v is not None})

    def check(self, name: str, count: int) -> int:
        most = getattr(self, name)
        if most is not None and count > most:
            raise LimitError(f"{name} limit exceeded ({most})")
        return count


def _on_main() -> bool:
    return threading.current_thread() is threading.main_thread()


@contextmanager
def terminable() -> Iterator[None]:
    """SIGTERM interrupts its body as Ctrl-C does, so that what has been begun is cleaned up."""
    if not _on_main():
        yield
        return

    def stop(*_) -> None:
        raise KeyboardInterrupt

    before = signal.signal(signal.SIGTERM, stop)
    try:
        yield
    finally:
        signal.signal(signal.SIGTERM, before)


@contextmanager
def undisturbed() -> Iterator[None]:
    """Signals that would interrupt its body wait for its end."""
    held = signal.pthread_sigmask(signal.SIG_BLOCK, {signal.SIGINT, signal.SIGTERM, signal.SIGALRM})
    try:
        yield
    finally:
        signal.pthread_sigmask(signal.SIG_SETMASK, held)


@contextmanager
def deadline(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Ends its body, and raises, once it has run for ``seconds``: its Spark jobs are cancelled, and what the driver does by itself is interrupted."""
    if seconds is None:
        yield
        return
    context, group, late = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    def interrupt(*_) -> None:
        late.set()
        raise LimitError("late")

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "bounded in time", True)
    timer.start()
    if _on_main():
        # a job that is cancelled ends by itself; the alarm is for work without a job
        before = signal.signal(signal.SIGALRM, interrupt)
        signal.setitimer(signal.ITIMER_REAL, seconds + GRACE)
    try:
        yield
    except (PySparkException, InputError):
        if not late.is_set():
            raise
    finally:
        timer.cancel()
        if _on_main():
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
        context.setLocalProperty("spark.jobGroup.id", None)
    if late.is_set():
        raise LimitError(f"seconds limit exceeded ({seconds})")
