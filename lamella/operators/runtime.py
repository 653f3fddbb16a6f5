"""What surrounds the operators: options, named engines, bounded and repeated calls, whole files."""

from __future__ import annotations

import contextlib
import os
import queue
import tempfile
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import SparkSession

PREFIX = "lamella."


def positive(value: Any) -> int:
    n = int(value)
    if n <= 0:
        raise ValueError(f"{value} is not a positive whole number")
    return n


def share(value: Any) -> float:
    x = float(value)
    if not 0 <= x <= 1:
        raise ValueError(f"{value} is not between 0 and 1")
    return x


@dataclass(frozen=True)
class Options:
    """Settings of a conversion; each may be set in the session as lamella.<name>."""

    dpi: int = 144
    mask_padding_px: int = 2
    mask_share_cap: float = 0.12
    min_confidence: float = 0.55
    max_calls: int = 200
    page_timeout_s: int = 120
    engine: str = "auto"

    def __post_init__(self):
        for name in ("dpi", "max_calls", "page_timeout_s"):
            object.__setattr__(self, name, positive(getattr(self, name)))
        for name in ("mask_share_cap", "min_confidence"):
            object.__setattr__(self, name, share(getattr(self, name)))
        object.__setattr__(self, "mask_padding_px", int(self.mask_padding_px))

    @classmethod
    def of(cls, spark: SparkSession) -> Options:
        found = {f.name: spark.conf.get(PREFIX + f.name, None) for f in fields(cls)}
        return cls(**{k: v for k, v in found.items() if v is not None})


class Registry:
    """Engines and providers by name."""

    def __init__(self):
        self._makers: dict[str, Callable[..., Any]] = {}

    def add(self, name: str, maker: Callable[..., Any]) -> None:
        self._makers[name.lower()] = maker

    def make(self, name: str, **settings) -> Any:
        if name.lower() not in self._makers:
            raise ValueError(f"no engine {name!r}; there are {', '.join(sorted(self._makers))}")
        return self._makers[name.lower()](**settings)


class Lane:
    """One worker thread for calls with a time limit; after a call that did not end in time a new thread takes over."""

    def __init__(self):
        self._tasks: queue.SimpleQueue | None = None

    def _start(self) -> queue.SimpleQueue:
        tasks: queue.SimpleQueue = queue.SimpleQueue()

        def work():
            while (task := tasks.get()) is not None:
                f, out = task
                try:
                    out.put((True, f()))
                except BaseException as e:  # handed to the caller
                    out.put((False, e))

        threading.Thread(target=work, daemon=True).start()
        return tasks

    def call(self, f: Callable[[], Any], seconds: float, label: str = "call") -> Any:
        self._tasks = self._tasks or self._start()
        out: queue.SimpleQueue = queue.SimpleQueue()
        self._tasks.put((f, out))
        try:
            ok, value = out.get(timeout=seconds)
        except queue.Empty:
            self._tasks.put(None)  # ends the old thread, should it ever come back
            self._tasks = None
            raise TimeoutError(f"{label} took more than {seconds} s") from None
        if not ok:
            raise value
        return value


def retried(f: Callable[[], Any], busy: Callable[[Exception], bool], delays: tuple[float, ...] = (1, 2, 4), sleep: Callable[[float], None] = time.sleep) -> Any:
    """f(), again after each delay while it fails for being busy."""
    for delay in delays:
        try:
            return f()
        except Exception as e:
            if not busy(e):
                raise
        sleep(delay)
    return f()


class Gate:
    """A lock by key with a bound on those who wait, and on how long."""

    def __init__(self, waiters: int = 4, seconds: float = 5.0):
        self.waiters, self.seconds = waiters, seconds
        self._guard = threading.Lock()
        self._locks: dict[Any, list] = {}

    @contextlib.contextmanager
    def hold(self, key):
        with self._guard:
            entry = self._locks.setdefault(key, [threading.Lock(), 0])
            if entry[1] > self.waiters:
                raise BlockingIOError(f"{key} is busy")
            entry[1] += 1
        try:
            if not entry[0].acquire(timeout=self.seconds):
                raise BlockingIOError(f"{key} is busy")
            try:
                yield
            finally:
                entry[0].release()
        finally:
            with self._guard:
                entry[1] -= 1
                if not entry[1]:
                    self._locks.pop(key, None)


def write_whole(path: str, text: str) -> None:
    """Replaces a driver-side file at once: readers see the old text or the new one."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, path)
