"""What a Python worker keeps between tasks.

Spark reuses workers for all jobs of a session, so what one operator caches
would stay beside the memory of every later one. A worker therefore keeps the
table of one operator at a time, and gives Arrow's unused memory back when a
task ends. Both only decide when memory is free, never what is computed.
"""

from __future__ import annotations

import pyarrow as pa

_kept: dict = {}


def keep(key, build):
    """The worker's table of this key, built once; tables of other keys go."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def forget() -> None:
    _kept.clear()


def give_back() -> None:
    pa.default_memory_pool().release_unused()


def lean(run, keeps: bool = False):
    """The task function `run`; tables that earlier operators kept go first, unless it uses one (`keeps`)."""

    def task(batches):
        if not keeps:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
