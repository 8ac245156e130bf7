"""Time and memory of a call, for reports."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable
from functools import wraps


def measured(f: Callable) -> Callable:
    """f's result with wall milliseconds and the process's largest resident memory in KB."""

    @wraps(f)
    def run(*args, **kwargs):
        began = time.perf_counter()
        out = f(*args, **kwargs)
        return out, (time.perf_counter() - began) * 1000, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss

    return run
