"""Independent model fits submitted at once.

Each MLlib fit is a series of jobs; on a small training table most of its
time is job scheduling, so running a few fits side by side keeps the
executors busy (the approach of ``CrossValidator``'s ``parallelism``)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target

FIT_PARALLELISM = 4


def fit_all(fit: Callable, args: Sequence, parallelism: int | None = None) -> list:
    """``[fit(a) for a in args]``, run from a thread pool; results keep the
    order of ``args``."""
    args = list(args)
    parallelism = FIT_PARALLELISM if parallelism is None else parallelism
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(args)))) as pool:
        return list(pool.map(inheritable_thread_target(fit), args))
