"""Arrow batch functions that run once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import types as T


def kernel(result: T.DataType):
    """Decorator of a pixel kernel returning ``result``.

    A filter on a kernel's result, or an explode of it, is otherwise copied below
    the projection and the kernel with it, so pixels would be worked on twice.
    Declaring it non-deterministic keeps the one evaluation where it was written.
    """
    def wrap(fn: Callable):
        return F.arrow_udf(fn, result).asNondeterministic()
    return wrap
