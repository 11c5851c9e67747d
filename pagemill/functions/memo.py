"""Column expressions built once and used again.

Building a large expression costs thousands of calls to the JVM, seconds for a page's
fields, and a stream would pay that for every batch. An expression over column names
does not depend on the frame it is used on, so it can be kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark import SparkContext


def kept_columns(build: Callable[..., Any]) -> Callable[..., Any]:
    """Keep what ``build`` returns for each choice of its (hashable) arguments, as long as the JVM that holds it lives."""
    kept: dict[tuple, tuple[Any, Any]] = {}

    @wraps(build)
    def cached(*args: Any) -> Any:
        gateway = SparkContext._gateway
        if gateway is None:  # no JVM of our own
            return build(*args)
        found = kept.get(args)
        if found is None or found[0] is not gateway:
            found = kept[args] = (gateway, build(*args))
        return found[1]

    return cached
