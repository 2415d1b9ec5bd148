"""Reductions over streams of elements.

The same groupings as in `operators.reduce`, kept up to date by Structured
Streaming. Results have rows for buckets with elements only; a stream has no
dense axis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_AGGREGATES = {"sum": F.sum, "add": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "mul": F.product}


def running_scatter(stream: DataFrame, reduce: str, *, index: str = "idx", value: str = "val", keys: Sequence[str] = (), time: str | None = None, window: str | None = None, delay: str | None = None) -> DataFrame:
    """The reduction by index (and keys) so far; with `time` and `window`, by event-time window, late rows dropped after `delay`."""
    if reduce not in _AGGREGATES:
        raise ValueError(f"unknown reduction {reduce!r}")
    if delay is not None:
        stream = stream.withWatermark(time, delay)
    by = [F.col(c) for c in (*keys, index)]
    if window is not None:
        by.append(F.window(time, window).alias("window"))
    return stream.groupBy(*by).agg(_AGGREGATES[reduce](value).alias(value))
