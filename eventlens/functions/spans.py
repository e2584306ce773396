"""Span literals such as `30s`, `5m`, `1h`, `7d`, compound forms such as `1h30m`, and time buckets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SECONDS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600, "d": 86400}
MAX_SPAN_SECONDS = 366 * 86400
_PART = re.compile(r"(\d+(?:\.\d+)?)(ns|us|ms|s|m|h|d)")


def span_seconds(span: str | int) -> int:
    """Seconds of a span; a bare integer counts seconds. Must be whole, > 0 and at most 366 days."""
    literal = str(span).strip()
    if re.fullmatch(r"-?\d+", literal):
        seconds = float(literal)
    else:
        parts = _PART.findall(literal)
        if not parts or "".join(a + b for a, b in parts) != literal:
            raise ValueError(f"invalid span {span!r}")
        seconds = sum(float(a) * UNIT_SECONDS[b] for a, b in parts)
    if seconds <= 0:
        raise ValueError("span must be positive")
    if seconds > MAX_SPAN_SECONDS:
        raise ValueError("span must not exceed 366 days")
    if seconds != int(seconds):
        raise ValueError("span must be whole seconds")
    return int(seconds)


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned UTC bucket that holds `ts`."""
    epoch = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(seconds)))
