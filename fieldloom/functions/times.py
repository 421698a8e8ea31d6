"""Between UTC wall-clock times (TIMESTAMP_NTZ) and instants (TIMESTAMP).

Data carries UTC wall-clock times; event-time streaming needs instants.  Neither
direction depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_instant(wall: Column) -> Column:
    """The instant of a UTC wall-clock time."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, wall))


def as_wall(instant: Column) -> Column:
    """The UTC wall-clock time of an instant."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
