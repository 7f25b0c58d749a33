"""The confusion cube on a stream.

The audited program has no streaming.  Because the cube is a plain sum of
counts, the same operator applies unchanged to a streaming DataFrame: a
single aggregation keyed by an event-time window plus (attribute, group,
yt, yp), with a watermark bounding the state.  Rates and disparities are then
computed per window from the emitted cube rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiaudit.operators.cube import confusion_cube


def windowed_cube(stream: DataFrame, attrs: Sequence[str], positive_label: str, time_col: str,
                  window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Streaming cube per event-time window: (window, attribute, group, yt, yp, bucket, n).

    Uses the single-aggregation ``sets`` strategy, which streaming supports in
    append and update modes.
    """
    with_window = stream.withWatermark(time_col, watermark).withColumn("window", F.window(time_col, window))
    return confusion_cube(with_window, attrs, positive_label, by=["window"], strategy="sets")
