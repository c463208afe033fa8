"""Trial features of an unbounded event stream: late trials are taken up to the watermark, repeated ones once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_trials(events: DataFrame, subject: str, time: str, trial: str, value: str, response: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Per subject and window of event time: trials, answered share, mean and deviation of the value.

    ``events`` may be a stream or a table.  A trial that comes twice within the watermark counts once, and the state of a window goes
    when the watermark has passed its end; in a stream the rows are final, so the output mode is append.
    """
    once = events.withWatermark(time, late).dropDuplicatesWithinWatermark([trial]) if events.isStreaming else events.dropDuplicates([trial])
    return (
        once.groupBy(subject, F.window(time, width).alias("window"))
        .agg(
            F.count("*").alias("n_trials"), F.avg((F.coalesce(F.col(response), F.lit("")) != "").cast("double")).alias("answered_share"),
            F.avg(value).alias("value_mean"), F.stddev_samp(value).alias("value_sd"),
        )
        .select(subject, F.col("window.start").alias("window_start"), "n_trials", "answered_share", "value_mean", "value_sd")
    )
