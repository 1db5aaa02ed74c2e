"""What goes on while tables are written: observed counts of batches and streams, and callbacks for a stream's progress.

Counts are aggregates that ride on the write itself, so nothing is read a second time. A stream's counts are those of all its batches; a batch that is run again after a failure counts
once, as its last report does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener

from webloom.sources.shared import fresh_dir


def write_observed(df: DataFrame, path: str, format: str = "parquet", **counts: Column) -> dict[str, int]:
    """Writes a table and returns its counts; sums of no rows are 0."""
    seen = Observation()
    df.observe(seen, *[c.alias(name) for name, c in counts.items()]).write.format(format).save(path)
    return {name: seen.get[name] or 0 for name in counts}


def stream_observed(df: DataFrame, path: str, checkpoint: str | None = None, format: str = "parquet", **counts: Column) -> dict[str, int]:
    """Writes all that a stream has now and returns the counts of the run's batches, added up."""
    watched = df.observe("progress", *[c.alias(name) for name, c in counts.items()])
    spark = df.sparkSession
    total: dict[int, dict[str, int]] = {}
    heard = Progress(lambda batch, observed: total.__setitem__(batch, observed))
    spark.streams.addListener(heard)
    try:
        run = watched.writeStream.format(format).option("checkpointLocation", checkpoint or fresh_dir(spark, "progress")).trigger(availableNow=True).start(path)
        heard.only(str(run.id))
        run.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for p in run.recentProgress:  # what the listener hasn't been told yet
            row = p.observedMetrics.get("progress")
            if row is not None:
                total.setdefault(p.batchId, row.asDict())
    finally:
        spark.streams.removeListener(heard)
    return {name: sum(b.get(name) or 0 for b in total.values()) for name in counts}


class Progress(StreamingQueryListener):
    """Tells a function (batch, observed counts) of each batch of streams that observe ``progress``."""

    def __init__(self, tell: Callable[[int, dict], None], done: Callable[[str | None], None] | None = None):
        self.tell, self.done, self.run = tell, done, None

    def only(self, run: str) -> None:
        """From now on other streams aren't told of."""
        self.run = run

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get("progress")
        if row is not None and self.run in (None, str(event.progress.id)):
            self.tell(event.progress.batchId, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.done and self.run in (None, str(event.id)):
            self.done(event.exception)
