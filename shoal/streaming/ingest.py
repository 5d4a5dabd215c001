"""Daily bars that arrive as a stream, merged into the stored bars batch by batch.

A batch may bring bars that are newer than their code's last one, bars that fill gaps further back, and bars that came before. All go
in by one commit that knows the batch's number, so a batch that runs again after a crash changes nothing: keys that are held stay as they are, and
only the months that new keys touch are read and written. Repetitions are told by when a bar arrived, not by its date, as a gap may be filled
at any time: a stream's state holds the keys that arrived within ``late``, and a bar that is repeated after that meets the stored one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoal.operators import tables
from shoal.sources.commits import Change, Store

def once(bars: DataFrame, arrived: Column, late: str = "10 days") -> DataFrame:
    """A stream of (code, dt, ...) without repetitions of a bar within ``late`` of its arrival."""
    x = bars.withColumn("_at", arrived).withWatermark("_at", late)
    return x.dropDuplicatesWithinWatermark(["code", "dt"]).drop("_at")


def merge_batch(store: Store, name: str, rows: DataFrame, batch: int, heal: bool = True, table: str = "daily") -> int:
    """Commit one batch of bars: those newer than their code's last one and, with ``heal``, older ones that aren't held."""
    rows = rows.withColumn("month", F.date_format("dt", "yyyy-MM"))
    if not heal:
        rows = tables.fresh_bars(rows, store.read(table))
    return store.commit(name, [Change(table, rows, "insert")], batch)


def ingest(bars: DataFrame, store: Store, name: str, checkpoint: str, arrived: Column | None = None, late: str = "10 days", heal: bool = True, table: str = "daily") -> StreamingQuery:
    """Take all that is there of the stream ``bars`` into ``table``, then stop. ``arrived``: when a bar came, by default the time of its batch."""

    def take(rows: DataFrame, batch: int) -> None:
        rows.persist()  # the batch is read for its months and for its rows; and once at least, or its state would be lost
        try:
            rows.count()
            merge_batch(store, name, rows, batch, heal, table)
        finally:
            rows.unpersist()

    return once(bars, F.current_timestamp() if arrived is None else arrived, late).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
