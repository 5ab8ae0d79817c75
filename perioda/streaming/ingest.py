"""The import loop as a stream: every new file is merged into the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming import StreamingQuery

from perioda.sources.tables import merge_into_table


def stream_into_table(
    arrivals: DataFrame,
    path: str,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    schema: T.StructType,
    checkpoint: str,
    *,
    column: str = "dt",
) -> StreamingQuery:
    """Merge what has arrived since the last run, then stop.

    A batch that is run again after a failure changes nothing, since merging
    rows that are already there gives the same table.
    """

    def apply(batch: DataFrame, _: int) -> None:
        merge_into_table(batch.sparkSession, path, batch, merge, schema, column=column)

    return (
        arrivals.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
