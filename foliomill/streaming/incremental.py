"""The batch plan, run again whenever manifest rows arrive.

What is finished is decided by the outputs present at each micro-batch and not by which
inputs a checkpoint has seen, so a page that failed is tried again when its row comes
again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..plans.batch import plan_wave, skip_existing


def plan_stream(manifest: DataFrame, outputs: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Writer of the streaming ``manifest`` (project, file_name, output_name) that hands each micro-batch's plan to ``sink``.

    ``outputs`` lists what is finished (project, output_name) at that moment.
    """

    def each(rows: DataFrame, number: int) -> None:
        keys = ("project", "output_name")
        sink(plan_wave(skip_existing(rows, outputs(), keys), keys), number)

    return manifest.writeStream.foreachBatch(each)
