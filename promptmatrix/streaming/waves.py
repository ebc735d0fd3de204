"""A paged source as a stream: whole pages are a wave that is scored and appended once."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from promptmatrix.sources.paged import MOST_AHEAD, PagedCases


def drain(
    spark: SparkSession, source: str, base: Path | str, checkpoint: str, wave: Callable[[DataFrame, int], None], params: dict[str, Any] | None = None, page_size: int = 100, limit: int | None = None, more: Callable[[], int] = lambda: MOST_AHEAD
) -> int:
    """Reads a source to its end, its limit or until ``more`` says 0; returns the pages read.

    ``more`` says before each start of the stream how many cases are wanted;
    ``wave`` gets as many whole pages as hold them (with a column ``page``,
    numbered from 0) and the number of the wave.  So the starts follow the
    number of cases, bounded by what may go through the driver at a time, and
    not the number of pages.  The offset is the cursor, and a restart goes on
    where it stopped.  Pages may be handed over again after a crash, under the
    same number; the wave has to make writing them twice harmless, as the
    store does by its key.
    """
    spark.dataSource.register(PagedCases)
    options = {"source": source, "base": str(base), "params": json.dumps(params or {}), "pageSize": str(page_size)} | ({"limit": str(limit)} if limit else {})
    pages = 0
    while wanted := more():
        arrived: list[int] = []

        def once(part: DataFrame, number: int, arrived=arrived) -> None:
            kept = part.checkpoint(eager=True)  # nothing after this asks the source for these pages again
            arrived.append(max(1, kept.select("page").distinct().count()))
            wave(kept, number)

        stream = spark.readStream.format("paged_cases").options(**options, ahead=str(int(wanted))).load().writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.awaitTermination()
        if not arrived:
            break
        pages += sum(arrived)
    return pages
