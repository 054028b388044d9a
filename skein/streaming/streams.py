"""Streaming forms: pieces of downloads put together by key, and a crawl that takes new pages in batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _assemble(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    starts, datas = ([], []) if not state.exists else (list(state.get[0]), list(state.get[1]))
    total = None
    for pdf in batches:
        for start, end, data, n in zip(pdf["range_start"], pdf["range_end"], pdf["data"], pdf["length"]):
            total = int(n)
            if len(data) == int(end) - int(start) + 1 and int(start) not in starts:  # a short piece is left for its next try
                starts.append(int(start))
                datas.append(bytes(data))
    if total is not None and sum(map(len, datas)) >= total:
        state.remove()
        yield pd.DataFrame({"url": [key[0]], "data": [b"".join(d for _, d in sorted(zip(starts, datas)))]})
    else:
        state.update((starts, datas))


def assemble_parts(parts: DataFrame) -> DataFrame:
    """Whole bodies from a stream of pieces (url, length, range_start, range_end, data), each once its last piece has come."""
    return parts.groupBy("url").applyInPandasWithState(_assemble, "url string, data binary", "starts array<long>, datas array<binary>", "append", GroupStateTimeout.NoTimeout)


def status_counts(events: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events by type and window of event time, with a watermark for late ones."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def crawl_batches(stream: DataFrame, step, checkpoint: str):
    """Runs step(batch, number) on each batch of new pages; returns the started query."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
