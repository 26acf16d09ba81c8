"""Scanning as files arrive. An extension: the batch operators run unchanged on each micro-batch.

The stateless verdicts need no state between batches; the baseline verdict keeps its state in the same
snapshots as a batch scan, one writer per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import modular
from ..plans.engine import Engine


def modular_stream(files: DataFrame, how: str = "balanced") -> DataFrame:
    """modular.scan() over a streaming DataFrame of files."""
    return modular.scan(files, how)


def baseline_stream(files: DataFrame, engine: Engine, sink, checkpoint: str) -> StreamingQuery:
    """Judges each micro-batch against the baseline and moves it on; sink(results, batch_id) takes the results."""

    def judge(batch: DataFrame, batch_id: int) -> None:
        sink(engine.judge(batch), batch_id)

    return files.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
