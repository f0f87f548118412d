"""A stage over units that arrive one after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.cache import StageCache


def follow(types: DataFrame, cache: StageCache, stage: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Runs a stage on each batch of a stream of type rows, for units whose rows have changed since they were last seen, and keeps what it gives.

    A unit's rows must come in one batch, as those of a file do. A batch that is run again after a failure finds its
    units unchanged or replaces them.
    """

    def run(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            _, changed = cache.lookup(batch)
            if not changed.isEmpty():
                cache.save(changed, stage(changed), f"{checkpoint}#{n}")
        finally:
            batch.unpersist()

    return types.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
