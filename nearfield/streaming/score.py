"""Queries that arrive as a stream, scored against an index: stateless, batch by batch, exactly once per query by the sink's batch id."""

from __future__ import annotations

from pyspark.sql import DataFrame

from nearfield.plans.index import VectorIndex


def score_stream(queries: DataFrame, index: VectorIndex, k: int, path: str, checkpoint: str, normalize: bool = True):
    """Start a query that writes (qid, rnk, vec_id, score) under path/batch_id=N. A batch that runs again replaces its own folder."""

    def each(batch: DataFrame, batch_id: int) -> None:
        index.search(batch, k, normalize=normalize).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
