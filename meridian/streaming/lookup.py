"""Positions of a stream of probes by stored segments.

Each micro-batch is looked up like any table of probes, so the rules and the plan are those of operators.lookup. A batch
that is run again after a loss replaces its own rows, so results come once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meridian.operators.lookup import original_position


def follow(probes: DataFrame, segs: Callable[[], DataFrame], path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes (probe_id, source_idx, orig_line, orig_col, name_idx) of a stream (probe_id, map_id, line, col) to path, by batch.

    segs gives the segments anew for each batch, so maps that were added since are seen. once: what is there now, then ends.
    """

    def batch(rows: DataFrame, n: int) -> None:
        out = original_position(segs(), rows).withColumn("batch", F.lit(n))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    writer = probes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
