"""Result and alert output (S6, S7).

Batch results are written with ``df.write``; streams with ``writeStream`` and
a checkpoint under the shared ``spark.checkpoint.dir`` folder, so a restarted
query (or one that lost executors) resumes from its committed offsets and
state. File sinks are exactly-once through the checkpoint.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from ..session import checkpoint_location


def write(df: DataFrame, path: str | None = None, fmt: str = "parquet", mode: str | None = None,
          name: str | None = None, trigger: dict | None = None, partition_by: list[str] | None = None,
          checkpoint: str | None = None):
    """Batch: ``mode`` defaults to overwrite. Stream: ``mode`` defaults to append;
    returns the StreamingQuery; its checkpoint, unless given, is that of the name and the
    output together, so runs with different outputs never share one. ``fmt`` may be parquet, json, csv, console, memory, noop."""
    if not df.isStreaming:
        w = df.write.mode(mode or "overwrite").format(fmt)
        if partition_by:
            w = w.partitionBy(*partition_by)
        return w.save(path) if path else w.save()
    spark = df.sparkSession
    if not (name or path or checkpoint):
        raise ValueError("a stream needs a name, an output path or a checkpoint of its own")
    # A job with another output starts afresh: the checkpoint belongs to name, format and output.
    qname = "_".join(x for x in (name, hashlib.md5(f"{fmt} {path}".encode()).hexdigest()[:12] if path else None) if x)
    w = (df.writeStream.format(fmt).outputMode(mode or "append")
         .option("checkpointLocation", checkpoint or checkpoint_location(spark, qname)))
    if fmt == "memory" or name:
        w = w.queryName(name or qname)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if trigger:
        w = w.trigger(**trigger)
    return w.start(path) if path else w.start()
