"""Running stream forms: sources over files, bounded runs, and reading results back.

``run_available`` processes everything currently in the source
(``availableNow``) and returns the sink's contents as a batch DataFrame. Results and
checkpoint live under the shared ``spark.checkpoint.dir`` so a restarted
query resumes from committed offsets and state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_location, checkpoint_root


def stream_parquet(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def run_available(df: DataFrame, name: str | None = None, output_mode: str = "append",
                  sink: str = "parquet", path: str | None = None) -> DataFrame:
    """Run a streaming DataFrame over all available input, then return what it wrote.

    Results go to files in ``path``, by default a folder of the run's own in the
    shared checkpoint folder. ``sink='memory'`` holds them on the driver instead, for small ones.
    """
    spark = df.sparkSession
    name = name or f"sw_{uuid.uuid4().hex[:10]}"
    run = f"{name}-{uuid.uuid4().hex[:8]}"
    w = (df.writeStream.outputMode(output_mode)
         .option("checkpointLocation", checkpoint_location(spark, run))
         .trigger(availableNow=True))
    if sink == "memory":
        q = w.format("memory").queryName(name).start()
    else:
        path = path or f"{checkpoint_root(spark).rstrip('/')}/results/{run}"
        q = w.format(sink).start(path)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.table(name) if sink == "memory" else spark.read.schema(df.schema).format(sink).load(path)


def late_rows(query) -> int:
    """Rows a stream dropped as late (behind the watermark), summed over the progress Spark retains.

    ``streaming.late.LateRowCounter`` counts all of them, ``mark_late`` keeps the rows.
    """
    return sum(op.get("numRowsDroppedByWatermark", 0)
               for p in query.recentProgress for op in p.get("stateOperators", []))
