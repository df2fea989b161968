"""CSV log sources (S4, P1): batch or streaming, always with a fixed schema.

The lines are headerless comma-separated records with CRLF endings; Spark's
CSV reader strips the CR. For lines that arrive as text (Kafka values,
socket-like sources) ``parse_lines`` does the same with ``from_csv`` after
trimming the CR.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import with_event_time
from ..schemas import LOGS


def read_log(spark: SparkSession, kind: str, path: str, streaming: bool = False,
             event_time: str | None = "event_time", delay=None,
             max_files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """Read one of the logs; adds a ``timestamp`` column ``event_time`` from epoch seconds.

    With ``delay`` a watermark is set on ``event_time``. ``pattern``: file names to read in ``path``.
    """
    schema = LOGS[kind]
    glob = {"pathGlobFilter": pattern} if pattern else {}
    if streaming:
        r = spark.readStream.schema(schema).options(**glob)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        df = r.csv(path, header=False, mode="FAILFAST")
    else:
        df = spark.read.schema(schema).options(**glob).csv(path, header=False, mode="FAILFAST")
    if event_time:
        df = with_event_time(df, "ts", out=event_time, unit="s", delay=delay)
    return df


#: Column of ``parse_lines`` and ``decode_values`` that holds a line which is no record.
BAD_LINE = "bad_line"


def parse_lines(df: DataFrame, schema: T.StructType, col: str = "value", keep_bad: bool = False) -> DataFrame:
    """Text lines -> typed columns (the map step in front of every reference job).

    ``keep_bad`` adds ``bad_line``: the line, where it is not a record of the schema
    (a field that does not parse, too few or too many fields), else null.
    """
    return _parsed(df, F.regexp_replace(F.col(col).cast("string"), r"\r$", ""), schema, "csv", keep_bad)


def _parsed(df: DataFrame, line, schema: T.StructType, fmt: str, keep_bad: bool) -> DataFrame:
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parse = {"csv": F.from_csv, "json": F.from_json}[fmt]
    if not keep_bad:
        return df.select(parse(line, ddl).alias("_r")).select("_r.*")
    if BAD_LINE in schema.fieldNames():
        raise ValueError(f"the schema has a column {BAD_LINE}")
    return (df.select(parse(line, f"{ddl}, {BAD_LINE} string", {"columnNameOfCorruptRecord": BAD_LINE, "mode": "PERMISSIVE"}).alias("_r"),
                      line.alias("_line")).select("_r.*", "_line")
            # a null value is no record either, and comes without one
            .withColumn(BAD_LINE, F.coalesce(BAD_LINE, F.when(F.col("_line").isNull() | (F.trim("_line") == ""), F.coalesce("_line", F.lit("")))))
            .drop("_line"))
