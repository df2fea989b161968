"""Session construction and shared-storage locations.

Every job in this package is a plain DataFrame function; this module only
holds the session defaults they rely on (UTC session time, AQE) and the rule
for where streaming checkpoints and lineage cuts go: the shared folder named
by ``spark.checkpoint.dir``, read from the session. Library code never creates
a folder of its own; only tests set one, and only when the session has none.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings every job assumes. Windows and day scopes are computed in UTC.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # transformWithState needs the RocksDB provider; it also keeps large state off-heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _python_path_for_workers() -> None:
    """Let local Python workers import this package (stream processors are
    pickled by reference). On a cluster ship it with ``--py-files`` or
    ``ship_package``."""
    parts = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in parts:
        os.environ["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT] + parts)


def ship_package(spark: SparkSession) -> str:
    """Write the package as a zip into the shared checkpoint folder, through Spark's file system
    layer (so any store Spark can write to), and add it to every executor's path."""
    import io
    import zipfile

    data = io.BytesIO()
    package = os.path.join(PACKAGE_ROOT, "streamwatch")
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(package)):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), PACKAGE_ROOT))
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark).rstrip('/')}/pyfiles/streamwatch.zip")
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target.toString())
    return target.toString()


def get_session(master: str | None = None, app: str = "streamwatch",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    _python_path_for_workers()
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k, v in SESSION_DEFAULTS.items():
        if k != "spark.sql.streaming.stateStore.providerClass":
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints: ``spark.checkpoint.dir`` from the session.

    The cluster names it; library code never invents a machine-local folder.
    Tests set their own only when the session has none (``tests/conftest.py``).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set: point it at a shared, durable folder "
                           "(stream checkpoints and lineage cuts are written there)")
    spark.sparkContext.setCheckpointDir(d)
    return d


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """A per-query streaming checkpoint location under the shared folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/streams/{name}"


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared folder (never ``localCheckpoint``)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=eager)


def sf_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")
