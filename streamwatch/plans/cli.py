"""Run one job, batch or streaming, and write its result.

    python -m streamwatch.plans.cli hot_items --tables /data/sf1 --out /data/out/hot_items
    python -m streamwatch.plans.cli login_fail --stream --source /data/events_in \\
        --tables /data/sf1 --out /data/out/login_fail --delay "10 minutes"
    python -m streamwatch.plans.cli ad_blacklist_counts --logs /data/logs --out /data/out/counts [--stream]

With ``--logs`` the job runs on the CSV logs (``<kind>*.csv``) of a folder. Otherwise batch mode reads the test tables under ``--tables``; stream mode reads new
``events*.parquet`` files arriving in ``--source`` (dimensions still come from
``--tables``), checkpoints under the session's ``spark.checkpoint.dir``, and
runs until stopped (``--available-now`` processes what is there and exits).
"""

from __future__ import annotations

import argparse
import sys

from ..session import get_session
from ..sources.sinks import write
from .jobs import JOBS
from .logs import LOG_JOBS, logs_in
from .streams import DEFAULT_DELAY, STREAM_JOBS, events_stream


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="streamwatch")
    ap.add_argument("job", choices=sorted(set(JOBS) | set(STREAM_JOBS) | set(LOG_JOBS)))
    where = ap.add_mutually_exclusive_group(required=True)
    where.add_argument("--tables", help="folder with the parquet tables")
    where.add_argument("--logs", help="folder with the CSV logs")
    ap.add_argument("--out", required=True, help="output folder")
    ap.add_argument("--format", default="parquet")
    ap.add_argument("--stream", action="store_true")
    ap.add_argument("--source", help="folder receiving events*.parquet files (stream mode)")
    ap.add_argument("--delay", default=DEFAULT_DELAY, help="watermark delay (stream mode)")
    ap.add_argument("--available-now", action="store_true")
    ap.add_argument("--checkpoint", help="checkpoint folder (default: under spark.checkpoint.dir)")
    ap.add_argument("--master")
    a = ap.parse_args(argv)

    if a.job not in (LOG_JOBS if a.logs else STREAM_JOBS if a.stream else JOBS):
        ap.error(f"{a.job} has no such form on {'logs' if a.logs else 'tables'}")
    spark = get_session(a.master, app=f"streamwatch-{a.job}")
    if a.logs:
        result = LOG_JOBS[a.job](logs_in(spark, a.logs, a.stream, delay=a.delay))
    elif a.stream:
        result = STREAM_JOBS[a.job](events_stream(spark, a.source or a.tables), spark, a.tables, delay=a.delay)
    else:
        result = JOBS[a.job](spark, a.tables)
    if not a.stream:
        write(result, a.out, fmt=a.format)
        return 0
    q = write(result, a.out, fmt=a.format,
              name=f"streamwatch_{a.job}", trigger={"availableNow": True} if a.available_now else None,
              checkpoint=a.checkpoint)
    q.awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
