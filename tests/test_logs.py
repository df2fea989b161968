"""Jobs on the sample logs, in both forms (expected values: FIXTURES.md)."""

import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES
from streamwatch.plans.logs import LOG_JOBS, logs_in
from streamwatch.streaming.runner import run_available
from test_streaming import rows_of

FAR = 1_900_000_000  # seconds; a row that late moves event time past every window and timer
SENTINELS = {"ad_click": "-1,-1,none,none,{t}", "login": "-1,none,success,{t}", "order": "-1,other,none,{t}",
             "receipt": "~none,none,{t}"}
DESCRIBED = {
    "sensor": [f"s1,{1000 + 2 * i},{20 + i}" for i in range(10)] + [f"s2,{1000 + 2 * i},{90 - i}" for i in range(8)],
    "user_behavior": [f"{u},{u % 2},7,{b},{1000 + 60 * u}" for u in range(6) for b in ("pv", "buy", "pv")],
    "page_access": [f"1.1.1.{u % 2},u{u},{1000 + u},GET,/p{u % 3}" for u in range(9)],
    "app_marketing": [f"{u},{b},c{u % 2},{1000 + 10 * u}" for u in range(6) for b in ("click", "uninstall")],
}
END = {"sensor": "~none,{t},1", "user_behavior": "-1,-1,7,other,{t}", "page_access": "none,none,{t},GET,~none",
       "app_marketing": "-1,uninstall,none,{t}"}


@pytest.fixture(scope="module")
def folder():
    """All logs, with a far row in a later file."""
    d = tempfile.mkdtemp(prefix="sw-logs-")
    for kind in SENTINELS:
        shutil.copy(os.path.join(FIXTURES, f"{kind}.csv"), d)
    for kind, lines in DESCRIBED.items():
        with open(os.path.join(d, f"{kind}.csv"), "w") as f:
            f.write("\n".join(lines) + "\n")
    later = os.stat(os.path.join(d, "sensor.csv")).st_mtime + 5
    for kind, line in (SENTINELS | END).items():
        path = os.path.join(d, f"{kind}_z.csv")
        with open(path, "w") as f:
            f.write(line.format(t=FAR) + "\n")
        os.utime(path, (later, later))
    return d


def batch(spark, name, folder=FIXTURES):
    return LOG_JOBS[name](logs_in(spark, folder))


def test_golden_counts(spark):
    assert batch(spark, "ad_by_region").count() == 5991
    assert [(r.user_id, r.ad_id) for r in batch(spark, "ad_blacklist_alerts").collect()] == [(937166, 1715)]
    assert batch(spark, "login_fail").count() == 2
    assert {r.kind: r["count"] for r in batch(spark, "order_timeout").groupBy("kind").count().collect()} == \
        {"paid": 37, "timeout": 2, "pay_without_create": 1}
    assert {r.kind: r["count"] for r in batch(spark, "reconcile").groupBy("kind").count().collect()} == \
        {"matched": 5, "pay_only": 35, "receipt_only": 35}
    assert batch(spark, "reconcile_ok").count() == 5


def test_described_logs(spark, folder):
    assert [r.sensor_id for r in batch(spark, "temp_rising", folder).collect()] == ["s1"]
    assert {(r.pv, r.uv) for r in batch(spark, "pv_uv", folder).collect()} == {(12, 6)}
    assert {(r.channel, r.behavior, r.n) for r in batch(spark, "channel_promo", folder).collect()} == \
        {("c0", "click", 3), ("c1", "click", 3)}


@pytest.mark.parametrize("name", sorted(LOG_JOBS))
def test_stream_equals_batch(spark, folder, name):
    job, end = LOG_JOBS[name], F.timestamp_seconds(F.lit(FAR - 10 * 86400))
    log = logs_in(spark, folder, streaming=True, delay="3 days", max_files_per_trigger=1)
    got, want = run_available(job(log)), job(logs_in(spark, folder))
    assert set(got.columns) == set(want.columns)
    # the far rows stay open in a stream
    time = next(c for c in ("window_start", "first_ts", "create_ts", "alert_ts", "alarm_ts", "pay_ts", "event_time") if c in got.columns)
    other = [c for c in ("pay_ts", "receipt_ts") if c in got.columns]
    early = F.coalesce(F.col(time), *other) < end
    cols = sorted(got.columns)
    assert rows_of(got.where(early), cols) == rows_of(want.where(early), cols)
    assert want.where(early).count() > 0

