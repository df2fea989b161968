"""Sources, sinks and session helpers."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import fixture_path
from streamwatch.session import checkpoint_root, cut_lineage, ship_package
from streamwatch.sources.logs import parse_lines, read_log
from streamwatch.sources.sinks import write
from streamwatch.schemas import LOGIN, ORDER
from streamwatch.streaming.windows import stream_window_count


def test_parse_lines_strips_cr_and_types(spark):
    lines = spark.createDataFrame([("34729,create,,1558430842\r",), ("34729,pay,sd76f87d6,1558430844",)], "value string")
    rows = parse_lines(lines, ORDER).collect()
    assert [(r.order_id, r.event_type, r.tx_id, r.ts) for r in rows] == \
        [(34729, "create", None, 1558430842), (34729, "pay", "sd76f87d6", 1558430844)]


def test_batch_and_stream_write(spark):
    out = tempfile.mkdtemp(prefix="sw-out-")
    login = read_log(spark, "login", fixture_path("login"))
    write(login, os.path.join(out, "batch"), partition_by=["event_type"])
    assert spark.read.parquet(os.path.join(out, "batch")).count() == 48

    src = tempfile.mkdtemp(prefix="sw-src-")
    with open(fixture_path("login"), "rb") as f:
        data = f.read()
    with open(os.path.join(src, "login.csv"), "wb") as f:
        f.write(data)
    stream = read_log(spark, "login", src, streaming=True)
    counts = stream_window_count(stream, "event_time", ["event_type"], "1 minute", delay="10 seconds").drop("window")
    q = write(counts, os.path.join(out, "stream"), name=f"login_counts_{os.getpid()}",
              trigger={"availableNow": True})
    q.awaitTermination()
    assert os.path.isdir(os.path.join(checkpoint_root(spark).replace("file:", ""), "streams"))
    got = spark.read.parquet(os.path.join(out, "stream"))
    assert got.count() >= 1 and set(got.columns) == {"window_start", "window_end", "event_type", "n"}


def test_cut_lineage_uses_shared_folder(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    cut = cut_lineage(df)
    assert cut.count() == 100
    assert spark.sparkContext.getCheckpointDir() is not None


def test_ship_package_zip(spark):
    import zipfile
    path = ship_package(spark).replace("file:", "")
    assert path.startswith(checkpoint_root(spark).replace("file:", "").rstrip("/"))
    names = zipfile.ZipFile(path).namelist()
    assert "streamwatch/streaming/processors.py" in names and all(n.endswith(".py") for n in names)


def test_values_are_decoded_and_encoded_on_streams(spark, tmp_path):
    """Job 1 without its transport: lines in, records on, JSON out, and no malformed line lost."""
    import json

    from streamwatch.sources.kafka import decode_values, encode_values
    from streamwatch.streaming.runner import run_available

    lines = ["34729,create,,1558430842", "34730,pay,sd76f87d6,1558430844", "x,pay,abc,1558430845", "1,pay", "", "34731,pay,\"a,b\",1558430846"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("\r\n".join(lines).encode())
    text = spark.readStream.text(str(tmp_path / "in"))
    found = run_available(decode_values(text, ORDER)).collect()
    assert len(found) == len(lines)
    assert sorted(r.bad_line for r in found if r.bad_line is not None) == ["", "1,pay", "x,pay,abc,1558430845"]
    good = [r for r in found if r.bad_line is None]
    assert sorted((r.order_id, r.event_type, r.tx_id, r.ts) for r in good) == [
        (34729, "create", None, 1558430842), (34730, "pay", "sd76f87d6", 1558430844), (34731, "pay", "a,b", 1558430846)]
    records = decode_values(text, ORDER).where("bad_line is null").drop("bad_line")
    out = run_available(encode_values(records, key="order_id"))
    assert {r.key: json.loads(r.value) for r in out.collect()} == {str(r.order_id): {k: v for k, v in r.asDict().items() if k != "bad_line"} for r in good}
    back = decode_values(out, ORDER, "json").collect()
    assert sorted(map(tuple, back), key=repr) == sorted((tuple(r) for r in good), key=repr)
    wrong = spark.createDataFrame([("{bad",), (None,), ('{"order_id": "x"}',)], "value string")
    assert decode_values(wrong, ORDER, "json").where("bad_line is not null").count() == 3


def test_cli_batch_and_stream(spark):
    from streamwatch.plans.cli import main
    out = tempfile.mkdtemp(prefix="sw-cli-")
    assert main(["login_fail", "--tables", "/root/testdata/sf0.001", "--out", os.path.join(out, "b")]) == 0
    batch = spark.read.parquet(os.path.join(out, "b"))
    assert set(batch.columns) == {"user_id", "first_ts", "last_ts"}
    assert main(["temp_split", "--stream", "--available-now", "--tables", "/root/testdata/sf0.001",
                 "--out", os.path.join(out, "s"), "--checkpoint", os.path.join(out, "ck")]) == 0
    assert spark.read.parquet(os.path.join(out, "s")).count() == 1000


def test_cli_on_logs(spark):
    from conftest import FIXTURES
    from streamwatch.plans.cli import main
    out = tempfile.mkdtemp(prefix="sw-cli-")
    assert main(["ad_blacklist_alerts", "--logs", FIXTURES, "--out", os.path.join(out, "b")]) == 0
    assert [(r.user_id, r.ad_id) for r in spark.read.parquet(os.path.join(out, "b")).collect()] == [(937166, 1715)]
