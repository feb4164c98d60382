"""Reading drifting parts, broken manifests and checksums; incremental ingest and the deadline monitor."""

import hashlib
import random
import tempfile

from tallyfield.sources import files, tables
from tallyfield.streaming import deadlines, ingest


def _dir() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_parts_with_fewer_columns(spark):
    root = _dir()
    spark.createDataFrame([(1, "a")], "k int, note string").write.parquet(f"{root}/p1")
    spark.createDataFrame([(2,)], "k int").write.parquet(f"{root}/deep/p2")
    assert sorted(map(tuple, tables.read_parts(spark, root).select("k", "note").collect())) == [(1, "a"), (2, None)]


def test_manifests_keep_unreadable_documents(spark):
    root = _dir()
    for name, text in (("good", '{"n_tasks": 3}'), ("bad", "{not json")):
        with open(f"{root}/{name}.json", "w") as f:
            f.write(text)
    got = {r["path"].rsplit("/", 1)[1]: (r["readable"], r["n_tasks"]) for r in tables.read_manifests(spark, root, "n_tasks long").collect()}
    assert got == {"good.json": (True, 3), "bad.json": (False, None)}


def test_empty_csv_is_typed(spark):
    root = _dir()
    with open(f"{root}/e.csv", "w") as f:
        f.write("a,b\n")
    df = tables.read_csv(spark, root, "a int, b string")
    assert df.count() == 0 and df.dtypes == [("a", "int"), ("b", "string")]


def test_checksums_in_legs(spark):
    """Files longer than a leg: ends with and without newline, byte order mark, no or only newlines, any bytes, and a name that Spark would unpack."""
    root, noise = _dir(), random.Random(3).randbytes(12_000)
    contents = {
        "noise": noise, "noise end": noise + b"\n", "mark": b"\xef\xbb\xbf" + noise, "mark end": b"\xef\xbb\xbfa\r\n" + noise + b"\n\n", "one line": b"x" * 9000,
        "newlines": b"\n" * 5000, "crlf": b"a\r\nb\r" * 3000, "zeros": bytes(7000), "late": b"x" * 6000 + b"\n" + b"y" * 3000, "n.gz": noise, "short": b"a\nb",
    }
    for name, data in contents.items():
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    session.conf.set("spark.sql.files.openCostInBytes", "0")
    got = {r["path"]: (r["bytes"], r["sha256"]) for r in files.checksum_manifest(session, root, leg_bytes=4000).collect()}
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items()}


def test_verify_manifest_reports_each_problem(spark):
    root = _dir()
    for name in ("same", "changed", "extra"):
        with open(f"{root}/{name}.txt", "w") as f:
            f.write(name)
    actual = files.checksum_manifest(spark, root)
    digest = {r["path"]: r["sha256"] for r in actual.collect()}
    listed = spark.createDataFrame([("same.txt", digest["same.txt"]), ("changed.txt", "0"), ("gone.txt", "1")], "path string, sha256 string")
    got = {tuple(r) for r in files.verify_manifest(listed, actual, 1000, ["readme.txt"]).collect()}
    assert got == {("changed.txt", "changed"), ("gone.txt", "missing"), ("extra.txt", "not_listed"), ("readme.txt", "required_absent")}


def test_ingest_keeps_last_and_resumes(spark):
    root = _dir()
    schema = "k int, v string"
    spark.createDataFrame([(1, "old"), (2, "only")], schema).coalesce(1).write.parquet(f"{root}/src/a")
    ingest.ingest_parts(spark, f"{root}/src", schema, f"{root}/t", f"{root}/c")
    spark.createDataFrame([(1, "new")], schema).coalesce(1).write.parquet(f"{root}/src/b")
    ingest.ingest_parts(spark, f"{root}/src", schema, f"{root}/t", f"{root}/c")
    assert spark.read.parquet(f"{root}/t").count() == 3
    assert sorted(map(tuple, ingest.current_rows(spark, f"{root}/t", ["k"]).collect())) == [(1, "new"), (2, "only")]


def _log(spark, rows):
    made = spark.createDataFrame([(t, k, float(s), None if d is None else float(d)) for t, k, s, d in rows], "task_id long, kind string, event_sec double, deadline_sec double")
    return made.selectExpr("task_id", "kind", "timestamp_micros(cast(event_sec * 1000000 as long)) as event_ts", "event_sec", "deadline_sec").coalesce(1)


def _monitored(spark, waves, **options):
    """The monitor's output rows, one micro-batch (and its timers) per wave."""
    root = _dir()
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, wave in enumerate(waves):
            (wave if hasattr(wave, "write") else _log(spark, wave)).write.parquet(f"{root}/log/{i}")
            stream = spark.readStream.schema(deadlines.INPUT).option("recursiveFileLookup", True).parquet(f"{root}/log")
            query = deadlines.deadline_monitor(stream, **options).writeStream.outputMode("append").format("parquet").option(
                "checkpointLocation", f"{root}/c").trigger(availableNow=True).start(f"{root}/out")
            query.awaitTermination()
            state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        spark.conf.set(key, before)
    return sorted(map(tuple, spark.read.schema(deadlines.OUTPUT).parquet(f"{root}/out").collect())), state


def test_deadline_monitor_matches_its_batch_twin(spark):
    waves = [
        [(1, "task", 1000, 1100), (2, "task", 1000, 1100), (3, "task", 1000, 1100), (1, "arrival", 1050, None), (1, "arrival", 1020, None), (7, "arrival", 990, None)],
        [(2, "arrival", 1150, None), (9, "task", 1400, 10_000), (7, "task", 1300, 1500), (4, "task", 1001, 1300), (4, "arrival", 1200, None)],
        [(9, "arrival", 5000, None), (3, "arrival", 5100, None), (1, "arrival", 1160, None), (2, "arrival", 1101, None)],
    ]
    got, left = _monitored(spark, [*waves, deadlines.end_of_log(spark, 200_000.0)], retention_sec=100_000.0)
    everything = _log(spark, [row for wave in waves for row in wave])
    assert got == sorted(map(tuple, deadlines.deadline_outcomes(everything).collect()))
    assert {(3, "censored", 1100.0), (2, "late", 1150.0), (2, "late", 1101.0), (1, "event", 1020.0), (1, "late", 1160.0), (7, "event", 990.0)} <= set(got)
    assert left == 0  # state ends


def test_deadline_monitor_gives_out_what_comes_too_late(spark):
    waves = [
        [(1, "task", 1000, 1100), (2, "task", 1000, 1100), (5, "arrival", 1000, None)],
        [(6, "task", 2000, 2100)],  # the watermark passes both deadlines
        [(1, "arrival", 1090, None), (2, "arrival", 1500, None)],
        [(6, "arrival", 9000, None)],  # and now the retention of all but task 6's arrival
        [(1, "arrival", 1200, None)],
    ]
    got, left = _monitored(spark, [*waves, deadlines.end_of_log(spark, 50_000.0)], retention_sec=3000.0)
    assert got == sorted([
        (1, "censored", 1100.0), (2, "censored", 1100.0), (6, "censored", 2100.0), (1, "revised", 1090.0), (2, "late", 1500.0),
        (6, "late", 9000.0), (5, "orphan", 1000.0), (1, "orphan", 1200.0),
    ])
    assert left == 0
