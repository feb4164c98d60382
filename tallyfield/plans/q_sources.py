"""Tables written by Spark from the driver's data, and read back by the sources.

Everything is written below the shared folder of the session (see :mod:`tallyfield.session`).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.plans import views as V
from tallyfield.plans.registry import query
from tallyfield.plans.shape import rounded
from tallyfield.session import scratch_path
from tallyfield.sources import files, tables
from tallyfield.streaming import deadlines, ingest


def _parts(spark, sf_dir) -> str:
    """Two generations of parts: the older ones lack a column."""
    root = scratch_path(spark, "parts")
    tasks = V.tasks(spark, sf_dir).select("task_id", "case_id", "scenario_id", "status", "price")
    tables.write_table(tasks.filter("status = 'NOT_APPLICABLE'").drop("price"), f"{root}/old")
    tables.write_table(tasks.filter("status = 'COMPLETED'"), f"{root}/new")
    return root


@query("S01_read_parts", """
SELECT task_id, case_id, scenario_id, CASE WHEN status = 'COMPLETED' THEN round(price, 6) END AS price FROM v_tasks""")
def read_parts(spark, sf_dir):
    return rounded(tables.read_parts(spark, _parts(spark, sf_dir), ["task_id", "case_id", "scenario_id", "price"]))


@query("S01_read_order", """
SELECT scenario_id, count(*) AS n, count(*) AS distinct_positions FROM v_tasks GROUP BY scenario_id""")
def read_order(spark, sf_dir):
    """File and row number give every row read a place of its own."""
    rows = tables.read_parts(spark, _parts(spark, sf_dir), ["scenario_id"], with_order=True)
    return rows.groupBy("scenario_id").agg(
        F.expr("count(*) as n"), F.expr(f"count(distinct {tables.ORDER_FILE}, {tables.ORDER_ROW}) as distinct_positions"))


@query("S02_read_csv", """
SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, o_orderpriority FROM orders""")
def read_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    V.table(spark, sf_dir, "orders").write.option("header", True).option("compression", "gzip").csv(path)
    return rounded(tables.read_csv(spark, path, V.SCHEMAS["orders"], ["o_orderkey", "o_totalprice", "o_orderpriority"]), 4)


@query("S03_read_manifests", """
SELECT o_orderpriority, true AS readable, count(*) AS n_tasks, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority""")
def read_manifests(spark, sf_dir):
    """One JSON document per priority class, written as a partitioned table and read back."""
    root = scratch_path(spark, "manifests")
    summary = V.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.expr("count(*) as n_tasks"), F.expr("round(sum(o_totalprice), 2) as total"))
    documents = summary.withColumn("k", F.col("o_orderpriority"))
    documents.repartition("k").write.partitionBy("k").json(root)
    found = tables.read_manifests(spark, root, "o_orderpriority string, n_tasks long, total double")
    return rounded(found.select("o_orderpriority", "readable", "n_tasks", "total"), 2)


def _case_folders(spark, sf_dir) -> str:
    """Tasks written one folder per priority and family, as a campaign on disk."""
    root = scratch_path(spark, "campaign")
    tasks = V.tasks(spark, sf_dir).select("task_id", "case_id", "price", "priority_class", "family")
    shaped = tasks.withColumn("event", F.lower("priority_class"))
    tables.write_table(shaped.repartition("event", "family"), root, "csv", ["event", "family"])
    return root


@query("S03_marker_flags")
def marker_flags(spark, sf_dir):
    listed = files.list_files(spark, _case_folders(spark, sf_dir)).selectExpr("concat('/', path) as path")
    marked = listed.selectExpr("regexp_replace(path, '/[^/]*$', '/_SUCCESS.json') as path").distinct()
    return tables.marker_flags(marked, ["_SUCCESS.json", "_FAILED.json"])


@query("S04_inventory")
def inventory(spark, sf_dir):
    listed = files.list_files(spark, _case_folders(spark, sf_dir))
    return files.inventory(listed, r"event=([^/]*)", r"family=([^/]*)").select("path", "event", "case_id", "extension", "bytes")


@query("S04_role_totals", """
SELECT lower(priority_class) AS event, count(DISTINCT family) AS files FROM v_tasks GROUP BY ALL""")
def role_totals(spark, sf_dir):
    listed = files.inventory(files.list_files(spark, _case_folders(spark, sf_dir), "*.csv"), r"event=([^/]*)", r"family=([^/]*)")
    return files.role_totals(listed).select("event", "files")


@query("S04_folder_counts", """
SELECT 'event=' || lower(priority_class) AS folder, count(DISTINCT family) AS files FROM v_tasks GROUP BY ALL
UNION ALL SELECT DISTINCT 'event=' || lower(priority_class) || '/family=' || family, 1 FROM v_tasks""")
def folder_counts(spark, sf_dir):
    return files.folder_counts(files.list_files(spark, _case_folders(spark, sf_dir), "*.csv"))


@query("S05_checksum_manifest")
def checksum_manifest(spark, sf_dir):
    """The driver's own files: rows only, because SQL has no view of files."""
    return files.checksum_manifest(spark, sf_dir, "*.parquet")


@query("S05_verify_manifest")
def verify_manifest(spark, sf_dir):
    actual = files.checksum_manifest(spark, sf_dir, "*.parquet")
    listed = actual.selectExpr("if(path = 'region.parquet', 'gone.parquet', path) as path", "if(path = 'nation.parquet', 'x', sha256) as sha256")
    return files.verify_manifest(listed, actual, 100_000, ["orders.parquet", "readme.txt"])


@query("S06_write_table", """
SELECT priority_class, family, count(*) AS n, round(sum(price), 2) AS total FROM v_tasks GROUP BY ALL""")
def write_table(spark, sf_dir):
    path = scratch_path(spark, "table")
    tables.write_table(V.tasks(spark, sf_dir).select("task_id", "price", "priority_class", "family"), path, "parquet", ["family"])
    back = spark.read.schema("task_id long, price double, priority_class string, family string").parquet(path)
    return back.groupBy("priority_class", "family").agg(F.expr("count(*) as n"), F.expr("round(sum(price), 2) as total"))


@query("S07_resolve_columns", """
SELECT c_custkey AS id, c_acctbal AS balance, NULL::DOUBLE AS rating FROM customer""")
def resolve_columns(spark, sf_dir):
    from tallyfield.functions.tables import resolve_columns as resolve

    found = resolve(V.table(spark, sf_dir, "customer"), {"id": ["customer_id", "C_CustKey"], "balance": ["C_ACCTBAL", "c_name"], "rating": ["stars"]})
    return found.selectExpr("id", "balance", "cast(rating as double) as rating")


@query("S08_collect_outputs", """
SELECT 'priority=' || o_orderpriority AS case_id, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL""")
def collect_outputs(spark, sf_dir):
    root = scratch_path(spark, "outputs")
    V.table(spark, sf_dir, "orders").selectExpr("o_orderpriority as priority", "o_orderkey", "o_orderstatus").write.option("header", True).partitionBy(
        "priority").csv(root)
    rows = tables.collect_outputs(spark, root, "o_orderkey long, o_orderstatus string", "*.csv")
    return rows.selectExpr("replace(case_id, '%20', ' ') as case_id", "o_orderstatus").groupBy("case_id", "o_orderstatus").agg(F.expr("count(*) as n"))


_LATEST = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("X01_ingest_parts_stream", f"""
SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(c + " DESC" for c in _LATEST)}) = 1""")
def ingest_parts(spark, sf_dir):
    """Parts arrive in two waves; a second run picks up only the new ones."""
    root = scratch_path(spark, "ingest")
    lines = V.table(spark, sf_dir, "lineitem")
    tables.write_table(lines.filter("l_returnflag = 'A'"), f"{root}/source/wave1")
    ingest.ingest_parts(spark, f"{root}/source", V.SCHEMAS["lineitem"], f"{root}/target", f"{root}/checkpoint")
    tables.write_table(lines.filter("l_returnflag <> 'A'"), f"{root}/source/wave2")
    ingest.ingest_parts(spark, f"{root}/source", V.SCHEMAS["lineitem"], f"{root}/target", f"{root}/checkpoint")
    return ingest.current_rows(spark, f"{root}/target", ["l_orderkey", "l_linenumber"], _LATEST)


def _event_log(spark, sf_dir):
    opened = V.tasks(spark, sf_dir).selectExpr(
        "task_id", "'task' as kind", "timestamp_micros(cast(created_sec * 1000000 as long)) as event_ts", "created_sec as event_sec", "deadline_sec", "deadline_sec as due_sec")
    arrived = V.transfers(spark, sf_dir).selectExpr(
        "task_id", "'arrival' as kind", "timestamp_micros(cast(end_sec * 1000000 as long)) as event_ts", "end_sec as event_sec", "cast(null as double) as deadline_sec", "deadline_sec as due_sec")
    return opened.unionByName(arrived)


_OUTCOMES_SQL = """
WITH f AS (SELECT task_id, min(end_sec) AS t FROM v_transfers GROUP BY task_id)
SELECT task_id, CASE WHEN coalesce(t <= deadline_sec, false) THEN 'event' ELSE 'censored' END AS outcome, CASE WHEN coalesce(t <= deadline_sec, false) THEN t ELSE deadline_sec END AS at_sec
FROM v_tasks LEFT JOIN f USING (task_id) UNION ALL SELECT task_id, 'late', end_sec FROM v_transfers WHERE end_sec > deadline_sec"""


@query("X02_deadline_outcomes", _OUTCOMES_SQL)
def deadline_outcomes(spark, sf_dir):
    return deadlines.deadline_outcomes(_event_log(spark, sf_dir))


_RETENTION = 10 * 365 * 86400.0


@query("X02_deadline_monitor", _OUTCOMES_SQL)
def deadline_monitor(spark, sf_dir):
    """The stream itself, in three waves and a closing row. Some late arrivals come years behind the watermark; none is lost."""
    root = scratch_path(spark, "monitor")
    _event_log(spark, sf_dir).write.parquet(f"{root}/all")  # read five times
    log = spark.read.schema(f"{deadlines.INPUT}, due_sec double").parquet(f"{root}/all")
    low, high, end = (x or 0.0 for x in log.agg(F.min("event_sec"), F.max("event_sec"), F.max("deadline_sec")).first())
    cut = lambda k: f"int(event_sec >= {low + (high - low) * k / 3!r}D)"
    wave = f"if(kind = 'arrival' and event_sec > due_sec and task_id % 3 = 0, 2, {cut(1)} + {cut(2)})"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i in range(4):
            part = log.where(f"{wave} = {i}").drop("due_sec") if i < 3 else deadlines.end_of_log(spark, end + _RETENTION + 1)
            part.write.parquet(f"{root}/log/{i}")
            stream = spark.readStream.schema(deadlines.INPUT).option("recursiveFileLookup", True).parquet(f"{root}/log")
            running = deadlines.deadline_monitor(stream, retention_sec=_RETENTION).writeStream.outputMode("append").format("parquet").option(
                "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out")
            running.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(deadlines.OUTPUT).parquet(f"{root}/out")
