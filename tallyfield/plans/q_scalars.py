"""Column functions over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import ids, scalars, tables
from tallyfield.operators.ordered import numbered
from tallyfield.plans import views as V
from tallyfield.plans.registry import query
from tallyfield.plans.shape import rounded

DESIGN_SQL = ", ".join(V.DESIGN[:5])


@query("F01_parse_case_id", f"""
SELECT case_id, {DESIGN_SQL}, split_part(case_id, '_F', 2)::BIGINT AS walker_f FROM v_cases""")
def parse_case_id(spark, sf_dir):
    return ids.parse_case_id(V.cases(spark, sf_dir).select("case_id"))


@query("F02_base_id", """
SELECT case_id, regexp_replace(case_id, '_CN[0-9]{3}(_F[0-9]+)$', '\\1') AS base_id FROM v_cases""")
def base_id(spark, sf_dir):
    return V.cases(spark, sf_dir).select("case_id", ids.base_id("case_id").alias("base_id"))


@query("F03_format_case_id", """
SELECT c_custkey, printf('T%03d_P%02d_H%04d_I%04d_CN%03d_F%d', n_satellites, n_planes, round_even(altitude_km + c_custkey % 4 * 0.5, 0)::BIGINT,
       round_even((inclination_deg + c_custkey % 5 * 0.05) * 10, 0)::BIGINT, round_even(cn_fraction_percent, 0)::BIGINT, c_custkey % 9) AS case_code
FROM v_cases""")
def format_case_id(spark, sf_dir):
    code = ids.format_case_id(
        F.col("n_satellites"), F.col("n_planes"), F.expr("altitude_km + c_custkey % 4 * 0.5D"),
        F.expr("inclination_deg + c_custkey % 5 * 0.05D"), F.col("cn_fraction_percent"), F.expr("c_custkey % 9"),
    )
    return V.cases(spark, sf_dir).select("c_custkey", code.alias("case_code"))


@query("F04_to_numeric", """
SELECT c_custkey, CASE WHEN isnan(x) THEN NULL ELSE x END AS number
FROM (SELECT c_custkey, TRY_CAST(CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'NaN' ELSE substr(c_name, 10) END AS DOUBLE) AS x FROM customer)""")
def to_numeric(spark, sf_dir):
    text = F.expr("case c_custkey % 3 when 0 then c_mktsegment when 1 then 'NaN' else substr(c_name, 10) end")
    return V.table(spark, sf_dir, "customer").select("c_custkey", scalars.to_number(text).alias("number"))


@query("F05_to_bool", """
SELECT o_orderkey, coalesce(lower(trim(t)) = 'true', false) AS flag
FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN ' TRUE ' WHEN '2-HIGH' THEN 'true' WHEN '3-MEDIUM' THEN 'yes' WHEN '5-LOW' THEN 'False' END AS t FROM orders)""")
def to_bool(spark, sf_dir):
    text = F.expr("case o_orderpriority when '1-URGENT' then ' TRUE ' when '2-HIGH' then 'true' when '3-MEDIUM' then 'yes' when '5-LOW' then 'False' end")
    return V.table(spark, sf_dir, "orders").select("o_orderkey", scalars.to_bool(text).alias("flag"))


@query("F08_scenario_filter", """
SELECT scenario_id, family, count(*) AS n_tasks,
       TRY_CAST(replace(nullif(regexp_extract(scenario_id, '_x([0-9]+(p[0-9]+)?)', 1), ''), 'p', '.') AS DOUBLE) AS multiplier
FROM v_tasks WHERE lower(scenario_id) IN ('nominal_original', 'unlimited_useful_deadline') OR regexp_matches(lower(family), 'combined|targeted')
GROUP BY ALL""")
def scenario_filter(spark, sf_dir):
    kept = scalars.scenario_filter(
        V.tasks(spark, sf_dir), ["Nominal_Original", "unlimited_useful_deadline"], "combined|targeted"
    )
    return kept.groupBy("scenario_id", "family").agg(F.count("*").alias("n_tasks")).withColumn(
        "multiplier", scalars.multiplier_from_id(F.col("scenario_id"))
    )


@query("F09_epoch_seconds", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6, 6) END AS seconds,
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events""")
def epoch_seconds(spark, sf_dir):
    text = F.expr("if(event_type = 'error', 'not a time', cast(ts as string))")
    return rounded(V.table(spark, sf_dir, "events").select(
        "event_id",
        scalars.epoch_seconds(text, F.lit("2024-01-01 00:00:00")).alias("seconds"),
        scalars.iso_utc(F.col("ts")).alias("iso"),
    ))


@query("F10_infer_epoch", """
SELECT event_type, date_trunc('hour', min(ts)) AS epoch,
       round(greatest(24, (epoch_us(max(ts + INTERVAL 6 HOUR)) - epoch_us(date_trunc('hour', min(ts)))) / 3.6e9 + 2), 6) AS horizon_hours
FROM events GROUP BY event_type""")
def infer_epoch(spark, sf_dir):
    timed = V.table(spark, sf_dir, "events").selectExpr("event_type", "ts", "ts + interval 6 hours as deadline")
    return rounded(tables.infer_epoch(timed, "ts", "deadline", ["event_type"], "hour", 24, 2))


@query("F11_derive_deadline", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_minutes(o_orderkey % 50) WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL 5 DAY
       ELSE o_orderdate + to_minutes(CASE o_orderpriority WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 60 WHEN '3-MEDIUM' THEN 180 ELSE 360 END) END AS deadline
FROM orders""")
def derive_deadline(spark, sf_dir):
    df = V.table(spark, sf_dir, "orders").selectExpr(
        "*", "if(o_orderkey % 3 = 0, o_orderkey % 50, null) as response",
        "if(o_orderkey % 3 = 1, o_orderdate + interval 5 days, null) as given",
        "case o_orderpriority when '1-URGENT' then 'Critical' when '2-HIGH' then 'High' when '3-MEDIUM' then 'Medium' else 'Low' end as p",
    )
    due = scalars.derive_deadline(F.col("o_orderdate"), F.col("response"), F.col("given"), F.col("p"))
    return df.select("o_orderkey", due.alias("deadline"))


@query("F12_remap_times", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position,
       TIMESTAMP '2026-01-01 00:00:00' + to_seconds(90 * (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)) AS remapped_ts
FROM orders""")
def remap_times(spark, sf_dir):
    df = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return tables.remap_times(df, "o_orderdate", "o_orderkey", "2026-01-01 00:00:00", 1.5).drop("o_orderdate")


def _raw_tasks(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as ID", "cast(if(o_orderkey % 7 = 0, 'n/a', cast(o_custkey % 90 as string)) as string) as centroid_lat",
        "cast(o_custkey % 180 as string) as Lon", "lower(substr(o_orderpriority, 3)) as Priority",
        "if(o_orderkey % 2 = 0, o_totalprice / 1000, null) as size_mbits", "o_orderdate as Timestamp",
    )


_RAW_SQL = """
SELECT o_orderkey::VARCHAR AS task_id, (o_custkey % 90)::DOUBLE AS latitude, (o_custkey % 180)::DOUBLE AS longitude,
       CASE o_orderpriority WHEN '2-HIGH' THEN 'High' WHEN '5-LOW' THEN 'Low' ELSE 'Medium' END AS priority_class,
       CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 1000 ELSE 0.5 END AS task_size_mbits,
       CASE o_orderpriority WHEN '2-HIGH' THEN 60.0::DOUBLE WHEN '5-LOW' THEN 360.0::DOUBLE ELSE 180.0::DOUBLE END AS required_response_time_min,
       o_orderdate AS timestamp_utc
FROM orders WHERE o_orderkey % 7 <> 0"""


@query("F13_normalize_tasks", f"SELECT * REPLACE (round(task_size_mbits, 6) AS task_size_mbits) FROM ({_RAW_SQL})")
def normalize_tasks(spark, sf_dir):
    return rounded(tables.normalize_tasks(_raw_tasks(spark, sf_dir)))


@query("F13_task_assertions", f"""
WITH n AS ({_RAW_SQL}), c AS (
  SELECT count(*) FILTER (NOT (required_response_time_min > 0)) AS a, count(*) FILTER (NOT (task_size_mbits > 0)) AS b,
         count(*) FILTER (abs(latitude) > 90 OR abs(longitude) > 180) AS d FROM n)
SELECT "check", violations, violations = 0 AS passed FROM (
  SELECT 'deadline_after_creation' AS "check", a AS violations FROM c UNION ALL SELECT 'positive_size', b FROM c
  UNION ALL SELECT 'known_priority', 0 FROM c UNION ALL SELECT 'coordinates_in_range', d FROM c)""")
def task_assertions(spark, sf_dir):
    tasks = tables.normalize_tasks(_raw_tasks(spark, sf_dir)).selectExpr(
        "*", "cast(unix_timestamp(timestamp_utc) as double) as created_sec",
        "unix_timestamp(timestamp_utc) + required_response_time_min * 60 as deadline_sec",
    )
    return tables.task_assertions(tasks)


@query("F14_horizon_check", """
SELECT priority_class, max(created_sec) AS latest_created_sec, max(deadline_sec) AS latest_deadline_sec,
       max(created_sec) <= 3.6e3 * 300000 AND max(deadline_sec) <= 3.6e3 * 300000 AS passed FROM v_tasks GROUP BY priority_class""")
def horizon_check(spark, sf_dir):
    return tables.horizon_check(V.tasks(spark, sf_dir), 300000, ["priority_class"])


@query("F15_task_size", """
SELECT task_id, 2.5::DOUBLE AS fixed_size, CASE priority_class WHEN 'Critical' THEN 2.0::DOUBLE WHEN 'High' THEN 1.5::DOUBLE WHEN 'Medium' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS priority_size,
       CASE WHEN price - 250000 > 0 THEN round(price - 250000, 6) ELSE 0.5 END AS declared_size,
       task_size_multiplier * CASE priority_class WHEN 'Critical' THEN 2.0 WHEN 'High' THEN 1.5 WHEN 'Medium' THEN 1.0 ELSE 0.5 END AS scenario_size
FROM v_tasks""")
def task_size(spark, sf_dir):
    by_class = scalars.task_size("priority", priority=F.col("priority_class"), sizes=scalars.PRIORITY_SIZE_MBIT)
    return rounded(V.tasks(spark, sf_dir).select(
        "task_id",
        scalars.task_size("fixed", fixed=2.5).alias("fixed_size"),
        by_class.alias("priority_size"),
        scalars.task_size("declared", declared=F.expr("price - 250000")).alias("declared_size"),
        (by_class * F.col("task_size_multiplier")).alias("scenario_size"),
    ))


@query("F15_csv_row_size")
def csv_row_size(spark, sf_dir):
    """Rows only: the length depends on how the engine writes numbers as JSON."""
    tasks = V.tasks(spark, sf_dir)
    return tables.csv_row_size(tasks, tasks.columns, 100.0).select("task_id", "task_size_mbits")


@query("F16_priority_package", """
SELECT o_orderkey, 'unpackaged' AS label_none, 0 AS rank_none,
       CASE p WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'urgent' WHEN '3-MEDIUM' THEN 'routine' WHEN '5-LOW' THEN 'routine' ELSE 'unknown' END AS label_two,
       CASE p WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '5-LOW' THEN 1 ELSE 9 END AS rank_two,
       CASE p WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'unknown' END AS label_four,
       CASE p WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 ELSE 9 END AS rank_four
FROM (SELECT o_orderkey, o_orderpriority AS p FROM orders)""")
def priority_package(spark, sf_dir):
    p = F.expr("case o_orderpriority when '1-URGENT' then 'Critical' when '2-HIGH' then 'High' when '3-MEDIUM' then 'Medium' when '5-LOW' then 'Low' else 'Other' end")
    columns = []
    for short, mode in (("none", "none"), ("two", "two_level"), ("four", "four_level")):
        label, rank = scalars.priority_package(F.col("p"), mode)
        columns += [label.alias(f"label_{short}"), rank.alias(f"rank_{short}")]
    return V.table(spark, sf_dir, "orders").withColumn("p", p).select("o_orderkey", *columns)


@query("F17_window_capacity", """
SELECT window_id, round(rate, 6) AS data_rate_bps, round(greatest(volume * 0.8, 0), 6) AS capacity_mbits, src AS capacity_source
FROM (SELECT *, CASE WHEN total > 0 THEN total ELSE rate * greatest(duration_sec, 0) / 1e6 END AS volume
  FROM (SELECT window_id, duration_sec, total,
    CASE WHEN mean_rate > 0 THEN mean_rate WHEN total > 0 THEN total * 1e6 / greatest(duration_sec, 1) WHEN is_ground THEN 2000000 ELSE 19200 END AS rate,
    CASE WHEN total > 0 THEN 'existing_total_data_mbits' WHEN mean_rate > 0 THEN 'existing_mean_data_rate' WHEN is_ground THEN 'assigned_sat_gs_band_rate' ELSE 'assigned_band_rate_fallback' END AS src
    FROM (SELECT *, CASE WHEN k % 3 = 0 THEN capacity_mbits END AS total, CASE WHEN k % 4 = 0 THEN value * 1000 END AS mean_rate FROM v_windows)))""")
def window_capacity(spark, sf_dir):
    df = V.windows(spark, sf_dir).selectExpr(
        "*", "if(k % 3 = 0, capacity_mbits, null) as total", "if(k % 4 = 0, value * 1000, null) as mean_rate"
    ).drop("capacity_mbits")
    made = scalars.window_capacity(
        F.col("duration_sec"), F.lit(0.8), F.col("total"), F.col("mean_rate"), F.col("is_ground"), 19200.0, 2_000_000.0
    )
    return rounded(df.select("window_id", *[c.alias(n) for n, c in made.items()]))


@query("F18_link_type", """
SELECT window_id, CASE WHEN i_central AND j_central THEN 'cn_to_cn' WHEN i_central THEN 'cn_to_obs' WHEN j_central THEN 'obs_to_cn' ELSE 'obs_to_obs' END AS link_type
FROM v_windows""")
def link_type(spark, sf_dir):
    return V.windows(spark, sf_dir).select("window_id", scalars.link_type(F.col("i_central"), F.col("j_central")).alias("link_type"))


@query("F18_readable_labels", """
SELECT family, scenario_id, count(*) AS n, CASE family WHEN 'random_satellite_failure' THEN 'Random satellite loss' WHEN 'targeted_cn_failure' THEN 'Targeted Central Node loss'
  WHEN 'link_window_outage' THEN 'Link-window outage' WHEN 'combined_stress' THEN 'Combined stress' WHEN 'policy_ablation' THEN 'Policy Ablation' WHEN 'nominal' THEN 'Nominal' ELSE 'Unlimited' END AS failure_label,
  CASE WHEN scenario_id LIKE '%central%' THEN 'Central Node routing' WHEN scenario_id LIKE '%peer%' THEN 'Peer routing' WHEN scenario_id LIKE '%hybrid%' THEN 'Hybrid routing' ELSE 'Nominal routing' END AS policy_label
FROM v_tasks GROUP BY family, scenario_id""")
def readable_labels(spark, sf_dir):
    counts = V.tasks(spark, sf_dir).groupBy("family", "scenario_id").agg(F.count("*").alias("n"))
    return counts.withColumns({
        "failure_label": scalars.failure_label(F.col("family")), "policy_label": scalars.policy_label(F.col("scenario_id"))})


@query("F20_cost_vector", """
SELECT region, case_id, scenario_id, n_satellites, n_planes, n_central_nodes, round(transferred_mbits, 6) AS transferred_mbits, n_transfer_events,
       round(n_satellites * 3.0 + n_planes * 10.0 + n_central_nodes * 2.5 + transferred_mbits * 0.01, 6) AS monetary_cost
FROM v_case_metrics WHERE scenario_id IN ('nominal_original', 'unlimited_useful_deadline', 'policy_peer', 'policy_hybrid')""")
def cost_vector(spark, sf_dir):
    kept = scalars.scenario_filter(
        V.case_metrics(spark, sf_dir), ["nominal_original", "unlimited_useful_deadline", "policy_peer", "policy_hybrid"]
    )
    keep = [*V.CASE_KEYS, "n_satellites", "n_planes", "n_central_nodes", "transferred_mbits", "n_transfer_events"]
    prices = {"n_satellites": 3.0, "n_planes": 10.0, "n_central_nodes": 2.5, "transferred_mbits": 0.01}
    return rounded(scalars.cost_vector(kept, keep, prices))


@query("F22_haversine", """
SELECT c_custkey, round(2 * 6378.137 * atan2(sqrt(h), sqrt(1 - h)), 4) AS km FROM (
  SELECT c_custkey, pow(sin(radians(b2 - b1) / 2), 2) + cos(radians(b1)) * cos(radians(b2)) * pow(sin(radians(l2 - l1) / 2), 2) AS h FROM (
    SELECT c_custkey, (c_custkey % 160 - 80)::DOUBLE AS b1, (c_custkey % 350 - 170)::DOUBLE AS l1, c_acctbal / 200 AS b2, (c_nationkey * 7)::DOUBLE AS l2 FROM customer))""")
def haversine(spark, sf_dir):
    df = V.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "cast(c_custkey % 160 - 80 as double) as b1", "cast(c_custkey % 350 - 170 as double) as l1",
        "c_acctbal / 200 as b2", "cast(c_nationkey * 7 as double) as l2",
    )
    km = scalars.haversine_km(F.col("b1"), F.col("l1"), F.col("b2"), F.col("l2"))
    return rounded(df.select("c_custkey", km.alias("km")), 4)


@query("F23_seed_hex", """
SELECT task_id, substr(sha256('20260101|' || case_id || '|' || scenario_id || '|' || replicate), 1, 16) AS seed FROM v_tasks""")
def seed_hex(spark, sf_dir):
    seed = ids.seed_hex(F.lit(20260101), F.col("case_id"), F.col("scenario_id"), F.col("replicate"))
    return V.tasks(spark, sf_dir).select("task_id", seed.alias("seed"))


@query("F23_fingerprint", """
WITH d AS (SELECT o_orderstatus, sha256(length(o_orderkey::VARCHAR) || ':' || o_orderkey || length(o_orderpriority) || ':' || o_orderpriority) AS h FROM orders),
t AS (SELECT o_orderstatus, count(*) AS n,
        sum(('0x' || substr(h, 1, 13))::BIGINT) AS a, sum(('0x' || substr(h, 14, 13))::BIGINT) AS b, sum(('0x' || substr(h, 27, 13))::BIGINT) AS c
      FROM d GROUP BY o_orderstatus)
SELECT o_orderstatus, sha256(n || '|' || lpad(a::VARCHAR, 38, '0') || '|' || lpad(b::VARCHAR, 38, '0') || '|' || lpad(c::VARCHAR, 38, '0')) AS fingerprint FROM t""")
def fingerprint(spark, sf_dir):
    rows = V.table(spark, sf_dir, "orders").select("o_orderstatus", ids.row_digest(F.col("o_orderkey"), F.col("o_orderpriority")).alias("h"))
    return rows.groupBy("o_orderstatus").agg(ids.digest_sum(F.col("h")).alias("fingerprint"))


@query("F24_slug", """
SELECT p_partkey, trim(regexp_replace(p_name || ' #' || p_brand, '[^A-Za-z0-9_-]+', '_', 'g'), '_') AS name_slug, replace(p_retailprice::VARCHAR, '.', 'p') AS price_slug FROM part""")
def slug(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select(
        "p_partkey", ids.slug(F.concat("p_name", F.lit(" #"), "p_brand")).alias("name_slug"),
        ids.number_slug(F.col("p_retailprice")).alias("price_slug"),
    )


@query("F06_scientific_rows", """
SELECT region, case_id, scenario_id, status, n_tasks FROM v_case_metrics m
WHERE status = 'COMPLETED' AND case_id IN (SELECT case_id FROM v_cases JOIN customer USING (c_custkey) WHERE c_acctbal >= 0)""")
def scientific_rows(spark, sf_dir):
    from tallyfield.operators.joins import keep_members

    done = V.cases(spark, sf_dir).join(V.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey").filter("c_acctbal >= 0")
    return keep_members(V.case_metrics(spark, sf_dir).filter("status = 'COMPLETED'"), done, ["case_id"]).select(
        *V.CASE_KEYS, "status", "n_tasks"
    )


@query("F07_balanced_subset", """
WITH ok AS (SELECT region, scenario_id, base_id FROM v_case_metrics WHERE cn_fraction_percent IN (0, 25, 50, 75, 100) GROUP BY ALL HAVING count(DISTINCT cn_fraction_percent) = 5)
SELECT m.region, m.scenario_id, m.base_id, case_id, n_tasks FROM v_case_metrics m JOIN ok USING (region, scenario_id, base_id)
WHERE cn_fraction_percent IN (0, 25, 50, 75, 100)""")
def balanced_subset(spark, sf_dir):
    from tallyfield.operators.joins import balanced_subset as balanced

    return balanced(
        V.case_table(spark, sf_dir), ["region", "scenario_id", "base_id"], "cn_fraction_percent", [0, 25, 50, 75, 100]
    ).select("region", "scenario_id", "base_id", "case_id", "n_tasks")


@query("F21_followup_plan", """
SELECT case_id, target, greatest(n_planes, (round_even(target / n_planes::DOUBLE, 0) * n_planes)::BIGINT) AS n_satellites_planned, n_planes,
       greatest(n_planes, (round_even(target / n_planes::DOUBLE, 0) * n_planes)::BIGINT) <> target AS adjusted
FROM v_cases, (VALUES (500), (1000)) t(target)""")
def followup_plan(spark, sf_dir):
    from tallyfield.operators.grid import followup_plan as plan

    return plan(V.cases(spark, sf_dir), (500, 1000)).select("case_id", "target", "n_satellites_planned", "n_planes", "adjusted")
