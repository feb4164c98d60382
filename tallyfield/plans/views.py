"""The driver's tables read as an experiment campaign: in Spark, and as SQL text for the checks.

customer -> case (five levels per base design), orders -> task, lineitem -> transfer and
observation opportunity, supplier -> node (its region is the region of the transfer), events ->
contact windows. Every view is derived from whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.ids import base_id
from tallyfield.operators.outcomes import case_rollup, coverage, with_failure_class
from tallyfield.session import pinned

DAY = 86400.0
# Response time per priority, in days: the driver's dates are day-grained and span years.
RESPONSE_DAYS = {"Critical": 180, "High": 360, "Medium": 1080, "Low": 2160}
STRESS_FAMILIES = ("random_satellite_failure", "targeted_cn_failure", "link_window_outage", "combined_stress")
STRESS_LEVELS = (5.0, 10.0, 20.0, 30.0)
SIZE_MULTIPLIERS = (0.5, 1.0, 2.0, 4.0)
POLICIES = ("policy_central", "policy_peer", "policy_hybrid")
DESIGN = ["n_satellites", "n_planes", "altitude_km", "inclination_deg", "cn_fraction_percent", "n_central_nodes"]
SCENARIO = ["family", "topology", "routing_policy", "failure_level_percent", "replicate", "task_size_multiplier", "status"]
METRICS = [
    "observation_success_percent",
    "s100_surviving_by_deadline_percent",
    "mean_surviving_coverage_deadline_percent",
    "transferred_mbits",
    "n_transfer_events",
]


# Column types of the driver's tables. Stating them saves a job per read that looks into the files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a driver table that one task joins and groups, from ``LARGE`` rows on.
ROWS_A_TASK, LARGE = 200_000, 1_000_000


def spread(spark: SparkSession, sf_dir: str, name: str, key: str, large: int | None = None) -> DataFrame:
    """A table, dealt out by ``key`` if it is large: the memory of a task then depends on its number of rows, not on the table.

    A file's compressed size, by which the planner splits and merges tasks, says little about the hash tables and sorts its rows
    need. The number of rows comes from the footers of the files.
    """
    df = table(spark, sf_dir, name)
    rows = df.count()
    if rows < (large or LARGE):
        return df
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK)), key)


def _one_of(values, index: str) -> str:
    """SQL: the value at ``index`` of a short fixed list."""
    items = ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}D" for v in values)
    return f"element_at(array({items}), cast({index} as int) + 1)"


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five levels per base design; the code of the case holds the design."""
    return (
        spread(spark, sf_dir, "customer", "c_custkey", ROWS_A_TASK)  # one small file, and often several rows of each
        .selectExpr("c_custkey", "c_custkey div 5 as b")
        .selectExpr(
            "c_custkey", "b", "3 + b % 4 as n_planes", "(3 + b % 4) * (10 + b % 7) as n_satellites",
            "cast(500 + 50 * (b % 5) as double) as altitude_km", "530 + 10 * (b % 3) as tenths",
            "cast(c_custkey % 5 * 25 as double) as cn_fraction_percent",
        )
        .selectExpr(
            "*", "tenths / 10D as inclination_deg",
            "(n_satellites * cast(cn_fraction_percent as long)) div 100 as n_central_nodes",
            "format_string('T%03d_P%02d_H%04d_I%04d_CN%03d_F%d', n_satellites, n_planes, cast(altitude_km as long), tenths, "
            "cast(cn_fraction_percent as long), b + 1) as case_id",
        )
        .withColumn("base_id", base_id("case_id"))
        .select("c_custkey", "case_id", "base_id", *DESIGN)
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its case, scenario, priority and times in seconds."""
    shaped = (
        spread(spark, sf_dir, "orders", "o_custkey")
        .selectExpr(
            "*", "o_orderstatus = 'P' as stressed",
            f"{_one_of(STRESS_FAMILIES, 'o_orderkey div 4 % 4')} as fam",
            f"{_one_of(STRESS_LEVELS, 'o_orderkey % 4')} as lvl",
            f"{_one_of(POLICIES, 'o_orderkey div 2 % 3')} as pol",
            f"{_one_of(SIZE_MULTIPLIERS, 'o_orderkey div 16 % 4')} as siz",
            "case o_orderpriority when '1-URGENT' then 'Critical' when '2-HIGH' then 'High' when '3-MEDIUM' then 'Medium' "
            "else 'Low' end as priority_class",
            "cast(unix_timestamp(o_orderdate) as double) as created_sec",
        )
        .selectExpr(
            "*",
            "case when o_orderstatus = 'F' then if(o_orderkey % 2 = 0, 'nominal_original', pol) "
            "when o_orderstatus = 'O' then 'unlimited_useful_deadline' "
            "when fam = 'combined_stress' then format_string('combined_size_x%s_satfail_p%02d_r%02d', "
            "translate(cast(siz as string), '.', 'p'), cast(lvl as long), o_orderkey % 5) "
            "else format_string('%s_p%02d_r%02d', fam, cast(lvl as long), o_orderkey % 5) end as scenario_id",
            "case when stressed then fam when o_orderstatus = 'O' then 'unlimited' "
            "when o_orderkey % 2 = 0 then 'nominal' else 'policy_ablation' end as family",
        )
        .join(cases(spark, sf_dir), F.expr("o_custkey = c_custkey"))
    )
    return shaped.selectExpr(
        "o_orderkey as task_id", "case_id", "base_id", *DESIGN, "scenario_id", "family",
        "case scenario_id when 'policy_peer' then 'peer_only' when 'policy_hybrid' then 'hybrid' else 'central_only' end as topology",
        "case scenario_id when 'policy_peer' then 'peer' when 'policy_hybrid' then 'hybrid' else 'targeted_central' end as routing_policy",
        "if(stressed, lvl, 0D) as failure_level_percent",
        "if(stressed, o_orderkey % 5, 0L) as replicate",
        "if(stressed and fam = 'combined_stress', siz, 1D) as task_size_multiplier",
        "if(family = 'targeted_cn_failure' and cn_fraction_percent = 0, 'NOT_APPLICABLE', 'COMPLETED') as status",
        "stressed", "priority_class", "created_sec",
        f"created_sec + {DAY} * case priority_class "
        + " ".join(f"when '{name}' then {days}" for name, days in RESPONSE_DAYS.items())
        + " end as deadline_sec",
        "o_totalprice as price",
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    return table(spark, sf_dir, "supplier").join(places, F.expr("s_nationkey = n_nationkey")).selectExpr(
        "s_suppkey as node_id", "r_name as region", "s_suppkey % 10 < 3 as is_central", "s_acctbal < 0 as weak",
        "cast(s_nationkey as long) as plane_id",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as transfers and as observation opportunities, with their task and node.

    Node tables join one by one, each with its own size estimate, and the task join comes last: the
    result is partitioned by task whichever way the planner joins the nodes, and the aggregations
    by task that follow need no further shuffle.
    """
    placed = (
        spread(spark, sf_dir, "lineitem", "l_orderkey")
        .join(table(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
        .selectExpr(
            "l_orderkey", "r_name as region", "l_suppkey as node_id", "l_suppkey % 10 < 3 as is_central",
            "cast(s_nationkey as long) as plane_id", "s_acctbal < 0 as weak",
            "cast(unix_timestamp(l_shipdate) as double) as end_sec",
            f"cast(unix_timestamp(l_shipdate) as double) + (l_linenumber - 3) * {10 * DAY} as opportunity_sec",
            "l_returnflag in ('N', 'R') as is_opportunity", "cast(l_linenumber as long) as hop", "l_partkey as from_node",
            "l_quantity as mbit",
        )
    )
    return placed.join(tasks(spark, sf_dir), F.expr("l_orderkey = task_id")).selectExpr(
        "region", "task_id", "node_id", "is_central", "plane_id", "case_id", "base_id", *DESIGN, "scenario_id", *SCENARIO,
        "priority_class", "created_sec", "deadline_sec", "stressed and weak as node_failed", "end_sec", "opportunity_sec",
        "is_opportunity", "hop", "from_node", "mbit",
    )


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in order of cause: shipped on or after the day of the order."""
    return lines(spark, sf_dir).filter("end_sec >= created_sec")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, task, node): eligible as a target, when received, when observed after that.

    Keys other than (region, task, node) depend on them. Lines joined on the task key are already
    partitioned by it, so this and the next aggregation add no shuffle of their own.
    """
    keys = ["region", "task_id", "node_id", "is_central", "node_failed", "created_sec", "deadline_sec"]
    flagged = lines(spark, sf_dir).selectExpr(
        *keys, "end_sec", "opportunity_sec", "mbit", "hop", "end_sec >= created_sec as arrived",
        "is_opportunity and opportunity_sec between created_sec and deadline_sec as usable",
    )
    return flagged.groupBy(*keys).agg(
        F.expr("bool_or(usable) as eligible"),
        F.expr("min(end_sec) filter (where arrived) as recv_sec"),
        F.expr("min(opportunity_sec) filter (where arrived and usable and opportunity_sec >= end_sec) as seen_sec"),
        F.expr("coalesce(sum(mbit) filter (where arrived), 0D) as pair_mbits"),
        F.expr("count_if(arrived) as pair_transfers"),
        F.expr("max(hop) filter (where arrived) as pair_hops"),
    )


TASK_FIELDS = ["priority_class", "case_id", "base_id", "scenario_id", *DESIGN, *SCENARIO]


def task_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, task) outcomes; the task's own fields join on after the narrow aggregations."""
    out = coverage(
        pairs(spark, sf_dir),
        ["region", "task_id"],
        {
            "seen_sec": "min(seen_sec) filter (where eligible and not node_failed)",
            "transferred_mbits": "sum(pair_mbits)",
            "n_transfers": "sum(pair_transfers)",
            "max_hops": "max(pair_hops)",
        },
    ).join(tasks(spark, sf_dir).select("task_id", *TASK_FIELDS), "task_id")
    return with_failure_class(
        out.selectExpr(
            "*", "seen_sec is not null as observed_before_deadline",
            "(seen_sec - created_sec) / 60 as observation_latency_min",
        ).drop("seen_sec")
    )


CASE_KEYS = ["region", "case_id", "scenario_id"]


def case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, case, scenario) rows; design and scenario fields depend on the keys and ride along as keys."""
    return case_rollup(task_metrics(spark, sf_dir), [*CASE_KEYS, "base_id", *DESIGN, *SCENARIO])


def case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`case_metrics` written once, for analyses that go over the cases more than once."""
    return pinned(case_metrics(spark, sf_dir))


def task_table(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Chosen columns of :func:`task_metrics` written once, for analyses with several passes."""
    return pinned(task_metrics(spark, sf_dir).select(*columns))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts between users: from each event, to the user ``k`` places on, open for ``value`` minutes."""
    parsed = table(spark, sf_dir, "events").selectExpr(
        "*", "cast(get_json_object(props, '$.k') as long) as k", "unix_micros(ts) / 1e6D as s"
    )
    return parsed.selectExpr(
        "event_id as window_id", "user_id as node_i", "user_id + 1 + k % 7 as node_j", "s as start_sec",
        "s + value * 60 as end_sec", "value * 60 as duration_sec", "value * (1 + k % 5) as capacity_mbits",
        "user_id % 10 < 3 as i_central", "(user_id + 1 + k % 7) % 10 < 3 as j_central", "event_type = 'signup' as is_ground",
        "k", "event_type", "value",
    )


def _pick_sql(values, index: str) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in values)
    return f"([{items}])[({index}) + 1]"


_DESIGN = ", ".join(DESIGN)
_SCEN = ", ".join(SCENARIO)
_CARRY = ", ".join(f"max({c}) AS {c}" for c in ["base_id", *DESIGN, *SCENARIO])

SQL_VIEWS = {
    "v_cases": """
  SELECT *, regexp_replace(case_id, '_CN[0-9]{3}', '') AS base_id,
         (n_satellites * cn_fraction_percent::BIGINT) // 100 AS n_central_nodes
  FROM (SELECT c_custkey, n_satellites, n_planes, altitude_km, inclination_deg, cn_fraction_percent,
               printf('T%03d_P%02d_H%04d_I%04d_CN%03d_F%d', n_satellites, n_planes, altitude_km::BIGINT,
                      tenths, cn_fraction_percent::BIGINT, b + 1) AS case_id
        FROM (SELECT c_custkey, b, 3 + b % 4 AS n_planes, (3 + b % 4) * (10 + b % 7) AS n_satellites,
                     (500 + 50 * (b % 5))::DOUBLE AS altitude_km, 530 + 10 * (b % 3) AS tenths,
                     (530 + 10 * (b % 3)) / 10.0::DOUBLE AS inclination_deg,
                     (c_custkey % 5 * 25)::DOUBLE AS cn_fraction_percent
              FROM (SELECT c_custkey, c_custkey // 5 AS b FROM customer)))""",
    "v_tasks": f"""
  SELECT o_orderkey AS task_id, case_id, base_id, {_DESIGN}, scenario_id, family,
         CASE scenario_id WHEN 'policy_peer' THEN 'peer_only' WHEN 'policy_hybrid' THEN 'hybrid' ELSE 'central_only' END AS topology,
         CASE scenario_id WHEN 'policy_peer' THEN 'peer' WHEN 'policy_hybrid' THEN 'hybrid' ELSE 'targeted_central' END AS routing_policy,
         CASE WHEN stressed THEN lvl ELSE 0.0::DOUBLE END AS failure_level_percent,
         CASE WHEN stressed THEN o_orderkey % 5 ELSE 0 END AS replicate,
         CASE WHEN stressed AND fam = 'combined_stress' THEN siz ELSE 1.0::DOUBLE END AS task_size_multiplier,
         CASE WHEN family = 'targeted_cn_failure' AND cn_fraction_percent = 0 THEN 'NOT_APPLICABLE' ELSE 'COMPLETED' END AS status,
         stressed, priority_class, created_sec,
         created_sec + 86400 * CASE priority_class WHEN 'Critical' THEN 180 WHEN 'High' THEN 360 WHEN 'Medium' THEN 1080 ELSE 2160 END AS deadline_sec,
         o_totalprice AS price
  FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN (CASE WHEN o_orderkey % 2 = 0 THEN 'nominal_original' ELSE pol END)
                       WHEN 'O' THEN 'unlimited_useful_deadline'
                       ELSE (CASE fam WHEN 'combined_stress' THEN printf('combined_size_x%s_satfail_p%02d_r%02d', replace(siz::VARCHAR, '.', 'p'), lvl::BIGINT, o_orderkey % 5)
                             ELSE printf('%s_p%02d_r%02d', fam, lvl::BIGINT, o_orderkey % 5) END) END AS scenario_id,
               CASE WHEN stressed THEN fam WHEN o_orderstatus = 'O' THEN 'unlimited'
                    WHEN o_orderkey % 2 = 0 THEN 'nominal' ELSE 'policy_ablation' END AS family
        FROM (SELECT *, o_orderstatus = 'P' AS stressed,
                     {_pick_sql(STRESS_FAMILIES, "o_orderkey // 4 % 4")} AS fam,
                     {_pick_sql(STRESS_LEVELS, "o_orderkey % 4")} AS lvl,
                     {_pick_sql(POLICIES, "o_orderkey // 2 % 3")} AS pol,
                     {_pick_sql(SIZE_MULTIPLIERS, "o_orderkey // 16 % 4")} AS siz,
                     CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS priority_class,
                     epoch(o_orderdate)::DOUBLE AS created_sec
              FROM orders))
  JOIN v_cases ON o_custkey = c_custkey""",
    "v_nodes": """
  SELECT s_suppkey AS node_id, r_name AS region, s_suppkey % 10 < 3 AS is_central, s_acctbal < 0 AS weak,
         s_nationkey::BIGINT AS plane_id
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_lines": f"""
  SELECT region, task_id, node_id, is_central, plane_id, case_id, base_id, {_DESIGN}, scenario_id, {_SCEN},
         priority_class, created_sec, deadline_sec, stressed AND weak AS node_failed,
         epoch(l_shipdate)::DOUBLE AS end_sec, epoch(l_shipdate)::DOUBLE + (l_linenumber - 3) * 864000 AS opportunity_sec,
         l_returnflag IN ('N', 'R') AS is_opportunity, l_linenumber::BIGINT AS hop, l_partkey AS from_node, l_quantity AS mbit
  FROM lineitem JOIN v_tasks ON l_orderkey = task_id JOIN v_nodes ON l_suppkey = node_id""",
    "v_transfers": "SELECT * FROM v_lines WHERE end_sec >= created_sec",
    "v_pairs": f"""
  SELECT region, task_id, node_id, is_central, node_failed, created_sec, deadline_sec,
         bool_or(is_opportunity AND opportunity_sec BETWEEN created_sec AND deadline_sec) AS eligible,
         min(end_sec) FILTER (end_sec >= created_sec) AS recv_sec,
         min(opportunity_sec) FILTER (end_sec >= created_sec AND is_opportunity AND opportunity_sec >= end_sec
                                      AND opportunity_sec BETWEEN created_sec AND deadline_sec) AS seen_sec,
         coalesce(sum(mbit) FILTER (end_sec >= created_sec), 0) AS pair_mbits,
         count(*) FILTER (end_sec >= created_sec) AS pair_transfers,
         max(hop) FILTER (end_sec >= created_sec) AS pair_hops
  FROM v_lines GROUP BY ALL""",
    "v_task_metrics": f"""
  SELECT *, CASE WHEN original_target_count > 0 THEN 100.0::DOUBLE * reached_original_by_deadline / original_target_count END AS original_coverage_deadline_percent,
         CASE WHEN original_target_count > 0 THEN 100.0::DOUBLE * reached_original_by_end / original_target_count END AS original_coverage_end_percent,
         CASE WHEN surviving_target_count > 0 THEN 100.0::DOUBLE * reached_surviving_by_deadline / surviving_target_count END AS surviving_coverage_deadline_percent,
         CASE WHEN surviving_target_count > 0 THEN 100.0::DOUBLE * reached_surviving_by_end / surviving_target_count END AS surviving_coverage_end_percent,
         original_target_count > 0 AND reached_original_by_deadline = original_target_count AS s100_original_by_deadline,
         original_target_count > 0 AND reached_original_by_end = original_target_count AS s100_original_by_end,
         surviving_target_count > 0 AND reached_surviving_by_deadline = surviving_target_count AS s100_surviving_by_deadline,
         surviving_target_count > 0 AND reached_surviving_by_end = surviving_target_count AS s100_surviving_by_end,
         CASE WHEN surviving_target_count > 0 AND reached_surviving_by_end = surviving_target_count THEN (last_alive - created_sec) / 60 END AS t100_surviving_min,
         NOT (surviving_target_count > 0 AND reached_surviving_by_end = surviving_target_count) AS t100_surviving_censored,
         seen IS NOT NULL AS observed_before_deadline, (seen - created_sec) / 60 AS observation_latency_min,
         CASE WHEN original_target_count = 0 THEN 'geometry_failure_no_eligible_receiver'
              WHEN reached_surviving_by_deadline = 0 THEN 'communication_failure_no_target_reached'
              WHEN seen IS NULL THEN 'routing_or_timing_failure' ELSE 'success' END AS failure_class
  FROM (SELECT region, task_id, created_sec, deadline_sec,
               count(*) FILTER (eligible) AS original_target_count,
               count(*) FILTER (eligible AND NOT node_failed) AS surviving_target_count,
               count(*) FILTER (eligible AND recv_sec <= deadline_sec + 1e-9) AS reached_original_by_deadline,
               count(*) FILTER (eligible AND recv_sec IS NOT NULL) AS reached_original_by_end,
               count(*) FILTER (eligible AND NOT node_failed AND recv_sec <= deadline_sec + 1e-9) AS reached_surviving_by_deadline,
               count(*) FILTER (eligible AND NOT node_failed AND recv_sec IS NOT NULL) AS reached_surviving_by_end,
               max(recv_sec) FILTER (eligible AND NOT node_failed) AS last_alive,
               min(seen_sec) FILTER (eligible AND NOT node_failed) AS seen,
               sum(pair_mbits) AS transferred_mbits, sum(pair_transfers)::BIGINT AS n_transfers, max(pair_hops) AS max_hops
        FROM v_pairs GROUP BY ALL)
  JOIN (SELECT task_id, priority_class, case_id, base_id, scenario_id, {_DESIGN}, {_SCEN} FROM v_tasks) USING (task_id)""",
    "v_case_metrics": f"""
  SELECT region, case_id, scenario_id, {_CARRY}, count(*) AS n_tasks,
         avg(original_coverage_deadline_percent) AS mean_original_coverage_deadline_percent,
         avg(surviving_coverage_deadline_percent) AS mean_surviving_coverage_deadline_percent,
         100 * avg(s100_original_by_deadline::INT) AS s100_original_by_deadline_percent,
         100 * avg(s100_surviving_by_deadline::INT) AS s100_surviving_by_deadline_percent,
         100 * avg(observed_before_deadline::INT) AS observation_success_percent,
         count(*) FILTER (failure_class LIKE 'geometry%') AS geometry_failure_count,
         count(*) FILTER (failure_class LIKE 'communication%') AS communication_failure_count,
         count(*) FILTER (failure_class LIKE 'routing%') AS routing_or_timing_failure_count,
         count(t100_surviving_min) AS t100_completed_count,
         count(*) FILTER (t100_surviving_censored) AS t100_censored_count,
         max(t100_surviving_min) AS p100_t100_surviving_min,
         sum(transferred_mbits) AS transferred_mbits, sum(n_transfers)::BIGINT AS n_transfer_events,
         max(max_hops) AS max_hops_seen
  FROM v_task_metrics GROUP BY region, case_id, scenario_id""",
    "v_windows": """
  SELECT event_id AS window_id, user_id AS node_i, user_id + 1 + k % 7 AS node_j, s AS start_sec, s + value * 60 AS end_sec,
         value * 60 AS duration_sec, value * (1 + k % 5) AS capacity_mbits, user_id % 10 < 3 AS i_central,
         (user_id + 1 + k % 7) % 10 < 3 AS j_central, event_type = 'signup' AS is_ground, k, event_type, value
  FROM (SELECT *, epoch_us(ts) / 1e6 AS s, regexp_extract(props, '"k": (\\d+)', 1)::BIGINT AS k FROM events)""",
}


def with_views(sql: str) -> str:
    """Put the views that ``sql`` names, and those they name, in front of it as CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in SQL_VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(SQL_VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    head = ",\n".join(f"{name} AS MATERIALIZED ({SQL_VIEWS[name]})" for name in needed)
    body = sql.strip()
    recursive = "RECURSIVE " if re.match(r"(?i)with\s+recursive", body) else ""
    if re.match(r"(?i)with\b", body):
        body = re.sub(r"(?i)^with(\s+recursive)?\s+", "", body, count=1)
        return f"WITH {recursive}{head},\n{body}"
    return f"WITH {head}\n{body}"
