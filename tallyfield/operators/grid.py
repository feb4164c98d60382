"""Design and scenario grids. Level lists are explodes of short arrays, not joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.ids import base_id, format_case_id
from tallyfield.operators.ordered import attach


def _literals(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def level_sets(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """One row holding the sorted distinct levels of each factor found in a table.

    Design factors have few levels; distinct values are reduced before they are gathered.
    """
    long = df.select(*[F.col(f).cast("double").alias(f) for f in factors]).unpivot([], list(factors), "factor", "level")
    seen = long.filter("level is not null").distinct()
    picks = [F.expr(f"array_sort(collect_set(level) filter (where factor = '{f}')) as `{f}`") for f in factors]
    return seen.agg(*picks)


def design_grid(levels: DataFrame, factors: Sequence[str], divisible: tuple[str, str] | None = None) -> DataFrame:
    """All combinations of the level arrays, without those where the first of ``divisible`` is no multiple of the second."""
    out = levels
    for f in factors:
        out = out.withColumn(f, F.explode(f))
    if divisible:
        out = out.filter(F.col(divisible[0]) % F.col(divisible[1]) == 0)
    return out.select(*factors)


# The core scenarios as (name, family, topology, policy, receivers, cutoff).
CORE_SCENARIOS = (
    ("nominal_original", "nominal", "central_only", "targeted_central", "all_useful", "deadline"),
    ("unlimited_useful_deadline", "unlimited", "central_only", "targeted_central", "all_useful", "deadline"),
    ("unlimited_useful_sim_end", "unlimited", "central_only", "targeted_central", "all_useful", "simulation_end"),
    ("unlimited_all_satellites_sim_end", "unlimited", "hybrid", "hybrid", "all_satellites", "simulation_end"),
    ("policy_central", "policy_ablation", "central_only", "targeted_central", "all_useful", "deadline"),
    ("policy_peer", "policy_ablation", "peer_only", "peer", "all_useful", "deadline"),
    ("policy_hybrid", "policy_ablation", "hybrid", "hybrid", "all_useful", "deadline"),
)
SEEDED_FAMILIES = ("random_satellite_failure", "random_cn_failure", "link_window_outage", "ground_station_outage")
SINGLE_FAMILIES = ("targeted_cn_failure", "capacity_degradation")
DEFAULT_SCENARIOS = {
    "multipliers": (0.5, 1.0, 2.0, 4.0),
    "levels": (5.0, 10.0, 20.0, 30.0),
    "seeds": 30,
    "combined_multipliers": (2.0, 4.0),
    "combined_levels": (10.0, 20.0),
    "combined_seeds": 10,
}
SCENARIO_COLUMNS = (
    "scenario_id", "family", "topology", "routing_policy", "receiver_target", "delivery_cutoff",
    "task_size_multiplier", "failure_type", "failure_level_percent", "replicate", "capacity_factor",
)


def scenario_manifest(anchor: DataFrame, config: Mapping[str, object] = DEFAULT_SCENARIOS) -> DataFrame:
    """Every scenario of a campaign, unfolded from the rows of ``anchor`` (one row: one campaign; or one row per case).

    The scenarios depend on ``config`` alone: they are named once, and travel as one array. Rows of ``anchor`` are dealt out first, since a
    small file would be one task that makes hundreds of rows from each of its own.
    """
    one = _scenarios(anchor.sparkSession, config).agg(F.collect_list(F.struct(*SCENARIO_COLUMNS)).alias("_scenarios"))
    dealt = anchor.repartition(int(anchor.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return attach(dealt, one, []).selectExpr(*anchor.columns, "inline(_scenarios)")


def _scenarios(spark: SparkSession, config: Mapping[str, object]) -> DataFrame:
    """The scenarios of one campaign, one row each."""
    anchor = spark.range(1)
    plain = {
        "topology": "'central_only'", "routing_policy": "'targeted_central'", "receiver_target": "'all_useful'",
        "delivery_cutoff": "'deadline'", "task_size_multiplier": "1D", "failure_type": "'none'",
        "failure_level_percent": "0D", "replicate": "0L", "capacity_factor": "1D",
    }

    def made(df: DataFrame, **columns: str) -> DataFrame:
        merged = {**plain, **columns}
        return df.selectExpr(*[f"{merged[c]} as {c}" for c in SCENARIO_COLUMNS])

    doubles = lambda values: "array(" + ", ".join(f"{float(v)}D" for v in values) + ")"
    names = lambda values: "array(" + ", ".join(f"'{v}'" for v in values) + ")"
    core = ", ".join("named_struct('n','%s','f','%s','t','%s','p','%s','r','%s','c','%s')" % row for row in CORE_SCENARIOS)
    parts = [
        made(
            anchor.selectExpr("*", f"inline(array({core}))"),
            scenario_id="n", family="f", topology="t", routing_policy="p", receiver_target="r", delivery_cutoff="c",
        ),
        made(
            anchor.selectExpr("*", f"explode({doubles(config['multipliers'])}) as x"),
            scenario_id="concat('task_size_x', translate(cast(x as string), '.', 'p'))", family="'task_size'", task_size_multiplier="x",
        ),
        made(
            anchor.selectExpr("*", f"explode({names(SEEDED_FAMILIES)}) as f")
            .selectExpr("*", f"explode({doubles(config['levels'])}) as p")
            .selectExpr("*", f"explode(sequence(0L, {int(config['seeds']) - 1}L)) as r"),
            scenario_id="format_string('%s_p%02d_r%02d', f, cast(p as long), r)", family="f", failure_type="f",
            failure_level_percent="p", replicate="r",
        ),
        made(
            anchor.selectExpr("*", f"explode({names(SINGLE_FAMILIES)}) as f").selectExpr("*", f"explode({doubles(config['levels'])}) as p"),
            scenario_id="format_string('%s_p%02d', f, cast(p as long))", family="f", failure_type="f", failure_level_percent="p",
            capacity_factor="if(f = 'capacity_degradation', greatest(0D, 1 - p / 100), 1D)",
        ),
        made(
            anchor.selectExpr("*", f"explode({doubles(config['combined_multipliers'])}) as x")
            .selectExpr("*", f"explode({doubles(config['combined_levels'])}) as p")
            .selectExpr("*", f"explode(sequence(0L, {int(config['combined_seeds']) - 1}L)) as r"),
            scenario_id="format_string('combined_size_x%s_satfail_p%02d_r%02d', translate(cast(x as string), '.', 'p'), cast(p as long), r)",
            family="'combined_stress'", task_size_multiplier="x", failure_type="'random_satellite_failure'",
            failure_level_percent="p", replicate="r",
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def case_manifest(bases: DataFrame, regions: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """Base designs x regions x levels, with the case code."""
    out = bases.withColumn("region", F.explode(_literals(regions))).withColumn(
        "cn_fraction_percent", F.explode(_literals([float(f) for f in fractions]))
    )
    code = format_case_id(*[F.col(c) for c in ("n_satellites", "n_planes", "altitude_km", "inclination_deg", "cn_fraction_percent", "walker_f")])
    return out.withColumn("case_id", code).withColumn("base_id", base_id("case_id"))


# Families whose task rows are always kept.
MAIN_FAMILIES = ("nominal", "unlimited", "policy_ablation", "task_size")
# Limits of the nominal scenario, and the scenarios that keep transfers.
NOMINAL_LIMITS = {"max_forwarding_hops": 3, "max_observer_copies": 3, "max_cn_copies": 5}
TRANSFER_SCENARIOS = ("nominal_original", "unlimited_useful_deadline")


def scenario_details(manifest: DataFrame, limits: Mapping[str, int] = NOMINAL_LIMITS, transfer_scenarios: Sequence[str] = TRANSFER_SCENARIOS) -> DataFrame:
    """The manifest with hop and copy limits and what each scenario keeps.

    Only the nominal scenario is limited; elsewhere -1 hops means any number and 0 copies means no limit. The main families keep task
    detail; the named nominal and unlimited scenarios keep transfers.
    """
    quoted = lambda values: ", ".join(f"'{v}'" for v in values) or "null"
    free = {"max_forwarding_hops": -1, "max_observer_copies": 0, "max_cn_copies": 0}
    limited = [f"if(scenario_id = 'nominal_original', {int(limits[c])}L, {none}L) as {c}" for c, none in free.items()]
    return manifest.selectExpr(
        "*", *limited, f"family in ({quoted(MAIN_FAMILIES)}) as retain_task_metrics",
        f"coalesce(family in ('nominal', 'unlimited') and scenario_id in ({quoted(transfer_scenarios)}), false) as retain_transfers",
    )


def repeated_scenarios(manifest: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, scenario_id, n) of ids that a campaign lists more than once; a sound manifest gives no rows."""
    return manifest.groupBy(*keys, "scenario_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def retention_plan(
    rows: DataFrame, detail_levels: Sequence[float], detail_sizes: Sequence[int],
    transfer_scenarios: Sequence[str] = ("nominal_original", "unlimited_useful_deadline"), kept_seeds: int = 1,
) -> DataFrame:
    """Which (case, scenario) rows keep task detail (main and unseeded families, and the first seeds
    of the others) and transfer detail (named scenarios at chosen levels and fleet sizes)."""
    quoted = lambda values: ", ".join(f"'{v}'" for v in values)
    single = f"family in ({quoted(SINGLE_FAMILIES)}) and {kept_seeds} > 0"
    return rows.selectExpr(
        "*",
        f"family in ({quoted(MAIN_FAMILIES)}) or ({single}) or (family not in ({quoted(SINGLE_FAMILIES)}) and replicate < {kept_seeds}) as keep_tasks",
        f"scenario_id in ({quoted(transfer_scenarios)}) and n_satellites in ({', '.join(str(int(v)) for v in detail_sizes)})"
        f" and cn_fraction_percent in ({', '.join(f'{float(v)}D' for v in detail_levels)}) as keep_transfers",
    )


def volume_estimate(plan: DataFrame, n_tasks: str, keys: Sequence[str], weight: str = "1L") -> DataFrame:
    """Rows a campaign will write: evaluations, retained task rows, evaluations with transfer detail.

    ``weight``: the number of evaluations that a row of the plan stands for.
    """
    return plan.groupBy(*keys).agg(
        F.expr(f"sum({weight}) as evaluations"),
        F.expr(f"sum(if(keep_tasks, {n_tasks} * {weight}, 0)) as task_rows"),
        F.expr(f"sum(if(keep_transfers, {weight}, 0)) as transfer_evaluations"),
    )


def followup_plan(shortlist: DataFrame, targets: Sequence[int]) -> DataFrame:
    """Each shortlisted design at larger sizes, moved to the nearest multiple of its planes (at least one per plane)."""
    out = shortlist.dropDuplicates(["case_id"]).withColumn("target", F.explode(_literals(targets)))
    return out.withColumn(
        "n_satellites_planned", F.expr("greatest(n_planes, cast(bround(target / n_planes, 0) as long) * n_planes)")
    ).withColumn("adjusted", F.expr("n_satellites_planned <> target"))
