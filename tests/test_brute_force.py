"""Operators with hand-made plans against plain loops on small data."""

import heapq
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import contacts, joins, models, skyline, spatial


def _front(points: np.ndarray) -> np.ndarray:
    return np.array([not ((points >= p).all(axis=1) & (points > p).any(axis=1)).any() for p in points])


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_skyline_blocks(spark, block_rows):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(rng.integers(0, 12, (400, 3)).astype(float), columns=["a", "b", "c"])
    frame["g"] = np.where(rng.random(400) < 0.4, "hot", "cold")
    frame["id"] = np.arange(400)
    got = skyline.skyline(spark.createDataFrame(frame), ["g"], ["a", "b"], ["c"], block_rows=block_rows).toPandas().sort_values("id")
    want = np.zeros(400, dtype=bool)
    for _, part in frame.groupby("g"):
        want[part.index] = _front(part[["a", "b", "c"]].to_numpy() * [1, 1, -1])
    assert (got["is_front"].to_numpy() == want).all()


@pytest.mark.parametrize("fan", [1, 8, 512])
def test_skyline_pairs_of_traded_off_rows(spark, fan):
    """Rows near a falling surface: few blocks face each other, and blocks far below it are closed whole."""
    rng = np.random.default_rng(8)
    share = rng.dirichlet([1, 1, 1], 12000)
    points = np.vstack([share[:10000] ** 3 * 1000 + rng.uniform(0, 0.2, (10000, 3)), share[10000:] * 0.01])
    frame = pd.DataFrame(points, columns=["_o0", "_o1", "_o2"]).assign(g=None)
    df = spark.createDataFrame(frame.values.tolist(), "_o0 double, _o1 double, _o2 double, g string")
    names = ["_o0", "_o1", "_o2"]
    blocks = skyline.curve_blocks(df, ["g"], names, 100)
    rows = blocks.toPandas()
    n = rows["_block"].nunique()
    assert n == 120 and (rows.groupby("_block").size() == 100).all()
    got = {(r["_by"], r["_of"]) for r in skyline.block_pairs(blocks, ["g"], names, fan).collect()}
    assert len(got) < n * n / 4 and all((a, a) in got for a, _ in got)
    open_blocks, values = {a for a, _ in got}, {b: part[names].to_numpy() for b, part in rows.groupby("_block")}
    assert len(open_blocks) < n
    for block, mine in values.items():
        if block not in open_blocks:
            assert any(((other.min(axis=0) >= mine.max(axis=0)).all()) for b, other in values.items() if b != block)
            continue
        for b in open_blocks:
            assert (b, block) in got or not skyline._dominated(mine, values[b]).any()


def test_skyline_known_answer_and_null_rules(spark):
    df = spark.createDataFrame([("A", 10.0, 1.0), ("B", 9.0, 2.0), ("C", 10.0, None), ("D", 10.0, 1.0)], "k string, up double, down double")
    flags = lambda rule: {r["k"]: r["is_front"] for r in skyline.skyline(df, [], ["up"], ["down"], rule).collect()}
    assert flags("drop") == {"A": True, "B": False, "D": True}
    assert flags("worst") == {"A": True, "B": False, "C": False, "D": True}
    assert flags("false") == {"A": True, "B": False, "C": False, "D": True}


def test_two_objective_front(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(rng.integers(0, 60, (500, 2)).astype(float), columns=["a", "b"]).assign(g="x", id=range(500))
    got = skyline.two_objective_front(spark.createDataFrame(frame), ["g"], ["a"], ["b"]).toPandas().sort_values("id")
    assert (got["is_front"].to_numpy() == _front(frame[["a", "b"]].to_numpy() * [1, -1])).all()


def _km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6378.137 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


@pytest.mark.parametrize("radius", [50.0, 700.0])
def test_geo_range_join_at_poles_and_date_line(spark, radius):
    rng = np.random.default_rng(8)
    lat = np.concatenate([rng.uniform(-90, 90, 150), rng.uniform(85, 90, 60), rng.uniform(-3, 3, 60)])
    lon = np.concatenate([rng.uniform(-180, 180, 210), np.where(rng.random(60) < 0.5, rng.uniform(178, 180, 60), rng.uniform(-180, -178, 60))])
    lat[0], lon[0], lat[1], lon[1] = 90.0, 180.0, -90.0, -180.0
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(lat, lon))]
    b = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(lat[::-1] * 0.999, lon[::-1]))]
    left = spark.createDataFrame(a, "i long, slat double, slon double")
    right = spark.createDataFrame(b, "j long, lat double, lon double")
    rows = spatial.geo_range_join(left, right, radius, ("slat", "slon"), ("lat", "lon")).select("i", "j").collect()
    want = {(i, j) for i, p, q in a for j, r, s in b if _km(p, q, r, s) <= radius}
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == want


def test_density_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.uniform([-50, -150], [50, 150], (12, 2))
    points = np.vstack([c + rng.normal(0, 0.03, (int(n), 2)) for c, n in zip(centres, rng.integers(2, 40, 12))] + [rng.uniform([-50, -150], [50, 150], (20, 2))])
    chain = np.column_stack([np.full(30, 10.0), 20 + np.arange(30) * 0.07])
    points = np.vstack([points, chain])
    n, eps, least = len(points), 8.0, 3
    near = [[j for j in range(n) if _km(*points[i], *points[j]) <= eps] for i in range(n)]
    core = [len(x) >= least for x in near]
    label = [None] * n
    for i in range(n):
        if core[i] and label[i] is None:
            stack = [i]
            while stack:
                k = stack.pop()
                if label[k] is None:
                    label[k] = i
                    stack += [j for j in near[k] if core[j] and label[j] is None]
    for i in range(n):
        if not core[i]:
            options = [label[j] for j in near[i] if core[j]]
            label[i] = min(options) if options else None
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "p long, lat double, lon double")
    got = {r["p"]: r for r in spatial.density_clusters(df, "p", "lat", "lon", eps, least).collect()}
    assert [got[i]["is_core"] for i in range(n)] == core
    assert [got[i]["cluster"] for i in range(n)] == label


def test_overlaps_meet_once(spark):
    """Long, short and single-leaf intervals, before and after zero and beyond the top level; null and reversed ones meet nothing."""
    rng = np.random.default_rng(12)
    top = 2.0 ** contacts.LEVELS

    def intervals(n, name):
        start = np.floor(np.concatenate([rng.uniform(-500, 500, n), rng.uniform(-3 * top, 3 * top, 20)]))
        width = np.floor(np.concatenate([2 ** rng.uniform(0, 9, n) - 1, rng.uniform(0, 4 * top, 20)]))
        rows = [(i % 2, i, float(s), float(s + w)) for i, (s, w) in enumerate(zip(start, width))]
        rows += [(0, -1, None, 5.0), (0, -2, 5.0, None), (None, -3, 0.0, 9.0), (1, -4, 90.0, 10.0)]
        return rows, spark.createDataFrame(rows, f"g int, {name} long, {name}_lo double, {name}_hi double")

    left, ldf = intervals(150, "l")
    right, rdf = intervals(130, "r")
    got = sorted((r["l"], r["r"]) for r in contacts.overlaps(ldf, rdf, ["g"], ("l_lo", "l_hi"), ("r_lo", "r_hi"), 1.0).collect())
    want = sorted((b, d) for g, b, lo, hi in left for h, d, lo2, hi2 in right
                  if g == h and g is not None and None not in (lo, hi, lo2, hi2) and lo <= hi and lo2 <= hi2 and lo <= hi2 and lo2 <= hi)
    assert got == want


def test_useful_contacts_leave_out_covered_ones(spark):
    plan = [(1, 2, 0.0, 10.0, 1.0), (2, 1, 2.0, 8.0, 1.0), (1, 2, 0.0, 10.0, 1.0), (1, 2, 2.0, 12.0, 1.0), (1, 2, 3.0, 4.0, 5.0)]
    got = {(r["start_sec"], r["end_sec"], r["rate"]) for r in contacts.useful_contacts(
        spark.createDataFrame(plan, "node_i long, node_j long, start_sec double, end_sec double, rate double")).filter("a = 1").collect()}
    assert got == {(0.0, 10.0, 1.0), (2.0, 12.0, 1.0), (3.0, 4.0, 5.0)}


def test_earliest_arrival(spark):
    rng = np.random.default_rng(6)
    plan = [(int(a), int((a + d) % 15), float(s), float(s + w), float(r)) for a, d, s, w, r in zip(
        rng.integers(0, 15, 150), rng.integers(1, 14, 150), rng.uniform(0, 90000, 150), rng.uniform(100, 30000, 150), rng.uniform(1, 5, 150))]
    tasks = [(t, int(rng.integers(0, 15)), float(rng.uniform(0, 30000)), 80000.0, 300.0) for t in range(12)]
    got = contacts.earliest_arrival(
        spark.createDataFrame(plan, "node_i long, node_j long, start_sec double, end_sec double, rate double"),
        spark.createDataFrame(tasks, "task_id long, source long, created_sec double, cutoff_sec double, size double"), 30, 7000.0)
    have = {(r["task_id"], r["node_id"]): r["arrival_sec"] for r in got.collect()}
    want = {}
    for task, source, created, cutoff, size in tasks:
        best, heap = {}, [(created, source)]
        while heap:
            at, node = heapq.heappop(heap)
            if node in best:
                continue
            best[node] = at
            for a, b, start, end, rate in plan:
                for x, y in ((a, b), (b, a)):
                    arrive = max(at, start) + size / rate
                    if x == node and y not in best and arrive <= min(end, cutoff):
                        heapq.heappush(heap, (arrive, y))
        want.update({(task, node): at for node, at in best.items()})
    assert have.keys() == want.keys()
    assert all(have[k] == pytest.approx(want[k]) for k in want)


def test_log_audit_counts_each_defect(spark):
    log = spark.createDataFrame([(1, 0, 1, 7, 0.0, 10.0, 5.0, 1), (1, 1, 2, 7, 5.0, 20.0, 6.0, 9), (1, 0, 1, 8, 30.0, 40.0, 1.0, 1)],
                                "task_id long, from_node long, to_node long, window_id long, start_sec double, end_sec double, mbit double, hop long")
    plan = spark.createDataFrame([(7, 10.0, 0.0, 50.0), (8, 10.0, 0.0, 35.0)], "window_id long, capacity_mbits double, start_sec double, end_sec double")
    source = spark.createDataFrame([(1, 0, 0.0)], "task_id long, node_id long, since_sec double")
    got = {r["check"]: r["violations"] for r in contacts.transfer_log_audit(log, plan, source, 3, 1).collect()}
    assert got == {"within_capacity": 1, "inside_window": 1, "sender_had_task": 1, "hop_limit": 1, "one_reception": 1, "copy_limit": 1}


def test_perturb_not_applicable_without_central_nodes(spark):
    plan = spark.createDataFrame([(1, 1, 2, 0.0, 10.0, 10.0, 5.0, False)], "window_id long, node_i long, node_j long, start_sec double, end_sec double, duration_sec double, capacity_mbits double, is_ground boolean")
    nodes = spark.createDataFrame([(1, False), (2, False)], "node_id long, is_central boolean")
    _, report = contacts.perturb(plan, nodes, {"failure_type": "targeted_cn_failure", "failure_level_percent": 10, "topology": "hybrid"}, "s")
    assert report.first()["applicability"] == "not_applicable_no_central_nodes" and report.first()["windows_after"] == 1


def test_polynomial_aic(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(np.arange(0, 101, 10.0), 9)
    y = 0.01 * x**2 - x + 5 + rng.normal(0, 1, len(x))
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    got = {r["degree"]: r for r in models.poly_aic(df, ["g"], "x", "y").collect()}
    for degree in (1, 2, 3):
        rss = float(((y - np.polyval(np.polyfit(x, y, degree), x)) ** 2).sum())
        assert got[degree]["aic"] == pytest.approx(len(x) * math.log(rss / len(x)) + 2 * (degree + 1), abs=1e-6)
    assert got[min(got, key=lambda d: got[d]["aic"])]["selected"] and sum(r["selected"] for r in got.values()) == 1


def test_model_comparison_against_numpy(spark):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"a": rng.uniform(1, 5, 300), "b": rng.uniform(-2, 2, 300)})
    frame["y"] = np.exp(0.3 * frame["a"] - 0.2 * frame["b"] + rng.normal(0, 0.05, 300))
    frame["id"], frame["g"] = range(300), "g"
    df = spark.createDataFrame(frame)
    got = {r["model"]: r for r in models.model_comparison(df, ["g"], ["a", "b"], "y", ["id"]).collect()}
    assert set(got) == set(models.MODELS) and all(r["n_samples"] == 300 for r in got.values())
    folds = df.select("id", F.floor(models.text_uniform(F.concat_ws("|", F.lit("cv"), F.col("id").cast("string"))) * 5).alias("f")).toPandas().sort_values("id")["f"].to_numpy()
    x = np.column_stack([np.ones(300), frame["a"], frame["b"]])
    rmse = []
    for f in sorted(set(folds)):
        beta = np.linalg.lstsq(x[folds != f], frame["y"].to_numpy()[folds != f], rcond=None)[0]
        rmse.append(float(np.sqrt(np.mean((frame["y"].to_numpy()[folds == f] - x[folds == f] @ beta) ** 2))))
    assert got["linear"]["cv_rmse"] == pytest.approx(np.mean(rmse), rel=1e-6)
    assert got["log_linear"]["is_best"]


def test_exp_offset_recovers_the_rate(spark):
    df = spark.createDataFrame([("g", float(x), -40 * math.exp(-0.05 * x) + 60) for x in range(0, 101, 5)], "g string, x double, y double")
    row = models.exp_offset_fit(df, ["g"], "x", "y", [0.01 * i for i in range(1, 21)]).first()
    assert row["b"] == pytest.approx(0.05) and row["a"] == pytest.approx(-40) and row["c"] == pytest.approx(60)
    assert row["r_squared"] == pytest.approx(1.0)


def test_continuous_fit_meets_known_parameters(spark):
    """Rates off any grid, shifted x, a rising curve, a straight line, few levels, missing values and a null key."""
    rng = np.random.default_rng(21)
    x = np.arange(0, 101, 5.0)
    rows = [("fall", v, 40 * np.exp(-0.0437 * v) + 12.5) for v in x] + [("far", v + 1000, 3 * np.exp(-0.1234 * v) - 7) for v in x]
    rows += [("rise", v, 0.5 * np.exp(0.0311 * v) + 2) for v in x] + [("line", v, 2 * v + 1) for v in x] + [(None, v, v * v) for v in (0.0, 1.0, 2.0)]
    noisy = [("noisy", v, 30 * np.exp(-0.05 * v) + 5 + rng.normal(0, 0.5)) for v in np.repeat(x, 3)]
    rows += noisy + [("fall", None, 1.0), ("fall", 2.0, None), ("fall", 2.0, float("nan"))]
    df = spark.createDataFrame([(k, None if a is None else float(a), None if b is None else float(b)) for k, a, b in rows], "g string, x double, y double")
    got = {r["g"]: r for r in models.exp_offset_continuous(df, ["g"], "x", "y").collect()}
    for key, a, b, c in (("fall", 40, 0.0437, 12.5), ("rise", 0.5, -0.0311, 2)):
        assert got[key]["model"] == "exponential_offset"
        assert [got[key][n] for n in "abc"] == pytest.approx([a, b, c], rel=1e-6)
    assert got["far"]["b"] == pytest.approx(0.1234, rel=1e-6) and got["far"]["c"] == pytest.approx(-7, rel=1e-6)
    assert got["line"]["model"] == "quadratic" and [got["line"][n] for n in ("p0", "p1", "p2")] == pytest.approx([1, 2, 0], abs=1e-6)
    assert got[None]["model"] == "quadratic" and got[None]["p2"] == pytest.approx(1) and got[None]["loo_rmse"] is None
    # Against plain numpy: the least error over a fine grid of rates, and leave-one-out by hat values.
    px, py = np.array([r[1] for r in noisy]), np.array([r[2] for r in noisy])
    design = lambda b: np.column_stack([np.exp(-b * px), np.ones(len(px))])
    errors = lambda b: float(((py - design(b) @ np.linalg.lstsq(design(b), py, rcond=None)[0]) ** 2).sum())
    b = min(np.linspace(0.03, 0.08, 20001), key=errors)
    assert got["noisy"]["b"] == pytest.approx(b, abs=4e-6) and got["noisy"]["rmse"] == pytest.approx(np.sqrt(errors(b) / len(px)), rel=1e-8)
    a, c = np.linalg.lstsq(design(b), py, rcond=None)[0]
    jac = np.column_stack([np.exp(-b * px), -a * px * np.exp(-b * px), np.ones(len(px))])
    hat = np.diag(jac @ np.linalg.inv(jac.T @ jac) @ jac.T)
    left_out = (py - a * np.exp(-b * px) - c) / (1 - hat)
    assert got["noisy"]["loo_rmse"] == pytest.approx(np.sqrt((left_out ** 2).mean()), rel=1e-4)


@pytest.mark.parametrize("mode", ["all", "central_only"])
def test_candidate_pairs_of_dealt_groups(spark, mode):
    rows = [("hot", i, i % 97 == 5) for i in range(900)] + [("plain", i, None) for i in range(300)] + [("one", 1, True)]
    got = [tuple(r) for r in joins.candidate_pairs(spark.createDataFrame(rows, "g string, node_id long, is_central boolean"), mode, "g", 64).collect()]
    has = {g for g, _, c in rows if c} if mode == "central_only" else set()
    want = {(g, i, j) for g, i, a in rows for h, j, b in rows if g == h and i < j and (g not in has or a or b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_candidate_pairs_spread_a_hot_group(spark):
    nodes = spark.range(20000).selectExpr("'x' as g", "id as node_id", "id % 200 = 7 as is_central")
    pairs = joins.candidate_pairs(nodes, "central_only", "g")
    assert pairs.count() == 100 * 19900 + 100 * 99 // 2
    # The same group in chunks of 100: every task of the join gets its part.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = joins.candidate_pairs(nodes, "central_only", "g", 100).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 1_000_000
