"""Random weightings against ranking every case under every draw."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyfield.operators import decision

PARTS = ["a", "b", "c"]


def cases(n, seed, traded_off=False):
    draw = np.random.default_rng(seed)
    points = draw.random((n, 3))
    if traded_off:
        points[:, 2] = 1 - (points[:, 0] + points[:, 1]) / 2
    points = points.round(2)  # many ties
    return [(("r", None)[k % 2] if k % 7 == 0 else "r", f"case{k:04d}", *map(float, p)) for k, p in enumerate(points)]


def brute(rows, weights, top):
    groups, out = defaultdict(list), defaultdict(Counter)
    for region, name, *values in rows:
        groups[region].append((name, values))
    for region, members in groups.items():
        for w in weights:
            total = lambda v: w[0] * v[0] + w[1] * v[1] + w[2] * v[2]
            ranked = sorted((-float(np.floor(total(v) * 1e9 + 0.5) / 1e9), name) for name, v in members)
            for place, (_, name) in enumerate(ranked[:top]):
                out[region, name]["first"] += place == 0
                out[region, name]["top"] += 1
    return out


@pytest.mark.parametrize("traded_off", [False, True])
def test_acceptability_equals_ranking_everything(spark, traded_off):
    rows = cases(400, 5, traded_off)
    df = spark.createDataFrame(rows, "region string, case_id string, a double, b double, c double").repartition(6)
    found = decision.rank_acceptability(df, "region", "case_id", PARTS, 300, 5, 11).collect()
    wanted = brute(rows, decision.weight_vectors(spark, 300, [1, 1, 1], 11), 5)
    assert len(found) == 400
    for r in found:
        counts = wanted[r["region"], r["case_id"]]
        assert (round(r["rank1_percent"] * 3), round(r["top5_percent"] * 3)) == (counts["first"], counts["top"])


def test_contenders_are_few_and_lose_none(spark):
    rows = cases(3000, 6)
    df = spark.createDataFrame(rows, "region string, case_id string, a double, b double, c double")
    kept = {(r["region"], r["case_id"]) for r in decision.contenders(df, "region", "case_id", PARTS, 3).collect()}
    ahead = defaultdict(int)
    for region, name, *v in rows:
        for other, rival, *u in rows:
            if other == region and all(x >= y for x, y in zip(u, v)) and (rival < name or all(x >= y + decision.MARGIN for x, y in zip(u, v))) and rival != name:
                ahead[region, name] += 1
    band = {(r[0], r[1]) for r in rows if ahead[r[0], r[1]] < 3}
    assert band <= kept and len(kept) < len(rows) / 5


def test_winners_stand_beside_their_weights(spark):
    df = spark.createDataFrame([("r", "x", 1.0, 0.0, 0.2), ("r", "y", 0.0, 1.0, 0.2), ("r", "z", 0.0, 1.0, 0.2)], "region string, case_id string, a double, b double, c double")
    rows = decision.draw_winners(df, "region", "case_id", PARTS, 50).collect()
    assert len(rows) == 50 and {r["winner"] for r in rows} == {"x", "y"}  # z ties with y and has the greater name
    for r in rows:
        assert sum(r[f"w{i}"] for i in range(3)) == pytest.approx(1)
        assert (r["winner"] == "x") == (r["w0"] > r["w1"])
    assert decision.draw_winners(df.limit(0), "region", "case_id", PARTS, 50).count() == 0
